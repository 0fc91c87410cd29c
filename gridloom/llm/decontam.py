"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

1. Words are runs of letters and digits, lower-cased. Each position of a text is
   probed, by its 5-word shingle's hash, in a bitmap of the benchmark's shingles
   of fixed size; nearly all positions end there, in the scan's own stage.
2. Every window of an item's number of words that covers a shingle of the item
   is cut out if the shingles it shares with the item can weigh enough for
   ``SIMILARITY``; no other window can reach it. For this the text is taken in
   blocks of as many words as the item has: a window lies in the block where it
   starts and the next.
3. Windows and items get 64-bit SimHashes of their words. ``BLOCKS`` blocks of
   the fingerprint index the items: two fingerprints within ``RADIUS`` agree in
   at least one block, so joining on (size, block, value) finds all of them.
4. Candidates are verified exactly: the weighted Jaccard similarity of the
   shingle sets, a shingle weighing its letters, must reach ``SIMILARITY``.

The benchmark is broadcast only if its shingles number at most
``BROADCAST_ROWS``; otherwise the joins are shuffled.

Defined results: texts and items that are null or have no word match nothing.
An item of fewer than five words is one shingle, its whole sequence. Rows with
a null id are ignored by ``matches``, rows that repeat an id give their best
match together; ``without_leaks`` judges each text.
Equal items each match. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .scratch import Scratch

SHINGLE = 5
SIMILARITY = 0.75
RADIUS, BLOCKS = 15, 16
BITMAP_LONGS = 1 << 14
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column, k: Column) -> Column:
    """All runs of k words, as arrays; k is at most the number of words."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.slice(words, i, k))


def _simhash(words: Column) -> Column:
    """64 bits: the sign of the sum of the words' hash bits, counted as +1 and -1."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.getbit(h, b) == 1, 1).otherwise(-1)),
    )
    one = F.lit(1).cast("long")
    set_bits = F.transform(bits, lambda s, b: F.when(s > 0, F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(set_bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def _block(fingerprint: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, b * (64 // BLOCKS)).bitwiseAND(F.lit((1 << 64 // BLOCKS) - 1))


def _weighted(words: Column, k: Column) -> Column:
    return F.array_distinct(F.transform(_shingles(words, k), lambda s: F.array_join(s, " ")))


def _letters(shingles: Column) -> Column:
    return F.aggregate(shingles, F.lit(0).cast("long"), lambda s, x: s + F.length(x))


def matches(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start (word of the text), n_words of every
    pair of a text and an item that some window of the text matches."""
    items = (
        benchmark.where("item_id is not null and text is not null")
        .select("item_id", words_of(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .withColumn("w", F.size("words"))
        .withColumn("k", F.least("w", F.lit(SHINGLE)))
    )
    # the least weight of an item's shingles that a window must share
    need = SIMILARITY * _letters(_weighted(F.col("words"), F.col("k")))
    parts = items.select("item_id", "w", "k", need.alias("need"), F.explode(F.transform(_shingles(F.col("words"), F.col("k")), lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(F.array_join(s, " ")).alias("weight")))).alias("part")).select("item_id", "w", "k", "need", "part.h", "part.weight")
    bit = lambda h: F.pmod(h, F.lit(BITMAP_LONGS * 64))
    # a bitmap of fixed size, and how many shingles there are
    cells = parts.groupBy("k", (bit(F.col("h")) / 64).cast("int").alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))).alias("bits"), F.count("*").alias("n")).collect()
    none = documents.where("false").select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_words"))
    if not cells:
        return none
    small = sum(c["n"] for c in cells) <= BROADCAST_ROWS
    few = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    words = documents.where("doc_id is not null and text is not null").select("doc_id", words_of(F.col("text")).alias("words")).withColumn("size", F.size("words"))

    found = None
    for k in sorted({c["k"] for c in cells}):
        bitmap = [0] * BITMAP_LONGS
        for c in cells:
            if c["k"] == k:
                bitmap[c["cell"]] = c["bits"]
        table = F.from_json(F.lit(str(bitmap)), "array<bigint>")
        # a filter on the size would split each text twice
        places = F.when(F.col("size") >= k, F.sequence(F.lit(1), F.col("size") - (k - 1)))
        at = words.select("doc_id", "words", "size", F.explode(places).alias("pos"))
        at = at.withColumn("h", F.xxhash64(F.slice("words", F.col("pos"), k)))
        hit = at.where(F.getbit(F.get(table, (bit(F.col("h")) / 64).cast("int")), F.pmod("h", F.lit(64)).cast("int")) == 1)
        w, block = F.col("w"), F.col("block")
        cut = hit.join(few(parts.where(F.col("k") == k).drop("k").distinct()), "h").withColumn("pos", F.col("pos") - 1)
        last = (F.col("pos") / w).cast("int")
        cut = cut.withColumn("block", F.explode(F.sequence(F.greatest(last - 1, F.lit(0)), last)))
        # rows that repeat an id are told apart by the words themselves
        groups = cut.groupBy("doc_id", "item_id", "w", "need", "block", F.slice("words", block * w + 1, w * 2).alias("part")).agg(F.collect_set(F.struct("pos", "weight")).alias("hits"))
        end = F.least(w - 1, F.size("part") - w)
        # a text shorter than the item is a window itself
        end = F.when(block == 0, F.greatest(end, F.lit(0))).otherwise(end)
        shared = lambda s: F.aggregate("hits", F.lit(0), lambda t, h: t + F.when((h["pos"] >= s) & (h["pos"] <= s + w - k), h["weight"]).otherwise(0))
        starts = F.filter(F.when(end >= 0, F.sequence(block * w, block * w + end)), lambda s: shared(s) >= F.col("need"))
        start = F.col("start")
        windows = groups.select("doc_id", "w", "block", "part", F.explode(starts).alias("start")).select("doc_id", (start + 1).alias("start"), "w", F.slice("part", start - block * w + 1, w).alias("window"))
        found = windows if found is None else found.union(windows)
    windows = found.distinct().withColumn("fp", _simhash(F.col("window")))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    left = windows.withColumn("b", blocks).withColumn("value", _block(F.col("fp"), F.col("b")))
    right = items.withColumn("ip", _simhash(F.col("words"))).withColumn("b", blocks).select("item_id", "w", "k", F.col("words").alias("item"), "ip", "b", _block(F.col("ip"), F.col("b")).alias("value"))
    near = left.join(few(right), ["w", "b", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ip"))) <= RADIUS)
    # a pair of fingerprints is verified at its first common block only
    first = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: _block(F.col("fp"), b) == _block(F.col("ip"), b)))
    pairs = near.where(F.col("b") == first).where(F.size("window") >= F.col("k"))
    a, c = _weighted(F.col("window"), F.col("k")), _weighted(F.col("item"), F.col("k"))
    scored = pairs.select("doc_id", "item_id", (F.col("start") - 1).cast("long").alias("start"), F.size("window").cast("long").alias("n_words"), (_letters(F.array_intersect(a, c)) / _letters(F.array_union(a, c))).alias("similarity"))
    return (
        scored.where(F.col("similarity") >= SIMILARITY)
        .groupBy("doc_id", "item_id")
        .agg(F.max_by(F.struct("similarity", "start", "n_words"), F.struct("similarity", -F.col("start"))).alias("best"))
        .select("doc_id", "item_id", "best.similarity", "best.start", "best.n_words")
    )


def without_leaks(spark: SparkSession, documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a benchmark item. A row is judged by
    its text alone, so rows without an id, or with another's, are too."""
    keyed = documents.select(F.xxhash64("text").alias("doc_id"), "text")
    leaks = Scratch(spark, "decontam").keep(matches(spark, keyed, benchmark).select(F.col("doc_id").alias("_gridloom_leak")).distinct(), "leaks")
    few = F.broadcast(leaks) if leaks.count() <= BROADCAST_ROWS else leaks
    return documents.join(few, F.col("text").isNotNull() & (F.xxhash64("text") == F.col("_gridloom_leak")), "left_anti").select(documents.columns)
