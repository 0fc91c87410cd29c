"""Similarity join of documents on word shingles.

Documents link when the Jaccard similarity of their sets of 5-word shingles is
at least 3/4. The join follows prefix filtering: shingles are put in one order,
rare first, and two similar sets must share a shingle within short prefixes.

1. One pass over the texts gives each document its set's size, fingerprint (128
   bits) and histogram, and a sketch of shingle frequencies over all documents
   (2^21 counters, merged in parallel). Documents with one set are one node.
2. A second pass writes each node's prefix, rare shingles first by that sketch.
   Any order that all documents share keeps the join complete; this one puts
   passages that many documents hold last.
3. Prefix shingles meet by a shuffle on the shingle. In a first round each is
   paired only with the shortest node of its shingle and length class, a hub;
   pairs grow with the rows, not with the square of a group. Shingles that the
   sketch tells to be very frequent are salted into several groups, whose hubs
   meet in a round of their own. Length, positional and (on the histograms)
   suffix filters prune; survivors are verified on their sets, once a pair.
4. Shingles of three nodes or more that still join several components have
   further such rounds, each with other hubs, chosen by keyed hashes.
5. A last round pairs what shares a shingle but isn't yet in one component,
   under the same filters: for each shingle the nodes outside its largest
   component with all nodes. So nothing that decides a component is left out,
   and groups of near copies, one component by then, cost nothing more. Here
   the parities of the histograms filter while the join compares: sets in which
   d shingles differ differ in at most d parities, and a link allows a seventh
   of both sizes. What shares a common line only never becomes a row.

Prefix rows name a node by 64 bits of its fingerprint. Should two nodes share
these, both stand for the row: more candidates, never a lost or a false link.

Defined results: a document without words has no shingles, size 0, and links
with nothing; one with fewer than five words has its whole sequence as one
shingle. A row without an id links like any other; it gets the smallest id of
its group, null if none has one. Rows that repeat an id are handled each by its
text. Further columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .scratch import Scratch
from .workers import parts, task

WORDS = 5
SKETCH_BITS, PARTS = 21, 64
#: A set's histogram: its shingles by their hashes' upper bits, up to FULL each.
BINS, FULL = 256, 255
SEEN = 100_000
#: Rows of a shingle, by the sketch, that go to one group before it is salted.
SPLIT = 20_000
#: Further hub rounds, with HUBS hubs for each shingle and length class.
HUB_ROUNDS, HUBS = 2, 4
#: Rows up to which a table of ids is broadcast, after a count; ends of pairs.
FEW, FEW_ENDS = 500_000, 100_000
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> np.ndarray:
    """A hash of each word, in order: words are what lies between the six ASCII
    spaces, A-Z lower-cased."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.zeros(0, np.uint64)
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    sizes = np.diff(begins, append=len(at))
    place = np.arange(len(at)) - np.repeat(begins, sizes)
    # beyond 4096 bytes of a word the powers repeat, with the round mixed in
    value = (data[at].astype(np.uint64) + np.uint64(1) + (place >> 12).astype(np.uint64) * np.uint64(257)) * _POW[place & 4095]
    return mixed(np.add.reduceat(value, begins) + sizes.astype(np.uint64) * _K1)


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    if not len(words):
        return np.zeros(0, np.uint64)
    k = min(WORDS, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = mixed(h * _K1 + words[i : len(words) - k + 1 + i])
    h.sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    return h[first]


def fingerprint(sh: np.ndarray) -> tuple[int, str]:
    """64 bits of a set's fingerprint, and all 128 as a text."""
    size = np.full(1, len(sh), np.uint64)
    f, g = mixed(np.concatenate([mixed(sh ^ _K1).sum(keepdims=True) + size, mixed(sh + _K3).sum(keepdims=True) ^ (size * _K2)]))
    return int(f.astype(np.int64)), f"{int(f):016x}{int(g):016x}"


def _packed(counts: np.ndarray) -> bytes:
    """Counters byte by byte: the lowest bytes of all, then the next."""
    return pa.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _places(sh: np.ndarray) -> np.ndarray:
    return (sh >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, text and h, a hash of the text that tells rows of one id apart."""
    return documents.select("doc_id", "text", F.xxhash64("text").alias("h"))


def _nodes(documents: DataFrame) -> DataFrame:
    """(doc_id, h, key, f, n, bins) of every row, and the tasks' sketches as
    (part, counts)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "h", "key", "f", "n", "bins", "part", "counts"]

    def run(batches):
        counts, key_type = np.zeros(1 << SKETCH_BITS, np.uint32), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for part in parts(batch, 1):
                keys, f, n, bins, at = [], [], [], [], [np.zeros(0, np.int64)]
                for text in part.column(1).to_pylist():
                    sh = shingles(words_of(text or ""))
                    short, key = fingerprint(sh) if len(sh) else (None, None)
                    n.append(len(sh))
                    f.append(short)
                    keys.append(key)
                    bins.append(np.minimum(np.bincount((sh >> np.uint64(56)).astype(np.int64), minlength=BINS), FULL).astype(np.uint8).tobytes())
                    at.append(_places(sh))
                at, more = np.unique(np.concatenate(at), return_counts=True)
                counts[at] += more.astype(np.uint32)
                none = [None] * len(f)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.string()), pa.array(f, pa.int64()), pa.array(n, pa.int64()), pa.array(bins, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)
        if key_type is not None:
            split = counts.reshape(PARTS, -1)
            on = [p for p in range(PARTS) if split[p].any()]
            none = [None] * len(on)
            packed = [_packed(split[p]) for p in on]
            yield pa.RecordBatch.from_arrays([pa.array(none, key_type), pa.array(none, pa.int64()), pa.array(none, pa.string()), *[pa.array(none, pa.int64())] * 2, pa.array(none, pa.binary()), pa.array(on, pa.int32()), pa.array(packed, pa.binary())], names=names)

    return _rows(documents).mapInArrow(task("jaccard", run), f"doc_id {kind}, h long, key string, f long, n long, bins binary, part int, counts binary")


def _merged(sketches: DataFrame) -> np.ndarray:
    """The sketch of all tasks: a fixed 2^SKETCH_BITS counters."""
    width = (1 << SKETCH_BITS) // PARTS

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[p] = total.get(p, 0) + _unpacked(c, width).astype(np.uint64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(np.minimum(v, 0xFFFFFFFF)) for v in total.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros((PARTS, width), np.uint32)
    for r in sketches.select("part", "counts").repartition("part").mapInArrow(task("jaccard", run), "part int, counts binary").collect():
        out[r["part"]] = _unpacked(bytes(r["counts"]), width)
    return out.ravel()


def probe_length(n):
    return n - (3 * n + 3) // 4 + 1


#: Of the shorter set of a pair: the end of its prefix.
_INDEXED = "n{0} - (6L * n{0} + 6) div 7 + 1"


def _prefixes(documents: DataFrame, sketch) -> DataFrame:
    """(token, salt, f, n, pos) of every node's prefix; a task writes a set that
    it has seen lately only once. A shingle that the sketch knows to be in one
    row takes its place of the prefix, but meets no one and isn't written."""

    def run(batches):
        counts, seen = sketch.value, set()
        usual, step = int(np.median(counts)), max(0, int(counts.max()).bit_length() - 20)
        rows: list[tuple] = []
        size = 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[k] for r in rows])) for k in range(5)], names=["token", "salt", "f", "n", "pos"])

        for batch in batches:
            for part in parts(batch, 0):
                for text in part.column(0).to_pylist():
                    sh = shingles(words_of(text or ""))
                    if not len(sh):
                        continue
                    f, key = fingerprint(sh)
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    often = counts[_places(sh)]
                    # a stable order of equal keys: by the shingles themselves
                    order = np.argsort(((often >> step).astype(np.uint64) << np.uint64(44)) | (sh >> np.uint64(20)), kind="stable")[: probe_length(len(sh))]
                    pos = np.flatnonzero(often[order] > 1)
                    if not len(pos):
                        continue
                    often = often[order][pos].astype(np.int64)
                    salts = np.maximum(often - usual, 0) // SPLIT + 1
                    salt = np.where(salts > 1, 1 + int(key[16:], 16) % salts.astype(np.uint64), 0).astype(np.int32) if (salts > 1).any() else np.zeros(len(pos), np.int32)
                    rows.append((sh[order][pos].astype(np.int64), salt, np.full(len(pos), f), np.full(len(pos), len(sh), np.int32), pos.astype(np.int32)))
                    size += len(pos)
                    if size >= 100_000:
                        yield out()
                        rows, size = [], 0
        if rows:
            yield out()

    return documents.select("text").mapInArrow(task("jaccard", run), "token long, salt int, f long, n int, pos int")


def _hubs(prefixes: DataFrame) -> DataFrame:
    """Rows of shingles that two nodes or more share, each with its hub: the
    first node of its shingle, salt and length class, or for that node the hub
    of the class before. ``top`` marks the hubs of salted shingles, ``crowd`` the
    rows of shingles that three nodes or more share. Rows come sorted; what is
    carried from batch to batch is three rows, however large a group is. Two
    rows at a batch's end wait for the next batch, which may have a third."""

    def run(batches):
        carry, had = None, 0  # had: rows of the last group besides the carried ones
        for batch in chain(batches, (None,)):
            if batch is None:
                if carry is None:
                    return
                token, salt, f, n, pos = (x[:0] for x in carry[:5])
            else:
                token, salt, f, n, pos = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            told = np.zeros(len(token), bool)
            if carry is not None:
                token, salt, f, n, pos, told = (np.concatenate([x, y]) for x, y in zip(carry, (token, salt, f, n, pos, told)))
            copy = np.zeros(len(token), bool)
            copy[1:] = (token[1:] == token[:-1]) & (f[1:] == f[:-1]) & (n[1:] == n[:-1])
            if copy.any():
                keep = ~copy
                token, salt, f, n, pos, told = token[keep], salt[keep], f[keep], n[keep], pos[keep], told[keep]
            size = len(token)
            first = np.ones(size, bool)
            first[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            kind = np.floor(np.log(n) / np.log(4 / 3)).astype(np.int32)
            opens = first.copy()
            opens[1:] |= kind[1:] != kind[:-1]
            place = np.arange(size)
            hub = np.maximum.accumulate(np.where(opens, place, 0))
            # the hub of the class before, for a hub that isn't its group's first
            before = np.full(size, -1)
            at = np.flatnonzero(opens)
            before[at[1:]] = at[:-1]
            before[first] = -1
            partner = np.where(opens, before, hub)
            group = np.cumsum(first) - 1
            sizes = np.bincount(group)
            sizes[0] += had
            crowd = (sizes[group] > 2) | (salt > 0)
            tell = ((sizes[group] > 1) | crowd) & ~told
            if batch is not None:
                tell &= crowd | (group < group[-1])
            out = np.flatnonzero(tell)
            if len(out):
                p = partner[out]
                none = p < 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[out]), pa.array(f[out]), pa.array(n[out]), pa.array(pos[out]), pa.array((salt > 0)[out] & opens[out]), pa.array(crowd[out]), pa.array(f[p], mask=none), pa.array(n[p], mask=none), pa.array(pos[p], mask=none)],
                    names=["token", "f", "n", "pos", "top", "crowd", "hf", "hn", "hpos"],
                )
            told |= tell
            last = size - 1
            ends = [last] if opens[last] else [hub[last], last]
            if before[hub[last]] >= 0:
                ends = [before[hub[last]], *ends]
            ends = np.array(ends)
            carry, had = (token[ends], salt[ends], f[ends], n[ends], pos[ends], told[ends]), sizes[-1] - len(ends)

    return prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "f").mapInArrow(task("jaccard", run), "token long, f long, n int, pos int, top boolean, crowd boolean, hf long, hn int, hpos int")


def _may_link(n: str, pos: str, m: str, at: str):
    """Length and positional filters."""
    n_, m_, p_, q_ = F.col(n).cast("long"), F.col(m).cast("long"), F.col(pos).cast("long"), F.col(at).cast("long")
    return (4 * F.least(n_, m_) >= 3 * F.greatest(n_, m_)) & (7 * F.least(n_ - p_, m_ - q_) >= 3 * (n_ + m_))


def _ordered(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("fa"), F.greatest(a, b).alias("fb")).distinct()


def _told(shared: DataFrame) -> DataFrame:
    return _ordered(shared.where(F.col("hf").isNotNull() & _may_link("n", "pos", "hn", "hpos")), "f", "hf")


def _sets(keys: DataFrame, classes: DataFrame, documents: DataFrame, repeated: bool, scratch: Scratch) -> DataFrame:
    """(key, tokens) of some nodes: all their shingles."""
    wanted = scratch.keep(keys.distinct().join(classes.select("key", "id", "h"), "key").select("key", F.col("id").alias("_id"), F.col("h").alias("_h")), "wanted")
    one = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    texts = _rows(documents).where("text is not null").join(one, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text")

    def run(batches):
        for batch in batches:
            for part in parts(batch, 1):
                keys, tokens = [], []
                for key, text in zip(*(c.to_pylist() for c in part.columns)):
                    sh = shingles(words_of(text))
                    if len(sh) and fingerprint(sh)[1] == key:
                        keys.append(key)
                        tokens.append(sh.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(tokens, pa.binary())], names=["key", "tokens"])

    sets = texts.mapInArrow(task("jaccard", run), "key string, tokens binary")
    out = scratch.keep(sets.dropDuplicates(["key"]) if repeated else sets, "sets")
    scratch.drop(wanted)
    return out


def _parities(classes: DataFrame) -> DataFrame:
    """(f, e0 .. e3): for each bin of a node's histogram whether it is odd; a
    full bin, which may have more, counts as FULL for all."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BINS)
                odd = np.packbits(bins & 1, axis=1).view(">i8").astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(odd[:, k]) for k in range(4)]], names=["f", "e0", "e1", "e2", "e3"])

    return classes.select("f", "bins").mapInArrow(task("jaccard", run), "f long, e0 long, e1 long, e2 long, e3 long")


def _verified(pairs: DataFrame, classes: DataFrame, documents: DataFrame, repeated: bool, scratch: Scratch) -> DataFrame:
    """Of pairs (fa, fb): the links (a, b) of their nodes. repeated: rows may
    share an id and a text."""
    ends = scratch.keep(pairs.select(F.explode(F.array("fa", "fb")).alias("f")).distinct(), "ends")
    some = classes.join(F.broadcast(ends), "f", "left_semi") if ends.count() <= FEW_ENDS else classes
    ca, cb = (some.select(F.col("f").alias("f" + s), F.col("key").alias("k" + s), F.col("n").alias("n" + s), F.col("bins").alias("b" + s)) for s in "ab")

    def suffix(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (4, 5))
                full = (x.max(axis=1) == FULL) | (y.max(axis=1) == FULL)  # these may have more than they tell
                both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
                n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
                yield batch.filter(pa.array(full | (7 * both >= 3 * (n + m)))).select([0, 1])

    close = pairs.join(ca, "fa").join(cb, "fb").where("ka <> kb").select("ka", "kb", "na", "nb", "ba", "bb").mapInArrow(task("jaccard", suffix), "ka string, kb string")
    close = scratch.keep(close, "close")
    scratch.drop(ends)
    sets = _sets(close.select(F.col("ka").alias("key")).union(close.select(F.col("kb").alias("key"))), classes, documents, repeated, scratch)

    def verify(batches):
        for batch in batches:
            for part in parts(batch, 2):
                good = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    joined = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                    joined.sort()
                    both = int((joined[1:] == joined[:-1]).sum())
                    good.append(100 * both >= 75 * (len(joined) - both))
                yield part.filter(pa.array(good, pa.bool_())).select([0, 1])

    ta, tb = (sets.select(F.col("key").alias("k" + s), F.col("tokens").alias("t" + s)) for s in "ab")
    links = scratch.keep(close.join(ta, "ka").join(tb, "kb").select("ka", "kb", "ta", "tb").mapInArrow(task("jaccard", verify), "a string, b string"), "links")
    scratch.drop(sets)
    scratch.drop(close)
    return links


def _few(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW_ENDS else rows


def _open(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows of shingles that nodes of several components share, with their
    components, and the largest component of each shingle. Without a component
    are nodes that are one by themselves."""
    rows = rows.select("token", "f", "n", "pos").join(_few(linked), "f", "left")
    each = rows.groupBy("token", "component").agg(F.count("*").alias("n"))
    k, largest = F.expr("if(component is null, n, 1L)"), F.max(F.struct(F.expr("if(component is null, 1L, n)"), "component"))
    tokens = each.groupBy("token").agg(F.sum(k).alias("k"), largest["component"].alias("main")).where("k > 1").select("token", "main")
    return rows.join(tokens, "token")


def _apart(a: str, b: str, fa: str, fb: str):
    """Nodes fa and fb, of the components a and b, are in different ones."""
    return F.expr(f"if({a} is null and {b} is null, {fa} <> {fb}, not ({a} <=> {b}))")


def _met(rows: DataFrame, k: int) -> DataFrame:
    """Pairs (fa, fb) of rows with their hubs: of each shingle and length class
    the nodes first by HUBS keyed hashes. Nodes of one component aren't paired."""
    rows = rows.withColumn("kind", F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3))))
    picks = [F.min(F.struct(F.xxhash64(F.lit(k * HUBS + h), "token", "f").alias("o"), "f", "n", "pos", "component")).alias(f"h{h}") for h in range(HUBS)]
    hubs = rows.groupBy("token", "kind").agg(*picks).select("token", "kind", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"h{h}.{c}").alias(c) for c in ("f", "n", "pos", "component")]) for h in range(HUBS)]))).alias("hub"))
    met = rows.join(hubs.select("token", "kind", *[F.col(f"hub.{c}").alias("h" + c) for c in ("f", "n", "pos", "component")]), ["token", "kind"])
    return _ordered(met.where(_apart("component", "hcomponent", "f", "hf") & _may_link("n", "pos", "hn", "hpos")), "f", "hf")


def _left(rows: DataFrame, parities: DataFrame) -> DataFrame:
    """Pairs (fa, fb) of nodes that share a shingle and pass the filters, but are
    in different components: one of them is outside the shingle's largest."""
    odd = [f"e{k}" for k in range(4)]
    rows = rows.join(parities, "f")
    a, b = (r.select("token", *(F.col(c).alias(c + s) for c in ("f", "n", "pos", "component", *odd))) for r, s in ((rows.where("component is null or not (component <=> main)"), "a"), (rows, "b")))
    alike = F.expr(f"7 * ({' + '.join(f'bit_count({e}a ^ {e}b)' for e in odd)}) <= na + nb")
    indexed = F.expr(f"if(na < nb or (na = nb and fa < fb), posa < {_INDEXED.format('a')}, posb < {_INDEXED.format('b')})")
    return _ordered(a.join(b, "token").where(_apart("componenta", "componentb", "fa", "fb") & indexed & _may_link("na", "posa", "nb", "posb") & alike), "fa", "fb")


def component_table(spark: SparkSession, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (doc_id, h, key, n) of every row, and linked (key, component): the
    keys of linked nodes have one component, the smallest of them. Keys that
    aren't there are linked with none."""
    scratch = Scratch(spark, "jaccard", "zstd")
    written = scratch.keep(_nodes(documents), "nodes")
    nodes = written.where("part is null").drop("part", "counts")
    sketch = spark.sparkContext.broadcast(_merged(written.where("part is not null")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h"))
    classes = nodes.where("key is not null").groupBy("key", "f", "n").agg(first.alias("r"), F.first("bins").alias("bins"))
    classes = scratch.keep(classes.select("key", "f", "n", F.col("r.doc_id").alias("id"), F.col("r.h").alias("h"), "bins"), "classes")
    shared = scratch.keep(_hubs(_prefixes(documents, sketch)), "shared")
    # two nodes of a shingle meet in the first round: later ones are for three or more
    rows = scratch.keep(shared.where("crowd").select("token", "f", "n", "pos"), "crowds")
    tops = _hubs(shared.where("top").select("token", F.lit(0).alias("salt"), "f", "n", "pos"))
    pairs = scratch.keep(_told(shared).union(_told(tops)).distinct(), "pairs")
    scratch.drop(shared)
    again = nodes.where("key is not null").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    repeated = not again.isEmpty()
    links = _verified(pairs, classes, documents, repeated, scratch)
    # 64 bits are rarely two nodes': these have a component each, linked or not
    twins = F.broadcast(classes.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"))
    twins = scratch.keep(classes.join(twins, "f", "left_semi").select(F.col("key").alias("node"), F.col("key").alias("component")), "twins")

    def settled(links: DataFrame) -> DataFrame:
        found = scratch.keep(connected_components(links, scratch), "found")
        both = found.union(twins.join(found, "node", "left_anti"))
        out = scratch.keep(both.select(F.conv(F.substring("node", 1, 16), 16, -10).cast("long").alias("f"), "node", "component"), "components")
        scratch.drop(found)
        return out

    def stars(classed: DataFrame) -> DataFrame:
        return classed.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))

    classed = settled(links)
    for k in range(HUB_ROUNDS + 1):
        now = scratch.keep(_open(rows, classed.select("f", F.unhex("component").alias("component"))), "open")
        new = scratch.keep((_left(now, _parities(classes)) if k == HUB_ROUNDS else _met(now, k)).join(pairs, ["fa", "fb"], "left_anti"), "pairs")
        scratch.drop(now)
        links = _verified(new, classes, documents, repeated, scratch)
        if not links.isEmpty():
            classed = settled(stars(classed).union(links))
        pairs = pairs.union(new)
    return nodes.select("doc_id", "h", "key", "n"), classed.select(F.col("node").alias("key"), "component")


def _components(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """Nodes with shingles, and the component of each."""
    some = nodes.where("key is not null").join(_few(linked), "key", "left")
    return some.withColumn("component", F.coalesce("component", "key"))


def op2(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``documents``."""
    nodes, linked = component_table(spark, documents)
    some = _components(nodes, linked)
    least = some.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = some.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.union(nodes.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of linked ones: that with the
    smallest id (an id before none), of rows that repeat it one. Rows without
    words all stay."""
    nodes, linked = component_table(spark, documents)
    some = _components(nodes, linked)
    first = some.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("r")).select("r.doc_id", "r.h")
    chosen = first.withColumn("one", F.lit(True)).union(nodes.where("key is null").select("doc_id", "h").distinct().withColumn("one", F.lit(False)))
    mine = {c: f"_gridloom_{c}" for c in ("doc_id", "h", "one")}  # beside whatever columns there are
    chosen = Scratch(spark, "chosen").keep(chosen.select(*[F.col(c).alias(n) for c, n in mine.items()]), "chosen")
    kept = documents.join(chosen, F.col("doc_id").eqNullSafe(F.col(mine["doc_id"])) & (F.xxhash64("text") == F.col(mine["h"])), "inner")
    again = nodes.where("key is not null").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():  # rows that repeat an id and its text
        one = F.col(mine["one"])
        kept = kept.where(~one).unionByName(kept.where(one).dropDuplicates([mine["doc_id"], mine["h"]]))
    return kept.select(documents.columns)
