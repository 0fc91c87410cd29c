"""Quality classifier: a linear model on n-gram indicators scaled by naive Bayes
log-count ratios (NB support vectors), with the hinge loss, solved by dual
coordinate descent.

The n-grams of a whole text are its words' (orders 1 and 2) and its letters'
(order 4), without case, hashed into a fixed number of indicators; and those of
streams that say the same in every language: its character classes with runs
collapsed (orders 1 to 4), its words' echoes, i.e. whether a word equals the one
(or the one but one) before (orders 1 to 4), its lines' echoes (orders 1 to 3),
and the share of lines seen before. An indicator is 1 if the n-gram occurs at
all. Words and letters count less in the margin than the streams, by
``LEXICAL``, as each text has many more of them. Margins become scores
by a logistic curve through out-of-fold margins, weighted back to the labels'
true shares.

The fit reads at most ``BUCKETS`` rows of each label (the documented bound),
drawn by hash from all labelled rows that aren't held out; scoring reads every
whole text.

Defined results: a null text counts as empty and scores as the model's bias
says; without labels of both kinds every score is the share of label 1 among
the labels, 0.5 without any. Rows with null ids and repeated rows are scored
each. Further columns are ignored, or passed on by ``score_column``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .linear import dual_coordinate_descent, platt
from .sampling import draw, held_out, learnable
from .workers import kept, parts, task

BUCKETS = 2048
THRESHOLD = 0.7
COST, SMOOTH, FOLDS = 0.1, 1.0, 3
CLASSES = 10
ORDERS = 4
_STARTS = np.cumsum([0, *(CLASSES**n for n in range(1, ORDERS + 1))])
_ECHO = int(_STARTS[-1])
_LINES = _ECHO + 2 * 30
_SEEN = _LINES + 14
_WORD = _SEEN + 6
WORD_BITS, LETTER_BITS = 17, 16
_LETTER = _WORD + (1 << WORD_BITS)
DIM = _LETTER + (1 << LETTER_BITS)
LEXICAL = 0.2
PIECE = 4_000_000


@kept("quality")
@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    lut = np.full(0x110000, 9, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c == "\n":
            lut[i] = 8
        elif c.isspace():
            lut[i] = 0
        elif c.isalpha():
            lut[i] = 2 if c.isupper() else 1
        elif c.isdigit():
            lut[i] = 3
        elif c in ".,;:?'\"()-":
            lut[i] = 4
        elif c == "!":
            lut[i] = 5
        elif c == "|":
            lut[i] = 6
        elif i > 32:
            lut[i] = 7
    return lut


@kept("quality")
@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    lut = np.arange(0x110000, dtype=np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isupper():
            lut[i] = ord(c.lower()[0])
    return lut


_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))


def _hashes(points: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A hash of every run of ``inside``, in order."""
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64)
    begins = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    sizes = np.diff(begins, append=len(at))
    place = np.arange(len(at)) - np.repeat(begins, sizes)
    mixed = (points[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023]
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), begins) + sizes.astype(np.uint64)


def _flags(flags: np.ndarray, orders: int, base: int) -> list[np.ndarray]:
    out, code, size = [], np.zeros(len(flags), np.int64), 2
    for n in range(1, orders + 1):
        if len(flags) < n:
            break
        code = (code[: len(flags) - n + 1] if n > 1 else code) * 2 + flags[n - 1 :]
        out.append(code + base)
        base, size = base + size, size * 2
    return out


def _buckets(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _lexical(points: np.ndarray, letters: np.ndarray, found: np.ndarray) -> None:
    """Words, pairs of words, and runs of four letters or other characters."""
    low = _lower()[points]
    words = _hashes(low, letters)
    found[_WORD + _buckets(words, WORD_BITS)] = True
    found[_WORD + _buckets(words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1], WORD_BITS)] = True
    if len(low) >= 4:
        k = np.uint64(0x100000001B3)
        found[_LETTER + _buckets(((low[:-3] * k + low[1:-2]) * k + low[2:-1]) * k + low[3:], LETTER_BITS)] = True


def features(text: str | None) -> np.ndarray:
    """Sorted indices of the indicators that a text has."""
    if not text:
        return np.zeros(0, np.int64)
    found = np.zeros(DIM, bool)
    lut = _classes()
    for i in range(0, len(text), PIECE):
        points = np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = lut[points]
        runs = kinds[np.flatnonzero(np.diff(kinds, prepend=255))].astype(np.int64)
        code = np.zeros(len(runs), np.int64)
        for n in range(1, ORDERS + 1):
            if len(runs) < n:
                break
            code = code[: len(runs) - n + 1] * CLASSES + runs[n - 1 :]
            found[_STARTS[n - 1] + code] = True
        _lexical(points, (kinds == 1) | (kinds == 2), found)
        words = _hashes(points, (kinds != 0) & (kinds != 8))
        for lag, base in ((1, _ECHO), (2, _ECHO + 30)):
            for idx in _flags((words[lag:] == words[:-lag]).astype(np.int64), 4, base):
                found[idx] = True
        lines = _hashes(points, kinds != 8)
        for idx in _flags((lines[1:] == lines[:-1]).astype(np.int64), 3, _LINES):
            found[idx] = True
        if len(lines) > 2:
            found[_SEEN + min(5, int(6 * (1 - len(np.unique(lines)) / len(lines))))] = True
    return np.flatnonzero(found)


def labelled_features(documents: DataFrame, sample: list[tuple], spark, extract, columns: str) -> list:
    """Rows (id, label, *extract(text)) of the sampled ids, in a fixed order. An
    id's rows beyond the first, by their features, are left out: so many rows
    come to the driver as were drawn, whatever ids repeat."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    drawn = spark.createDataFrame(sample, f"k {kind}, l int")
    names = [n.split()[0] for n in columns.split(", ")]

    def run(batches):
        for batch in batches:
            for part in parts(batch, 2, 256):
                rows = [extract(t) for t in part.column(2).to_pylist()]
                lists = []
                for c in zip(*rows):
                    ends = np.cumsum([0, *map(len, c)], dtype=np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], names=["k", "l", *names])

    rows = documents.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).join(F.broadcast(drawn), "k").select("k", "l", "t")
    found = rows.mapInArrow(task("labels", run), f"k {kind}, l int, {columns}")
    got = found.groupBy("k", "l").agg(F.min(F.struct(*names)).alias("x")).select("k", "l", *[f"x.{n}" for n in names]).toArrow()
    arrays = []
    for n in names:
        c = got.column(n).combine_chunks()
        flat, ends = c.values.to_numpy(zero_copy_only=False).astype(np.int64), c.offsets.to_numpy()
        arrays.append([flat[a:b] for a, b in zip(ends, ends[1:])])
    return sorted(zip(got.column("k").to_pylist(), got.column("l").to_pylist(), *arrays), key=lambda r: (r[0], r[1]))


def shares(labels: DataFrame, label: str) -> dict[int, int]:
    kept = labels.where(learnable(F.col("doc_id")) & F.col(label).isNotNull())
    return {int(r[0]): r[1] for r in kept.groupBy(F.col(label).cast("int")).count().collect()}


def _ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    p, q = (SMOOTH + np.bincount(np.concatenate([r for r, v in zip(rows, y) if v == s] or [np.zeros(0, np.int64)]), minlength=DIM) for s in (1, 0))
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[_WORD:] *= LEXICAL
    return ratio


def _svm(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    ratio = _ratios(rows, y)
    w, b = dual_coordinate_descent(rows, [ratio[r] for r in rows], 2 * y - 1.0, DIM, COST * weight)
    return w * ratio, b


def learn(spark, documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias and the curve's two parameters."""
    count = shares(labels, "quality")
    sample = draw(labels.where(learnable(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("l")), "doc_id", "l", BUCKETS)
    rows = labelled_features(documents, [s for s in sample if s[1] in (0, 1)], spark, lambda t: (features(t),), "f array<int>") if sample else []
    y = np.array([r[1] for r in rows], np.int64)
    share = (count.get(1, 0) / sum(count.values())) if count else 0.5
    if len(set(y.tolist())) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(DIM), 0.0, 1.0, float(np.log(p / (1 - p)))
    x = [r[2] for r in rows]
    per = {c: (share if c else 1 - share) / (y == c).mean() for c in (0, 1)}
    weight = np.array([per[c] for c in y.tolist()])
    # copies share a fold: a fold is chosen by what the text looks like
    fold = np.array([(len(r[2]) * 31 + int(r[2][:50].sum())) % FOLDS for r in rows])
    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(outside) and len(set(y[inside].tolist())) == 2:
            w, b = _svm([x[i] for i in inside], y[inside], np.ones(len(inside)))
            margin[outside] = [w[x[i]].sum() + b for i in outside]
    a, c = platt(margin, y, weight)
    w, b = _svm(x, y, np.ones(len(y)))
    return w, b, a, c


def score_column(documents: DataFrame, model: tuple, text_col: str = "text", out: str = "score") -> DataFrame:
    """``documents`` with a score, replacing a column of that name."""
    passed = documents.select([f"`{c}`" for c in documents.columns if c != out])
    at = passed.columns.index(text_col)
    shipped = passed.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w, b, a, c = shipped.value
        for batch in batches:
            for part in parts(batch, at):
                margin = np.array([w[features(t)].sum() + b for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(a * margin + c, -500, 500))), pa.float64())], names=[*part.schema.names, out])

    return passed.mapInArrow(task("quality", run), T.StructType([*passed.schema.fields, T.StructField(out, T.DoubleType())]))


def op3(spark, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    scored = score_column(documents.select("doc_id", "text"), learn(spark, documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
