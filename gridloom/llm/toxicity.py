"""Counterfactual-regularised toxicity classifier.

A sparse logistic model on indicators of words, of any length, and of their
beginnings (``SHORTEST`` to ``LONGEST`` letters), hashed into 2^``BITS``. Of every
labelled text that names a group, a counterfactual is made by swapping each
identity term for another of its set; the loss adds a penalty on the squared
change of the score's logit, so what the groups' names weigh goes to what the
swap leaves. Terms that no labelled text has get no weight at all. So a neutral
mention of a group doesn't raise the score.

The fit reads at most ``BUCKETS`` rows of each label (the documented bound),
drawn by hash from all labelled rows that aren't held out, weighted back to the
labels' true shares; scoring reads every whole text.

Defined results: as in ``quality``: null texts count as empty; without labels
of both kinds every score is the share of label 1 (0.5 without any); rows with
null ids and repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .linear import platt
from .quality import labelled_features, shares
from .sampling import draw, held_out, learnable
from .workers import kept, parts, task

BUCKETS = 2048
THRESHOLD = 0.3
BITS = 20
SHORTEST, LONGEST = 4, 12
#: An indicator is fitted if its shares in the two labels differ by so many
#: standard errors; the L1 weight falls with the sample, as a weight's noise does.
TELLS = 1.0
L1, COUNTERFACTUAL, STEPS = 0.6, 0.5, 150

# Identity terms; a swap takes the next of the same line.
IDENTITY = [
    "women men", "woman man", "girls boys", "girl boy", "female male", "mother father", "wife husband",
    "muslim christian jewish hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian latino arab african european american", "blacks whites asians latinos arabs africans europeans americans",
    "gay straight lesbian bisexual transgender queer", "gays lesbians heterosexuals", "disabled blind deaf autistic",
    "immigrants refugees natives foreigners", "old young elderly", "mexican chinese indian russian turkish german french spanish",
    "frauen männer", "frau mann", "mädchen jungen", "muslime christen juden", "schwarze weiße", "ausländer flüchtlinge", "schwule lesben",
    "femmes hommes", "femme homme", "filles garçons", "musulmans chrétiens juifs", "noirs blancs arabes", "étrangers réfugiés", "homosexuels hétérosexuels",
    "mujeres hombres", "mujer hombre", "niñas niños", "musulmanes cristianos judíos", "negros blancos árabes", "extranjeros refugiados", "homosexuales heterosexuales",
]
SWAP = {a: b for line in IDENTITY for a, b in zip(line.split(), line.split()[1:] + line.split()[:1])}
_TERM = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(SWAP, key=len, reverse=True)) + r")(?![^\W\d_])", re.I)


def counterfactual(text: str) -> str:
    """The text with its identity terms swapped."""
    return _TERM.sub(lambda m: SWAP[m[0].lower()], text)


_POWERS = np.cumprod(np.full(1024, 0x100000001B3, np.uint64))


@kept("toxicity")
@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    lut = np.zeros(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            lut[i] = ord(c.lower()[0])
    return lut


def _indices(text: str | None) -> np.ndarray:
    """Indicator numbers of a text, with repeats."""
    if not text:
        return np.zeros(0, np.int64)
    letters = _lower()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    at = np.flatnonzero(letters)
    if not len(at):
        return np.zeros(0, np.int64)
    first = np.diff(at, prepend=-2) > 1
    begins = at[first]
    sizes = np.diff(np.flatnonzero(first), append=len(at))
    h, out = np.zeros(len(begins), np.uint64), []

    def mixed(h, k):
        x = (h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)

    place = np.arange(len(at)) - np.repeat(np.flatnonzero(first), sizes)
    # beyond 1024 letters of a word the powers repeat, with the round added in
    whole = np.add.reduceat((letters[at] + (place >> 10).astype(np.uint64)) * _POWERS[place & 1023], np.flatnonzero(first))
    out.append(mixed(whole, 100))
    for k in range(1, LONGEST + 1):
        here = sizes >= k
        begins, sizes, h = begins[here], sizes[here], h[here]
        if not len(begins):
            break
        h = h * np.uint64(0x100000001B3) + letters[begins + (k - 1)]
        if k >= SHORTEST:
            out.append(mixed(h, k))
    return np.concatenate(out)


def features(text: str | None) -> np.ndarray:
    return np.unique(_indices(text))


def _pair(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of a text, and of its counterfactual if that differs."""
    swapped = counterfactual(text) if text else text
    return features(text), features(swapped) if swapped != text else np.zeros(0, np.int64)


class _Rows:
    """Indicator rows as a sparse matrix."""

    def __init__(self, rows: list[np.ndarray], dim: int):
        self.dim, self.n = dim, len(rows)
        self.cols = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, w[self.cols], self.n)

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, v[self.rows], self.dim)


def fit(x: list[np.ndarray], swapped: list[np.ndarray], y: np.ndarray, weight: np.ndarray, dim: int) -> tuple[np.ndarray, float]:
    """Proximal gradient descent with momentum on the weighted logistic loss, the
    counterfactual penalty and an L1 term. swapped: empty where nothing swaps."""
    matrix, weight = _Rows(x, dim), weight / weight.sum()
    pairs = [i for i, s in enumerate(swapped) if len(s)]
    real, other = _Rows([x[i] for i in pairs], dim), _Rows([swapped[i] for i in pairs], dim)
    share = weight[pairs]
    # largest curvature, by power iteration
    v = np.ones(dim)
    for _ in range(12):
        u = v
        v = matrix.back(0.25 * weight * matrix.times(u))
        if pairs:
            d = 2 * COUNTERFACTUAL * share * (real.times(u) - other.times(u))
            v += real.back(d) - other.back(d)
        size = np.linalg.norm(v)
        v /= max(size, 1e-12)
    rate = 1.0 / (1.2 * size + 0.3)
    w, b = np.zeros(dim), float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    z, zb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        r = weight * (1 / (1 + np.exp(-np.clip(matrix.times(z) + zb, -30, 30))) - y)
        g = matrix.back(r)
        if pairs:
            d = 2 * COUNTERFACTUAL * share * (real.times(z) - other.times(z))
            g += real.back(d) - other.back(d)
        new = z - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * L1 / len(y), 0)
        new_b = zb - rate * r.sum()
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, zb = new + (old - 1) / t * (new - w), new_b + (old - 1) / t * (new_b - b)
        w, b = new, new_b
    return w, b


def learn(spark, documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """Weights of all indicators, bias, and the score curve's two parameters."""
    count = shares(labels, "toxic")
    sample = draw(labels.where(learnable(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("l")), "doc_id", "l", BUCKETS)
    rows = labelled_features(documents, [s for s in sample if s[1] in (0, 1)], spark, _pair, "f array<int>, g array<int>") if sample else []
    y = np.array([r[1] for r in rows], np.int64)
    share = (count.get(1, 0) / sum(count.values())) if count else 0.5
    if len(set(y.tolist())) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(p / (1 - p)))
    x, swapped = [r[2] for r in rows], [r[3] for r in rows]
    # the indicators that tell the labels apart best
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    a, c = (np.bincount(np.concatenate([r for r, v in zip(x, y) if v == s]), minlength=1 << BITS) for s in (1, 0))
    p, q = (a + 0.5) / (n1 + 1), (c + 0.5) / (n0 + 1)
    worth = np.where(a + c >= 3, np.abs(p - q) / np.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0 + 1e-9), 0)
    chosen = np.flatnonzero(worth >= TELLS)
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    x, swapped = ([place[r][place[r] >= 0] for r in rows_] for rows_ in (x, swapped))
    per = {v: (share if v else 1 - share) / (y == v).mean() for v in (0, 1)}
    weight = np.array([per[v] for v in y.tolist()])
    margin, fold = np.zeros(len(y)), np.array([(len(r[2]) * 31 + int(r[2][:50].sum())) % 2 for r in rows])
    for k in (0, 1):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(outside) and len(set(y[inside].tolist())) == 2:
            w, b = fit([x[i] for i in inside], [swapped[i] for i in inside], y[inside], weight[inside], len(chosen))
            margin[outside] = [w[x[i]].sum() + b for i in outside]
    slope, shift = platt(margin, y, weight)
    w, b = fit(x, swapped, y, weight, len(chosen))
    full = np.zeros(1 << BITS, np.float32)
    full[chosen] = w
    return full, b, slope, shift


def op8(spark, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``documents``."""
    full, b, slope, shift = learn(spark, documents, labels)
    used = np.flatnonzero(full)
    shipped = spark.sparkContext.broadcast((used, full[used].astype(np.float64), b, slope, shift))

    def run(batches):
        used, values, b, slope, shift = shipped.value
        w = np.zeros(1 << BITS)
        w[used] = values
        some = np.zeros(1 << BITS, bool)
        some[used] = True
        for batch in batches:
            for part in parts(batch, 1):
                margin = np.zeros(part.num_rows)
                for k, text in enumerate(part.column(1).to_pylist()):
                    idx = _indices(text)
                    margin[k] = w[np.unique(idx[some[idx]])].sum() + b
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(slope * margin + shift, -500, 500))))], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(task("toxicity", run), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
