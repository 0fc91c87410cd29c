"""Near-duplicate vectors by an inverted index with product quantisation.

Vectors are scaled to length 1; equal ones of a label are one class, known by a
hash of both; its smallest id only names it in the result. A coarse codebook of
about sqrt(n) centres assigns each class to one inverted list; its residual is
coded by one byte a subspace, and the residual's coding error is kept. A query
probes its nearest lists. How many is measured when the codebook is fitted: each
vector of the sample gets a partner of exactly the least cosine in a random
direction, and the probes must reach the lists of all these partners, and a
quarter more. In a list, distances are summed from a table per subspace; a
vector is a candidate unless that sum and its coding error prove it too far, so
the codes lose no link. Candidates are rescored by cosine in double precision.
Recall against brute force is measured by the tests.

A (label, list) pair of any size is dealt out in blocks of vectors and blocks of
queries of bounded size; a block pair returns the queries' link counts and a
spanning forest of the links it found, at most one row a vector.

Codebooks are fitted on a sample of classes drawn by hash: ``SAMPLE``, or
``A_LIST`` for each list, of which there are ``LISTS`` at most; these are the
documented bounds.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component, and rows whose label or id is null, link with nothing; their
component is their own id. Vectors of unequal lengths don't link. Rows that
repeat an id count as vectors each. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .scratch import Scratch

COSINE = 0.93
LISTS, SUBSPACES, CODES = 4096, 8, 32
SAMPLE, A_LIST = 8192, 16
BLOCK, QUERIES = 4096, 8192
SLACK = 1e-6


def radius(cosine: float = COSINE) -> float:
    return float(np.sqrt(2 - 2 * cosine)) + SLACK


def _unit(vectors: list) -> list[np.ndarray | None]:
    out = []
    for v in vectors:
        if v is None or len(v) == 0 or any(x is None for x in v):
            out.append(None)
            continue
        x = np.asarray(v, np.float64)
        size = np.abs(x).max()
        if not np.isfinite(size) or size == 0:
            out.append(None)
            continue
        x = x / size
        out.append(x / np.sqrt(x @ x))
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = (centres**2).sum(1)
    return np.concatenate([(size - 2 * x[i : i + 4096] @ centres.T).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def _kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    random = np.random.default_rng(seed)
    centres = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        order = np.argsort(own, kind="stable")
        found, first = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], first, axis=0)
        centres[found] = sums / np.diff(first, append=len(x))[:, None]
    return centres


class Index:
    """Coarse centres and residual codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int = 1, cosine: float = COSINE):
        self.dim = sample.shape[1]
        self.centres = _kmeans(sample, max(1, min(lists, len(sample) // 8)))
        self.probed = self._measured(sample[:SAMPLE], cosine)
        residual = sample - self.centres[self.lists(sample)]
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        self.books = [_kmeans(residual[:, a:b], min(CODES, len(sample))) for a, b in zip(self.cuts, self.cuts[1:])]

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centres)

    def _measured(self, x: np.ndarray, cosine: float) -> int:
        """Lists to probe: up to the farthest in which a partner was found."""
        away = np.random.default_rng(11).normal(size=x.shape)
        away -= (away * x).sum(1)[:, None] * x
        size = np.linalg.norm(away, axis=1)
        away /= np.where(size > 0, size, 1)[:, None]
        partner, own, worst = cosine * x + np.sqrt(max(0.0, 1 - cosine * cosine)) * away, self.lists(x), 0
        for i in range(0, len(x), 1024):
            square = (self.centres**2).sum(1) - 2 * partner[i : i + 1024] @ self.centres.T
            at = own[i : i + 1024]
            worst = max(worst, int((square < square[np.arange(len(at)), at][:, None]).sum(1).max()))
        return min(len(self.centres), int(np.ceil(1.25 * (worst + 1))) + 1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """Which lists each row asks: its nearest."""
        square = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        out = np.zeros(square.shape, bool)
        if self.probed >= len(self.centres):
            return ~out
        np.put_along_axis(out, np.argpartition(square, self.probed - 1, axis=1)[:, : self.probed], True, axis=1)
        return out

    def coded(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One byte a subspace, and the length of the coding error."""
        residual = x - self.centres[own]
        codes, left = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            square = ((residual[:, None, a:b] - self.books[k][None]) ** 2).sum(2)
            codes[:, k] = square.argmin(1)
            left += square.min(1)
        return codes, np.sqrt(left)

    def distances(self, query: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to a list's coded vectors."""
        residual = query - self.centres[place]
        total = np.zeros((len(query), len(codes)))
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            table = ((residual[:, None, a:b] - self.books[k][None]) ** 2).sum(2)
            total += table[:, codes[:, k]]
        return np.sqrt(total)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) -> as many links at most as nodes, with the same components."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def op6(spark: SparkSession, embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``."""
    scratch = Scratch(spark, "pq")
    label = embeddings.schema["label"].dataType.simpleString()
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("v"))

    def key(batches):
        for batch in batches:
            units = _unit(batch.column(2).to_pylist())
            keys = [None if u is None else hashlib.blake2b(np.round(u, 12).tobytes(), digest_size=16).digest() for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array([None if u is None else u.tolist() for u in units], pa.list_(pa.float64()))], names=["vec_id", "label", "key", "u"])

    keyed = scratch.keep(rows.mapInArrow(key, f"vec_id long, label {label}, key binary, u array<double>"), "keyed")
    good = F.expr("key is not null and label is not null and vec_id is not null")
    narrow = keyed.select("vec_id", "label", "key")
    classes = narrow.where(good).groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.withColumn("cid", F.md5(F.concat(F.col("label").cast("string"), F.lit("|"), F.hex("key"))))
    vectors = keyed.where(good).select("vec_id", "label", "key", "u").join(classes, ["label", "key"]).where("vec_id = rep").dropDuplicates(["label", "key"]).select("label", "key", "cid", "rep", "copies", "u")
    vectors = scratch.keep(vectors, "vectors")

    lists = max(1, min(LISTS, round(vectors.count() ** 0.5)))
    sample = vectors.select("rep", "cid", "u").orderBy(F.xxhash64("rep"), "rep", "cid").limit(max(SAMPLE, A_LIST * lists)).collect()
    fitted: dict[int, list] = {}
    for r in sample:
        fitted.setdefault(len(r["u"]), []).append(r["u"])
    index = spark.sparkContext.broadcast({d: Index(np.array(v), lists, cosine) for d, v in fitted.items()})
    reach = radius(cosine)

    def groups(batch):
        """(dimension's index, positions, vectors) of a batch's rows."""
        us = batch.column("u").to_pylist()
        sizes = np.array([len(u) for u in us])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            x = np.array([us[i] for i in at])
            # a length that the sample lacks has one list, with no code
            yield index.value.get(int(d)) or Index(x[:1], 1, cosine), at, x

    def store(batches):
        for batch in batches:
            for ix, at, x in groups(batch):
                own = ix.lists(x)
                codes, error = ix.coded(x, own)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(np.full(len(at), ix.dim), pa.int32()), pa.array(own, pa.int32()), part.column("cid"), part.column("rep"), part.column("copies"), part.column("u"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64())],
                    names=["label", "dim", "list", "cid", "rep", "copies", "u", "codes", "error"],
                )

    def ask(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                for ix, at, x in groups(part):
                    who, where = np.nonzero(ix.probes(x))
                    got = part.take(pa.array(at[who]))
                    yield pa.RecordBatch.from_arrays([got.column("label"), pa.array(np.full(len(who), ix.dim), pa.int32()), pa.array(where, pa.int32()), got.column("cid"), got.column("rep"), got.column("u")], names=["label", "dim", "list", "cid", "rep", "u"])

    place = ["label", "dim", "list"]
    base = vectors.select("label", "cid", "rep", "copies", "u")
    stored = base.mapInArrow(store, f"label {label}, dim int, list int, cid string, rep long, copies long, u array<double>, codes binary, error double")
    asked = base.select("label", "cid", "rep", "u").mapInArrow(ask, f"label {label}, dim int, list int, cid string, rep long, u array<double>")
    blocks = stored.groupBy(place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    queries = asked.groupBy(place).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("nq"))
    sizes = scratch.keep(blocks.join(queries, place), "sizes")
    stored = stored.join(sizes, place).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    asked = asked.join(sizes, place).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "cid"), F.col("nq")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    deal = [*place, "block", "part"]
    stored, asked = (df.drop("nb", "nq").select([F.col(c).alias(c) for c in df.columns if c not in ("nb", "nq")]) for df in (stored, asked))

    def compare(q: pa.Table, s: pa.Table) -> pa.Table:
        counts, edges = {}, ([], [])
        # the classes of both sides, by their place among them
        cids, first, at = np.unique([*q.column("cid").to_pylist(), *s.column("cid").to_pylist()], return_index=True, return_inverse=True)
        reps = np.concatenate([t.column("rep").to_numpy() for t in (q, s)])[first].tolist()
        xr, yr = at[: q.num_rows], at[q.num_rows :]
        if q.num_rows and s.num_rows:
            x, y = (np.array(t.column("u").to_pylist()) for t in (q, s))
            copies, error = s.column("copies").to_numpy(), s.column("error").to_numpy()
            ix = index.value.get(x.shape[1])
            codes = np.array([np.frombuffer(c, np.uint8) for c in s.column("codes").to_pylist()])
            place = s.column("list")[0].as_py()
            for i in range(0, len(x), 256):
                if ix is None:
                    a, b = (m.ravel() for m in np.indices((len(x[i : i + 256]), len(y))))
                else:
                    a, b = np.nonzero(ix.distances(x[i : i + 256], place, codes) - error <= reach)
                cos = np.concatenate([np.einsum("ij,ij->i", x[i + a[k : k + 65536]], y[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
                hit = (cos >= cosine) & (xr[i + a] != yr[b])
                a, b = xr[i + a[hit]], yr[b[hit]]
                who, pos = np.unique(a, return_inverse=True)
                for w, c in zip(who.tolist(), np.bincount(pos, _copies(yr, copies, b)).tolist()):
                    counts[w] = counts.get(w, 0) + int(c)
                if len(a):
                    u, v = _forest(a, b)
                    edges[0].append(u)
                    edges[1].append(v)
        u, v = _forest(np.concatenate(edges[0]), np.concatenate(edges[1])) if edges[0] else (np.zeros(0, np.int64),) * 2
        n = len(counts)
        a, b = [*counts, *u.tolist()], v.tolist()
        return pa.table({"a": pa.array([cids[i] for i in a], pa.string()), "a_rep": pa.array([reps[i] for i in a], pa.int64()), "b": pa.array([None] * n + [cids[i] for i in b], pa.string()), "b_rep": pa.array([None] * n + [reps[i] for i in b], pa.int64()), "n": pa.array([*counts.values(), *[0] * len(u)], pa.int64())})

    found = scratch.keep(asked.groupBy(deal).cogroup(stored.groupBy(deal)).applyInArrow(compare, "a string, a_rep long, b string, b_rep long, n long"), "found")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    # nodes in the order of their ids, so that a component has its smallest
    node = lambda c: F.struct(F.col(f"{c}_rep").alias("rep"), F.col(c).alias("cid")).alias(c)
    parts = connected_components(found.where("b is not null").select(node("a"), node("b")), scratch).select(F.col("node.cid").alias("cid"), F.col("component.rep").alias("component"))
    told = (
        vectors.select("label", "key", "cid", "rep", "copies")
        .join(counts.withColumnRenamed("a", "cid"), "cid", "left")
        .join(parts, "cid", "left")
        .select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = narrow.where(good).join(told, ["label", "key"]).select("vec_id", "n_links", "component_id")
    alone = narrow.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _copies(ids: np.ndarray, copies: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(ids)
    return copies[order[np.searchsorted(ids, wanted, sorter=order)]]
