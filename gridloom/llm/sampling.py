"""Bounded samples of labelled rows, for fitting.

A row is drawn if it has the smallest hash in its (label, bucket) cell, so a
sample holds at most ``buckets`` rows of each label, whatever the input's size.
The cells come from one partial aggregate: no label gathers in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def fold_of(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) != 2, F.lit(False))


def draw(labelled: DataFrame, key: str, label: str, buckets: int) -> list[tuple]:
    """(key, label) of the sample, sorted; at most ``buckets`` rows a label."""
    h = F.xxhash64(F.lit(7), F.col(key))
    cells = (
        labelled.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .select(F.col(key).alias("k"), F.col(label).alias("l"), h.alias("h"))
        .groupBy("l", F.pmod("h", F.lit(buckets)).alias("cell"))
        .agg(F.min_by("k", "h").alias("k"))
    )
    return sorted({(r["k"], r["l"]) for r in cells.collect()})
