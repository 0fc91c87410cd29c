"""Formulas over streams: calculated columns as on tables, measures over windows
of event time. Late rows are taken up to the watermark; state older than that is
dropped by Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.table import Table


def columns(stream: DataFrame, formulas: dict[str, str], **options) -> DataFrame:
    """Formulas filled down, row by row: nothing is kept between batches."""
    return Table(stream, **options).columns(formulas).df


def windowed(stream: DataFrame, time: str, width: str, formulas: dict[str, str], by: list[str] | None = None, late: str = "10 minutes", slide: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Measures for each window of event time and group."""
    framed = stream.withWatermark(time, late).withColumn("window", F.window(time, width, slide) if slide else F.window(time, width))
    return Table(framed, names=names).measures(formulas, ["window", *(by or [])])


def kept_current(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Edits as they come, batch by batch: ``merge`` gets each batch's last
    content of each cell (book, sheet, row, column, content, at)."""
    cell = ["book", "sheet", "row", "column"]

    def batch(df: DataFrame, number: int) -> None:
        merge(df.groupBy(*cell).agg(F.max_by("content", "at").alias("content")), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
