"""What functions there are: arguments, how they take arrays, how Spark runs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..kernel.library import LIBRARY
from .aggregate import AGGREGATES, ROW_AGGREGATES
from .scalar import FUNCTIONS

#: Functions whose value may change without an edit.
VOLATILE = {"TODAY", "NOW", "OFFSET", "INDIRECT", "SHEET", "SHEETS"}


def catalogue() -> list[dict]:
    """A row for each function: name, least and most arguments, mode (scalar:
    lifted over arrays; range: sees them whole; lazy: sees its arguments'
    formulas), volatile, expression (a Spark expression exists)."""
    native = set(FUNCTIONS) | set(ROW_AGGREGATES) | set(AGGREGATES)
    return [{"name": f.name, "least": f.least, "most": f.most, "mode": f.mode, "volatile": f.name in VOLATILE, "expression": f.name in native} for f in sorted(LIBRARY.values(), key=lambda f: f.name)]


def catalogue_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalogue(), "name string, least int, most int, mode string, volatile boolean, expression boolean")
