"""Cells as tables: (book, sheet, row, column, content), rows and columns from 0.

``laid_out`` turns a table's rows into cells; ``evaluated`` recalculates every
workbook of a cells table, one group a workbook, as many at once as there are
tasks; ``read_books`` and ``written`` are the JSON source and sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CELLS = "book string, sheet string, row int, column int, content string"
VALUES = "book string, sheet string, row int, column int, kind string, n double, s string, b boolean, is_formula boolean"
#: Cells that a task evaluates together.
CHUNK = 100_000
_BOOK = "book string, sheets array<struct<name:string,cells:map<string,string>>>, names array<struct<name:string,meaning:string>>"


def parsed(content: Column) -> Column:
    """What typed text stands for, as a struct (kind, n, s, b): the column form
    of ``parse_content``."""
    from ..plans.values import NUMERIC

    low, plain = F.upper(content), F.regexp_replace(F.trim(content), r"\s*%$", "").try_cast("double")
    numeric = content.rlike(NUMERIC)
    formula = content.startswith("=") & (F.length(content) > 1)
    kind = F.when(content.isNull() | (content == ""), "empty").when(formula, "formula").when(low.isin("TRUE", "FALSE"), "logical").when(numeric, "number").otherwise("text")
    n = F.when(~formula & numeric, F.when(F.trim(content).endswith("%"), plain / 100).otherwise(plain))
    return F.struct(kind.alias("kind"), n.alias("n"), F.when(kind.isin("text", "formula"), content).alias("s"), F.when(kind == "logical", low == "TRUE").alias("b"))


def laid_out(df: DataFrame, book: Column | str, row: Column | str, columns: list[str], sheet: str = "Sheet1", formulas: dict[str, str] | None = None) -> DataFrame:
    """A table's rows as cells, its columns side by side; with ``formulas``,
    further columns hold a formula filled down, "{row}" standing for the row's
    number from 1."""
    at = (F.col(row) if isinstance(row, str) else row).cast("int")
    own = [F.struct(F.lit(i).alias("column"), F.col(c).cast("string").alias("content")) for i, c in enumerate(columns)]
    made = [F.struct(F.lit(len(columns) + i).alias("column"), F.replace(F.lit(f), F.lit("{row}"), (at + 1).cast("string")).alias("content")) for i, f in enumerate((formulas or {}).values())]
    b = F.col(book) if isinstance(book, str) else book
    cells = df.select(b.cast("string").alias("book"), F.lit(sheet).alias("sheet"), at.alias("row"), F.explode(F.array(*own, *made)).alias("c"))
    return cells.select("book", "sheet", "row", "c.column", "c.content").where("content is not null")


def evaluated(cells: DataFrame, macros: dict | None = None) -> DataFrame:
    """The values of all cells, spilled ones included. Each workbook's cells come
    together; workbooks of one layout are evaluated together (``layouts``), others
    one after the other. Some CHUNK cells are held at a time, a workbook at least.
    A table as large as no workbook can be belongs in ``Table`` instead."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from gridloom.kernel.cells import Err
        from gridloom.operators.workbook import Workbook
        from gridloom.sources.layouts import Layouts

        names = VALUES.replace(",", "").split()[::2]
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.bool_()]
        layouts = Layouts(macros)

        def values(name, contents):
            book = Workbook(sorted({k[0] for k in contents}), macros)
            book.set_many(contents)
            for (s, r, c), x in sorted(book.values.items()):
                kind = "error" if isinstance(x, Err) else "logical" if isinstance(x, bool) else "text" if isinstance(x, str) else "number"
                yield name, s, r, c, kind, float(x) if kind == "number" else None, x.code if kind == "error" else x if kind == "text" else None, x if kind == "logical" else None, book.formula(s, r, c) is not None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        def coded(column):
            told = column.dictionary_encode()
            return told.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), told.dictionary.to_pylist()

        def done(chunk):
            """The values of whole workbooks, whose hashes are in order."""
            (book, books), (sheet, sheets), (content, contents) = (coded(chunk.column(k)) for k in (1, 2, 5))
            row, column = (chunk.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            order = np.lexsort((column, row, sheet, book))
            book, sheet, row, column, content = book[order], sheet[order], row[order], column[order], content[order]
            n, settled, formula = layouts.evaluate(np.cumsum(np.diff(book, prepend=book[0]) != 0), sheet, row, column, content, [sheets, contents])
            at = np.flatnonzero(settled)
            if len(at):
                told = chunk.take(pa.array(order[at]))
                none = len(at)
                yield pa.RecordBatch.from_arrays([*[told.column(k) for k in (1, 2, 3, 4)], pa.array(["number"] * none), pa.array(n[at]), pa.nulls(none, pa.string()), pa.nulls(none, pa.bool_()), pa.array(formula[at])], names=names)
            left, out = np.flatnonzero(~settled), []
            for some in np.split(left, np.flatnonzero(np.diff(book[left])) + 1) if len(left) else []:
                k = book[some[0]]
                own = {(sheets[s], r, c): contents[x] if x >= 0 else None for s, r, c, x in zip(sheet[some].tolist(), row[some].tolist(), column[some].tolist(), content[some].tolist())}
                out += values(books[k] if k >= 0 else None, own)
                if len(out) >= 10_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                chunk = pa.concat_batches(held)
                h = chunk.column(0).to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0  # the last workbook may go on
                if cut:
                    yield from done(chunk.slice(0, cut))
                held, size = [chunk.slice(cut)], 0 if not cut else size - cut
        if held:
            yield from done(pa.concat_batches(held))

    rows = cells.select(F.xxhash64("book").alias("h"), "book", "sheet", "row", "column", "content").repartition("book").sortWithinPartitions("h")
    return rows.mapInArrow(run, VALUES)


def spread(values: DataFrame, columns: dict[int, str]) -> DataFrame:
    """(book, sheet, row) with the numbers of some columns side by side."""
    picks = [F.max(F.when(F.col("column") == k, F.col("n"))).alias(name) for k, name in columns.items()]
    return values.where(F.col("column").isin(*columns)).groupBy("book", "sheet", "row").agg(*picks)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Cells of exported workbooks, one JSON object a line."""
    books = spark.read.schema(_BOOK).json(path)
    each = books.select("book", F.explode("sheets").alias("s")).select("book", F.col("s.name").alias("sheet"), F.explode("s.cells").alias("address", "content"))
    letters = F.regexp_extract("address", r"^([A-Z]+)\d+$", 1)
    number = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64)
    return each.select("book", "sheet", (F.regexp_extract("address", r"(\d+)$", 1).cast("int") - 1).alias("row"), (number - 1).alias("column"), "content")


def _letters(n: Column) -> Column:
    """Column letters, of at most three."""
    one = lambda k: F.char(k + 65)
    return F.when(n < 26, one(n)).when(n < 702, F.concat(one(F.floor(n / 26) - 1), one(n % 26))).otherwise(F.concat(one(F.floor((n - 702) / 676)), one(F.floor((n - 702) / 26) % 26), one(n % 26)))


def written(cells: DataFrame, path: str) -> None:
    """The JSON sink: a line for each workbook."""
    address = F.concat(_letters(F.col("column")), (F.col("row") + 1).cast("string"))
    sheets = cells.groupBy("book", "sheet").agg(F.map_from_entries(F.collect_list(F.struct(address.alias("k"), F.col("content").alias("v")))).alias("cells"))
    books = sheets.groupBy("book").agg(F.collect_list(F.struct(F.col("sheet").alias("name"), "cells")).alias("sheets"))
    books.write.mode("overwrite").json(path)
