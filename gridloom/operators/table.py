"""A DataFrame as a sheet: formula columns, measures, and relational formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.compile import Compiler, MeasureCompiler, columns_of
from ..plans.values import Value

#: Rows for each range bucket of a global order, and most buckets.
BUCKET_ROWS, BUCKETS = 250_000, 4096
#: Groups up to which a table of one row a group is broadcast, after a count.
FEW_GROUPS = 100_000


def order_number(c: Column, kind: str) -> Column:
    """A double that follows a column's order, as far as a double can; texts
    count without case, by their first bytes."""
    if kind == "string":
        head = F.rpad(F.substring(F.lower(c).cast("binary"), 1, 6), 6, F.lit(b"\0"))
        return F.conv(F.hex(head), 16, 10).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def range_bounds(df: DataFrame, key: str) -> list[float]:
    """Bounds of buckets of about equal size, from a quantile sketch."""
    rows = df.count()
    n = max(8, min(BUCKETS, rows // BUCKET_ROWS + 1))
    return sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], max(1e-4, 0.2 / n)))) if rows else []


def with_bucket(df: DataFrame, key: str, bounds: list[float], name: str = "_b") -> DataFrame:
    """A bucket number, monotonic in a double key: equal keys share one, nulls
    have one of their own. A global window becomes one for each bucket, with what
    a bucket hands on carried by a table of one row a bucket."""
    from pyspark.ml.feature import Bucketizer

    if not bounds:
        return df.withColumn(name, F.lit(0))
    splits = [-float("inf"), *bounds, float("inf")]
    return Bucketizer(splits=splits, inputCol=key, outputCol=name, handleInvalid="keep").transform(df).withColumn(name, F.col(name).cast("int"))


def _before(per_bucket: DataFrame, value: str, name: str) -> DataFrame:
    """(_b, name): the sum of a value over the buckets before."""
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    return F.broadcast(per_bucket.select("_b", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(name)))


class Table:
    """order: columns that make the row order unique, where formulas need one."""

    def __init__(self, df: DataFrame, order: list[str] | None = None, names: dict[str, str] | None = None, macros: dict | None = None, precision: str = "fast"):
        self.df, self.order, self.names, self.macros, self.precision = df, order or [], names or {}, macros or {}, precision

    def _with(self, df: DataFrame) -> Table:
        return Table(df, self.order, self.names, self.macros, self.precision)

    def value(self, formula: str) -> Value:
        return Compiler(columns_of(self.df), self.names, self.macros, self.precision, self.order).formula(formula)

    def columns(self, formulas: dict[str, str], errors: bool = False) -> Table:
        """Formulas filled down; with errors, each adds a column <name>_error."""
        made = {}
        for name, source in formulas.items():
            v = self.value(source)
            made[name] = v.col
            if errors:
                made[f"{name}_error"] = v.err if v.err is not None else F.lit(None).cast("string")
        return self._with(self.df.withColumns(made))

    def measures(self, formulas: dict[str, str], by: list[str] | None = None, errors: bool = False) -> DataFrame:
        """Formulas over whole columns, for each group, in one aggregation (MODE
        and AVEDEV have one before it); with errors, each adds a column
        <name>_error."""
        sides = None if self.df.isStreaming else []
        compiler = MeasureCompiler(columns_of(self.df), self.names, self.macros, self.precision, self.order, sides=sides)
        made = []
        for name, source in formulas.items():
            v = compiler.formula(source)
            made.append(v.col.alias(name))
            if errors:
                made.append((v.err if v.err is not None else F.lit(None).cast("string")).alias(f"{name}_error"))
        rows = self.df
        for side in sides or []:
            rows = self._beside(rows, side.table(self.df, by or [], self.order), by or [])
        return rows.groupBy(*(by or [])).agg(*made)

    @staticmethod
    def _beside(rows: DataFrame, table: DataFrame, by: list[str]) -> DataFrame:
        """Rows with the further columns of a table of one row a group; of few
        groups it is broadcast, so that rows of a large group stay where they are."""
        if not by:
            return rows.crossJoin(F.broadcast(table))
        table = table.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
        few = table.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
        same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
        return rows.join(F.broadcast(table) if few else table, same, "left").drop(*[f"_by{i}" for i in range(len(by))])

    def select(self, *columns: str) -> DataFrame:
        return self.df.select(*columns)

    # FILTER, SORT, SORTBY, UNIQUE
    def filter(self, include: str) -> Table:
        v = self.value(include)
        return self._with(self.df.where(F.coalesce(v.col if v.kind == "b" else v.col != 0, F.lit(False))))

    def top(self, column: str, k: int, largest: bool = True) -> DataFrame:
        """LARGE / SMALL / INDEX(SORT(...), k): the first k rows of an order."""
        c = F.col(column)
        return self.df.orderBy(c.desc() if largest else c.asc(), *self.order).limit(k)

    def nth(self, column: str, k: int, by: list[str], largest: bool = True) -> DataFrame:
        """LARGE / SMALL of each group: rows of rank k and before are all that is
        shuffled."""
        c = F.col(column)
        w = Window.partitionBy(*by).orderBy(c.desc() if largest else c.asc(), *self.order)
        return self.df.where(c.isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).where(F.col("_r") == k).select(*by, column)

    def _sort_keys(self, keys: list[tuple[str, bool]]) -> list[Column]:
        """Sort columns, texts without case."""
        kinds = dict(self.df.dtypes)
        cols = [F.lower(F.col(c)) if kinds[c] == "string" else F.col(c) for c, _ in keys]
        return [c.asc() if up else c.desc() for c, (_, up) in zip(cols, keys)]

    def _global(self, key: str, up: bool) -> DataFrame:
        """The rows with the bucket _b of a global order."""
        number = order_number(F.col(key), dict(self.df.dtypes)[key])
        keyed = self.df.withColumn("_k", number if up else -number)
        return with_bucket(keyed, "_k", range_bounds(keyed, "_k"))

    def ordered(self, name: str, keys: list[tuple[str, bool]], by: list[str] | None = None) -> Table:
        """SORTBY: the place of each row, within its group; without groups range
        buckets of the first key are numbered each from the rows before."""
        order = [*self._sort_keys(keys), *self.order]
        if by:
            return self._with(self.df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")))
        rows = self._global(*keys[0])
        rows = rows.withColumn("_b", F.when(F.col("_k").isNull(), -1 if keys[0][1] else 1 << 20).otherwise(F.col("_b")))  # as Spark sorts nulls
        starts = _before(rows.groupBy("_b").agg(F.count("*").alias("_n")), "_n", "_o")
        place = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) + F.col("_o")
        return self._with(rows.join(starts, "_b").select(*self.df.columns, place.cast("long").alias(name)))

    def unique(self, column: str, once: bool = False) -> DataFrame:
        """UNIQUE: texts without case, each as it comes first; once: those that occur once."""
        kind = dict(self.df.dtypes)[column]
        key = F.lower(F.col(column)) if kind == "string" else F.col(column)
        got = self.df.groupBy(key.alias("_k")).agg(F.min_by(column, F.struct(*self.order)).alias(column), F.count("*").alias("_n"))
        return (got.where("_n = 1") if once else got).select(column)

    # lookups
    def _key(self, column: str) -> Column:
        """A lookup key: texts are equal without case."""
        return F.lower(F.col(column)) if dict(self.df.dtypes)[column] == "string" else F.col(column)

    def lookup(self, key: str, other: Table, other_key: str, returned: dict[str, str], last: bool = False) -> Table:
        """VLOOKUP exact, XLOOKUP, INDEX/MATCH: the first (or last) row with the key."""
        pick = F.max_by if last else F.min_by
        one = other.df.groupBy(other._key(other_key).alias("_key")).agg(*[pick(c, F.struct(*other.order)).alias(returned[c]) for c in returned])
        return self._with(self.df.join(one, self._key(key) == F.col("_key"), "left").drop("_key"))

    def missing(self, key: str, other: Table, other_key: str) -> Table:
        """ISNA(MATCH(...)): rows whose key the other table lacks."""
        return self._with(self.df.join(other.df.select(other._key(other_key).alias("_key")), self._key(key) == F.col("_key"), "left_anti"))

    def matched(self, key: str, other: Table, other_key: str) -> Table:
        return self._with(self.df.join(other.df.select(other._key(other_key).alias("_key")), self._key(key) == F.col("_key"), "left_semi"))

    def lookup_pattern(self, key: str, other: Table, other_key: str, returned: str, name: str, most: int = 100_000) -> Table:
        """XLOOKUP mode 2: the first row of the other table whose key the own
        column's pattern (* ? ~) takes. No join key can hold a pattern, so the
        other table is broadcast; of more rows than ``most`` that is refused."""
        if other.df.limit(most + 1).count() > most:
            raise ValueError("a table to be searched by patterns must be small enough to broadcast")
        c = F.col(key)
        for mark, kept in (("~~", "\x03"), ("~*", "\x01"), ("~?", "\x02")):
            c = F.replace(c, F.lit(mark), F.lit(kept))
        c = F.regexp_replace(c, r"([\\^$.|+()\[\]{}])", r"\\$1")
        for mark, meant in (("?", "."), ("*", ".*"), ("\x01", r"\*"), ("\x02", r"\?"), ("\x03", "~")):
            c = F.replace(c, F.lit(mark), F.lit(meant))
        patterns = self.df.select(F.col(key).alias("_key"), F.concat(F.lit("(?is)^"), c, F.lit("$")).alias("_p")).distinct()
        rows = other.df.select(F.col(other_key).alias("_o"), F.col(returned).alias("_v"), F.struct(*other.order).alias("_at"))
        found = patterns.join(F.broadcast(rows), F.expr("_o rlike _p")).groupBy("_key").agg(F.min_by("_v", "_at").alias(name))
        return self._with(self.df.join(found, F.col(key) == F.col("_key"), "left").drop("_key"))

    def lookup_near(self, key: str, other: Table, other_key: str, returned: str, name: str, larger: bool = False) -> Table:
        """VLOOKUP approximate, MATCH 1 / XMATCH -1 (or with larger XMATCH 1): the
        nearest key at or below (above). Both sides are laid in one order; each
        range bucket is a window of its own, and the last value of the buckets
        before it is handed on by a table of one row a bucket."""
        sign = -1.0 if larger else 1.0
        k = F.col(other_key).cast("double") * sign
        right = other.df.where(F.col(other_key).isNotNull()).groupBy(k.alias("_k")).agg((F.min_by if larger else F.max_by)(returned, F.struct(*other.order)).alias("_v"))
        left = self.df.withColumn("_k", F.col(key).cast("double") * sign)
        bounds = range_bounds(right, "_k")
        rows = left.select("*", F.lit(None).cast(right.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_side"))
        marks = right.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.df.schema.fields], "_k", "_v", F.lit(0).alias("_side"))
        both = with_bucket(rows.unionByName(marks), "_k", bounds)
        ends = with_bucket(right, "_k", bounds).groupBy("_b").agg(F.max_by("_v", "_k").alias("_e"))
        before = Window.orderBy("_t", "_after")  # a row or two for each bucket
        handed = (
            ends.select(F.col("_b").alias("_t"), F.lit(1).alias("_after"), "_e")
            .union(ends.sparkSession.range(len(bounds) + 2).select(F.col("id").cast("int").alias("_t"), F.lit(0).alias("_after"), F.lit(None).cast(right.schema["_v"].dataType)))
            .withColumn("_h", F.last("_e", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)))
            .where("_after = 0")
            .select(F.col("_t").alias("_b"), "_h")
        )
        w = Window.partitionBy("_b").orderBy("_k", "_side").rowsBetween(Window.unboundedPreceding, 0)
        got = both.withColumn("_got", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
        out = got.join(F.broadcast(handed), "_b", "left")
        value = F.when(F.col("_k").isNotNull(), F.coalesce("_got", "_h"))
        return self._with(out.select(*self.df.columns, value.alias(name)))

    # windows
    def rank(self, name: str, column: str, ascending: bool = False, by: list[str] | None = None) -> Table:
        """RANK filled down. Without groups each range bucket ranks its own rows,
        from the number of rows in the buckets before."""
        c = F.col(column)
        order = c.asc() if ascending else c.desc()
        if by:
            got = F.rank().over(Window.partitionBy(*by).orderBy(order))
            return self._with(self.df.withColumn(name, F.when(c.isNotNull(), got).cast("long")))
        rows = self._global(column, ascending)
        starts = _before(rows.where(c.isNotNull()).groupBy("_b").agg(F.count("*").alias("_n")), "_n", "_o")
        place = F.when(c.isNotNull(), F.rank().over(Window.partitionBy("_b").orderBy(order)) + F.col("_o"))
        return self._with(rows.join(starts, "_b", "left").select(*self.df.columns, place.cast("long").alias(name)))

    def running(self, name: str, column: str, order: str, by: list[str] | None = None) -> Table:
        """SUM of an expanding range ($A$1:A3): cumulative sums. Without groups
        each range bucket is summed by itself and starts from the buckets before."""
        rest = [c for c in self.order if c != order]
        if by:
            w = Window.partitionBy(*by).orderBy(order, *rest).rowsBetween(Window.unboundedPreceding, 0)
            return self._with(self.df.withColumn(name, F.sum(column).over(w)))
        rows = self._global(order, True)
        rows = rows.withColumn("_b", F.when(F.col("_k").isNull(), -1).otherwise(F.col("_b")))
        starts = _before(rows.groupBy("_b").agg(F.sum(column).alias("_s")), "_s", "_o")
        w = Window.partitionBy("_b").orderBy(order, *rest).rowsBetween(Window.unboundedPreceding, 0)
        return self._with(rows.join(starts, "_b").withColumn(name, F.sum(column).over(w) + F.col("_o")).select(*self.df.columns, name))

    def compared(self, name: str, function: str, column: str, key: str, op: str, by: list[str] | None = None) -> Table:
        """SUMIF or COUNTIF whose criterion compares the key with the row's own
        (">"&[key]), filled down: sums over the ordered keys, ties included, and
        what they leave of the whole."""
        value = F.col(column).cast("double") if function == "SUM" else F.when(F.col(key).isNotNull(), 1.0)
        up = op in ("<=", ">")
        order = F.col(key).asc() if up else F.col(key).desc()
        rows = self.df.withColumn("_x", F.when(F.col(key).isNotNull(), value))
        if by:
            group, start = list(by), F.lit(0.0)
            total = F.sum("_x").over(Window.partitionBy(*by))
        else:
            rows = Table(rows)._global(key, up)
            sums = rows.groupBy("_b").agg(F.sum("_x").alias("_s"))
            rows = rows.join(_before(sums, "_s", "_o"), "_b").crossJoin(F.broadcast(sums.agg(F.sum("_s").alias("_all"))))
            group, start, total = ["_b"], F.col("_o"), F.col("_all")
        w = Window.partitionBy(*group).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        upto = F.coalesce(F.sum("_x").over(w), F.lit(0.0)) + start
        got = upto if op in ("<=", ">=") else F.coalesce(total, F.lit(0.0)) - upto
        return self._with(rows.select(*self.df.columns, F.when(F.col(key).isNotNull(), got).otherwise(0.0).alias(name)))

    def moving(self, name: str, function: str, column: str, first: int, last: int, by: list[str]) -> Table:
        """A relative range or OFFSET window filled down, e.g. rows -2 to 0."""
        w = Window.partitionBy(*by).orderBy(*self.order).rowsBetween(first, last)
        return self._with(self.df.withColumn(name, getattr(F, {"SUM": "sum", "AVERAGE": "avg", "MAX": "max", "MIN": "min", "COUNT": "count"}[function])(column).over(w)))

    def shifted(self, name: str, column: str, rows: int, by: list[str]) -> Table:
        """A relative reference to another row."""
        w = Window.partitionBy(*by).orderBy(*self.order)
        return self._with(self.df.withColumn(name, F.lag(column, -rows).over(w)))

    def split(self, column: str, delimiter: str, name: str = "part") -> DataFrame:
        """TEXTSPLIT into rows."""
        import re

        return self.df.select("*", F.posexplode(F.split(column, re.escape(delimiter))).alias("part_no", name))

    def with_group(self, formulas: dict[str, str], by: list[str]) -> Table:
        """SUMIFS with the row's own keys as criteria, filled down: one
        aggregation for each group, joined back."""
        return self._with(self.df.join(self.measures(formulas, by), by, "left"))


def sequence(spark, rows: int, start: float = 1, step: float = 1) -> DataFrame:
    """SEQUENCE; start and step are cut to whole numbers."""
    return spark.range(rows).select(F.col("id").alias("row"), (F.lit(int(start)) + F.col("id") * int(step)).alias("value"))
