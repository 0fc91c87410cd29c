"""Functions over ranges: name -> builder of an aggregate Column.

A range argument arrives as a row-wise value; blanks, texts and logicals are
skipped by the numeric functions. Constant arguments of the formula arrive as
numbers and count once, not once a row. Each builder yields a value over the
group, so any number of measures share one partial and one final aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.values import Value, criterion, error_if, guarded

AGGREGATES: dict[str, object] = {}


def nums(v: Value) -> Column:
    return v.col.cast("double") if v.kind == "n" else F.lit(None).cast("double")


def first_error_of(ranges: list[Value], order: list[str]) -> Column | None:
    """The first error of the rows in their order."""
    found = []
    for r in ranges:
        if r.err is not None:
            found.append(F.min_by(r.err, F.when(r.err.isNotNull(), F.struct(*order))) if order else F.first(r.err, ignorenulls=True))
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def _put(name: str, f, least: int = 0, error: str = "#DIV/0!") -> None:
    """f(columns, extra numbers); fewer numbers than ``least`` are an error."""

    def build(ranges: list[Value], extra: list[float], order: list[str]) -> Value:
        cols = [nums(r) for r in ranges]
        own = error_if(_count(cols, extra) < least, error) if least else None
        return guarded(f(cols, extra), "n", first_error_of(ranges, order), own)

    AGGREGATES[name] = build


def _total(cols: list[Column], f, start: float) -> Column:
    out = F.lit(float(start))
    for c in cols:
        out = out + F.coalesce(f(c), F.lit(0.0))
    return out


def _count(cols, extra) -> Column:
    return _total(cols, lambda c: F.count(c).cast("double"), len(extra))


def _sum(cols, extra) -> Column:
    return _total(cols, F.sum, math.fsum(extra))


def _extreme(pick, join, best):
    def go(cols, extra):
        found = [pick(c) for c in cols] + ([F.lit(float(best(extra)))] if extra else [])
        return F.coalesce(found[0] if len(found) == 1 else join(*found), F.lit(0.0))  # nulls are skipped

    return go


def _product(cols, extra) -> Column:
    out = F.lit(float(math.prod(extra)))
    for c in cols:
        out = out * F.coalesce(F.product(c), F.lit(1.0))
    return F.when(_count(cols, extra) == 0, 0.0).otherwise(out)


def _spread(cols, extra) -> Column:
    """Sum of squares about the common mean: each range's own, and what its
    mean's distance from the common one adds."""
    if len(cols) == 1 and not extra:
        return F.var_pop(cols[0]) * F.count(cols[0])
    mean = F.try_divide(_sum(cols, extra), _count(cols, extra))
    out = F.lit(0.0)
    for c in cols:
        out = out + F.coalesce(F.var_pop(c) * F.count(c) + F.count(c) * (F.avg(c) - mean) * (F.avg(c) - mean), F.lit(0.0))
    for x in extra:
        out = out + (F.lit(float(x)) - mean) * (F.lit(float(x)) - mean)
    return out


def _all_positive(name: str, f) -> None:
    def build(ranges, extra, order):
        cols = [nums(r) for r in ranges]
        low = _extreme(F.min, F.least, min)(cols, extra)
        bad = error_if((_count(cols, extra) == 0) | (low <= 0), "#NUM!")
        return guarded(f([F.when(c > 0, c) for c in cols], [x for x in extra if x > 0]), "n", first_error_of(ranges, order), bad)

    AGGREGATES[name] = build


_put("SUM", _sum)
_put("SUMSQ", lambda cols, extra: _sum([c * c for c in cols], [x * x for x in extra]))
_put("PRODUCT", _product)
_put("COUNT", _count)
_put("AVERAGE", lambda cols, extra: F.try_divide(_sum(cols, extra), _count(cols, extra)), 1)
_put("MIN", _extreme(F.min, F.least, min))
_put("MAX", _extreme(F.max, F.greatest, max))
_put("VAR", lambda cols, extra: F.try_divide(_spread(cols, extra), _count(cols, extra) - 1), 2)
_put("STDEV", lambda cols, extra: F.sqrt(F.try_divide(_spread(cols, extra), _count(cols, extra) - 1)), 2)
_put("VARP", lambda cols, extra: F.try_divide(_spread(cols, extra), _count(cols, extra)), 1)
_put("STDEVP", lambda cols, extra: F.sqrt(F.try_divide(_spread(cols, extra), _count(cols, extra))), 1)
_put("DEVSQ", _spread, 1, "#NUM!")
_all_positive("GEOMEAN", lambda cols, extra: F.exp(F.try_divide(_sum([F.ln(c) for c in cols], [math.log(x) for x in extra]), _count(cols, extra))))
_all_positive("HARMEAN", lambda cols, extra: F.try_divide(_count(cols, extra), _sum([1 / c for c in cols], [1 / x for x in extra])))


def _gathered(cols, extra) -> Column:
    """The group's numbers in one array, as order statistics of several ranges need."""
    parts = [F.collect_list(c) for c in cols] + ([F.array(*[F.lit(float(x)) for x in extra])] if extra else [])
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def middle(xs: Column, k: Column | float) -> Column:
    """The quantile of a sorted array, between neighbours in proportion."""
    at = F.lit(k) * (F.size(xs) - 1) if isinstance(k, float) else k * (F.size(xs) - 1)
    i = F.floor(at).cast("int")
    low = F.get(xs, i)
    return low + (at - i) * (F.coalesce(F.get(xs, i + 1), low) - low)


def _median(cols, extra) -> Column:
    return F.median(cols[0]) if len(cols) == 1 and not extra else middle(F.sort_array(_gathered(cols, extra)), 0.5)


_put("MEDIAN", _median, 1, "#NUM!")


def _two(name: str, f, test) -> None:
    """Over two ranges of one length, rows where both are numbers."""

    def build(ranges, extra, order):
        a, b = (nums(r) for r in ranges)
        a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
        got = f(a, b)
        return guarded(got, "n", first_error_of(ranges, order), error_if(test(a, b, got), "#DIV/0!"))

    AGGREGATES[name] = build


_two("COVAR", F.covar_pop, lambda a, b, got: F.count(a) == 0)
_two("CORREL", lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), lambda a, b, got: got.isNull())
_two("SLOPE", F.regr_slope, lambda a, b, got: got.isNull())
_two("INTERCEPT", F.regr_intercept, lambda a, b, got: got.isNull())


def forecast(at: float, ranges: list[Value], order: list[str]) -> Value:
    slope, start = AGGREGATES["SLOPE"](ranges, [], order), AGGREGATES["INTERCEPT"](ranges, [], order)
    return guarded(start.col + slope.col * at, "n", slope.err)


def sumproduct(ranges: list[Value], extra: list[float], order: list[str]) -> Value:
    out = F.lit(float(math.prod(extra)))
    for r in ranges:
        out = out * F.coalesce(nums(r), F.lit(0.0))
    return guarded(F.coalesce(F.sum(out), F.lit(0.0)), "n", first_error_of(ranges, order))


AGGREGATES["SUMPRODUCT"] = sumproduct


def _filled(v: Value) -> Column:
    return v.col.isNotNull() if v.err is None else v.col.isNotNull() | v.err.isNotNull()


def counta(ranges: list[Value], extra: int) -> Value:
    return Value(_total([F.when(_filled(v), 1) for v in ranges], lambda c: F.count(c).cast("double"), extra), "n")


def countblank(v: Value) -> Value:
    empty = ~_filled(v)
    return Value(F.count(F.when(F.coalesce(empty | (v.col == ""), empty) if v.kind == "s" else empty, 1)).cast("double"), "n")


def truth(name: str, ranges: list[Value], extra: list[bool], order: list[str]) -> Value:
    """AND, OR, XOR of logical (or number) ranges; texts and blanks are skipped."""
    cols = [v.col if v.kind == "b" else v.col != 0 for v in ranges if v.kind in "bn"]
    n = _total(cols, lambda c: F.count(c).cast("double"), len(extra))
    if name == "XOR":
        out = (_total(cols, lambda c: F.count(F.when(c, 1)).cast("double"), sum(extra)) % 2) == 1
    else:
        out = F.lit(all(extra) if name == "AND" else any(extra))
        for c in cols:
            out = out & F.coalesce(F.bool_and(c), F.lit(True)) if name == "AND" else out | F.coalesce(F.bool_or(c), F.lit(False))
    return guarded(out, "b", first_error_of(ranges, order), error_if(n == 0, "#VALUE!"))


def percentile(v: Value, k: float, order: list[str]) -> Value:
    if not 0 <= k <= 1:
        return Value(F.first(F.lit(None).cast("double")), "n", F.first(F.lit("#NUM!")))
    return guarded(F.percentile(nums(v), F.lit(float(k))), "n", first_error_of([v], order), error_if(F.count(nums(v)) == 0, "#NUM!"))


def _all(pairs: list[tuple[Value, object]]) -> Column:
    out = criterion(*pairs[0])
    for p in pairs[1:]:
        out = out & criterion(*p)
    return out


def conditional(name: str, target: Value | None, pairs: list[tuple[Value, object]]) -> Value:
    """The SUMIF family: one aggregate over the rows that all criteria take."""
    hit = _all(pairs)
    if name in ("COUNTIF", "COUNTIFS"):
        return Value(F.count(F.when(hit, 1)).cast("double"), "n")
    x = F.when(hit, nums(target))
    err = None if target.err is None else F.first(F.when(hit, target.err), ignorenulls=True)
    if name in ("SUMIF", "SUMIFS"):
        return guarded(F.coalesce(F.sum(x), F.lit(0.0)), "n", err)
    if name in ("AVERAGEIF", "AVERAGEIFS"):
        return guarded(F.avg(x), "n", err, error_if(F.count(x) == 0, "#DIV/0!"))
    return guarded(F.coalesce((F.max if name == "MAXIFS" else F.min)(x), F.lit(0.0)), "n", err)


# -- functions of two passes: a table of one row a group goes before -----------
@dataclass(frozen=True)
class Side:
    """A column ``name`` of one value a group, which the rows must have before
    they are aggregated. places: the formula's arguments in order, each a range
    or the numbers of a constant."""

    name: str
    function: str
    places: list[tuple[Value | None, list[float]]]

    def ranges(self) -> list[Value]:
        return [v for v, _ in self.places if v is not None]

    def extra(self) -> list[float]:
        return [x for _, xs in self.places for x in xs]

    def cols(self) -> list[Column]:
        return [F.when(~F.isnan(nums(v)), nums(v)) for v in self.ranges()]

    def table(self, df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        """(*by, name)"""
        return self._means(df, by) if self.function == "AVEDEV" else self._modes(df, by, order)

    def _means(self, df: DataFrame, by: list[str]) -> DataFrame:
        cols, extra = self.cols(), self.extra()
        return df.groupBy(*by).agg(F.try_divide(_sum(cols, extra), _count(cols, extra)).alias(self.name))

    def _modes(self, df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        """Each value is counted first, then a group's counts compared; of equal
        ones that which reaches its count first, as the arguments and rows come."""
        keys = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
        at = [F.col(c).alias(f"o{k}") for k, c in enumerate(order)]
        none = [F.lit(None).cast(df.schema[c].dataType).alias(f"o{k}") for k, c in enumerate(order)]
        cells, fixed, cols = [], [], iter(self.cols())
        for i, (v, xs) in enumerate(self.places):
            if v is not None:
                cells.append(F.struct(next(cols).alias("x"), F.struct(F.lit(i).alias("i"), F.lit(0).alias("k"), *at).alias("at")))
            fixed += [F.struct(F.lit(x).alias("x"), F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), *none).alias("at")) for k, x in enumerate(xs)]
        found = df.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*[f"_g{i}" for i in range(len(by))], "c.x", "c.at")
        if fixed:
            groups = df.groupBy(*keys).agg(F.lit(1).alias("one"))
            found = found.union(groups.select(*[f"_g{i}" for i in range(len(by))], F.explode(F.array(*fixed)).alias("c")).select(*[f"_g{i}" for i in range(len(by))], "c.x", "c.at"))
        group = [f"_g{i}" for i in range(len(by))]
        counts = found.where("x is not null").groupBy(*group, "x").agg(F.count("*").alias("n"), F.max("at").alias("last")).where("n > 1")
        best = F.min(F.struct((-F.col("n")).alias("n"), "last", "x"))["x"]
        return counts.groupBy(*group).agg(best.alias(self.name)).select(*[F.col(g).alias(c) for g, c in zip(group, by)], self.name)


def _mode(side: Side, order: list[str]) -> Value:
    extra = side.extra()
    alone = [x for i, x in enumerate(extra) if x in extra[:i]]  # what no row at all leaves
    upto = {x: max(i for i, y in enumerate(extra) if y == x) for x in alone}
    fixed = min(upto, key=lambda x: (-extra.count(x), upto[x]), default=None)
    got = F.coalesce(F.first(F.col(side.name), ignorenulls=True), F.lit(fixed).cast("double"))
    return guarded(got, "n", first_error_of(side.ranges(), order), error_if(got.isNull(), "#N/A"))


def _avedev(side: Side, order: list[str]) -> Value:
    cols, extra = side.cols(), side.extra()
    mean = F.coalesce(F.first(F.col(side.name), ignorenulls=True), F.lit(math.fsum(extra) / len(extra) if extra else None).cast("double"))
    total = _total(cols, lambda c: F.sum(F.abs(c - F.col(side.name))), 0.0)
    for x in extra:
        total = total + F.abs(F.lit(float(x)) - mean)
    n = _count(cols, extra)
    return guarded(F.try_divide(total, n), "n", first_error_of(side.ranges(), order), error_if(n < 1, "#NUM!"))


#: name -> builder from the rows with their side column
SIDED = {"MODE": _mode, "AVEDEV": _avedev}


# -- the same functions across the cells of one row ---------------------------
def _row_numbers(args: list[tuple[Value, bool]], number) -> tuple[Column, list[Column]]:
    """An array of the numbers among the cells, and their errors. A cell of an
    array counts if it is a number; a direct argument is coerced."""
    cols, errors = [], []
    for v, inside in args:
        if v.err is not None:
            errors.append(v.err)
        if v.kind == "n":
            cols.append(v.col)
        elif v.kind != "z" and not inside:
            n = number(v)
            cols.append(F.when(v.col.isNotNull(), n.col))
            if n.err is not None:
                errors.append(n.err)
    if not cols:
        return F.array().cast("array<double>"), errors
    return F.filter(F.array(*[c.cast("double") for c in cols]), lambda x: x.isNotNull()), errors


def _folded(xs: Column, f, start: float = 0.0) -> Column:
    return F.aggregate(xs, F.lit(start), f)


def _row_mean(xs):
    return F.try_divide(_folded(xs, lambda a, x: a + x), F.size(xs).cast("double"))


def _row_spread(xs):
    mean = _row_mean(xs)
    return _folded(F.transform(xs, lambda x: (x - mean) * (x - mean)), lambda a, x: a + x)


_positive = lambda xs: F.size(F.filter(xs, lambda x: x <= 0)) > 0
#: name -> (f of the array of numbers, least numbers, error below, further test)
ROW_AGGREGATES = {
    "SUM": (lambda xs: _folded(xs, lambda a, x: a + x), 0, "", None),
    "SUMSQ": (lambda xs: _folded(xs, lambda a, x: a + x * x), 0, "", None),
    "PRODUCT": (lambda xs: F.when(F.size(xs) == 0, 0.0).otherwise(_folded(xs, lambda a, x: a * x, 1.0)), 0, "", None),
    "AVERAGE": (_row_mean, 1, "#DIV/0!", None),
    "MIN": (lambda xs: F.coalesce(F.array_min(xs), F.lit(0.0)), 0, "", None),
    "MAX": (lambda xs: F.coalesce(F.array_max(xs), F.lit(0.0)), 0, "", None),
    "MEDIAN": (lambda xs: middle(F.sort_array(xs), 0.5), 1, "#NUM!", None),
    "VAR": (lambda xs: F.try_divide(_row_spread(xs), F.size(xs) - 1.0), 2, "#DIV/0!", None),
    "STDEV": (lambda xs: F.sqrt(F.try_divide(_row_spread(xs), F.size(xs) - 1.0)), 2, "#DIV/0!", None),
    "VARP": (lambda xs: F.try_divide(_row_spread(xs), F.size(xs).cast("double")), 1, "#DIV/0!", None),
    "STDEVP": (lambda xs: F.sqrt(F.try_divide(_row_spread(xs), F.size(xs).cast("double"))), 1, "#DIV/0!", None),
    "DEVSQ": (_row_spread, 1, "#NUM!", None),
    "AVEDEV": (lambda xs: (lambda mean: F.try_divide(_folded(F.transform(xs, lambda x: F.abs(x - mean)), lambda a, x: a + x), F.size(xs).cast("double")))(_row_mean(xs)), 1, "#NUM!", None),
    "GEOMEAN": (lambda xs: F.exp(_row_mean(F.transform(xs, lambda x: F.ln(F.when(x > 0, x))))), 1, "#NUM!", _positive),
    "HARMEAN": (lambda xs: F.try_divide(F.size(xs).cast("double"), _folded(F.transform(xs, lambda x: F.try_divide(F.lit(1.0), x)), lambda a, x: a + x)), 1, "#NUM!", _positive),
}


def row_aggregate(name: str, args: list[tuple[Value, bool]], number) -> Value:
    f, least, error, test = ROW_AGGREGATES[name]
    xs, errors = _row_numbers(args, number)
    own = [error_if(F.size(xs) < least, error)] if least else []
    if test is not None:
        own.append(error_if(test(xs), error))
    return guarded(f(xs), "n", *errors, *own)


def row_count(args: list[tuple[Value, bool]], number) -> Value:
    """COUNT: numbers, and direct arguments that can be taken for one."""
    out = F.lit(0.0)
    for v, inside in args:
        if v.kind == "n" or (v.kind in "sb" and not inside):
            n = number(v)
            fine = v.col.isNotNull() if n.err is None else v.col.isNotNull() & n.err.isNull()
            out = out + F.when(fine, 1.0).otherwise(0.0)
    return Value(out, "n")


def row_counta(args: list[tuple[Value, bool]]) -> Value:
    out = F.lit(0.0)
    for v, _ in args:
        out = out + F.when(_filled(v), 1.0).otherwise(0.0)
    return Value(out, "n")
