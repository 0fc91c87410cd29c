"""Typed formula values as Columns: errors are values, never thrown.

A value has a Column, a kind (n number, s text, b logical, z empty) and, where an
operation below it can fail, a text Column with the error's name, null if there
is none. Null stands for an empty cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

#: Fixed value: how a text spells a number.
NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*%?\s*$"


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str
    err: Column | None = None


def first_error(*errors: Column | None) -> Column | None:
    found = [e for e in errors if e is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def guarded(col: Column, kind: str, *errors: Column | None) -> Value:
    """A value that is null where one of the errors is set."""
    err = first_error(*errors)
    return Value(col if err is None else F.when(err.isNull(), col), kind, err)


def error_if(test: Column, error: str) -> Column:
    return F.when(test, F.lit(error))


def literal(x) -> Value:
    return Value(F.lit(x), "b" if isinstance(x, bool) else "n" if isinstance(x, (int, float)) else "s")


def error(name: str) -> Value:
    return Value(F.lit(None).cast("double"), "n", F.lit(name))


def number(v: Value) -> Value:
    """Empty is 0, a logical 1 or 0, text must look like a number."""
    if v.kind == "n":
        return Value(F.coalesce(v.col, F.lit(0.0)) if v.err is None else F.when(v.err.isNull(), F.coalesce(v.col, F.lit(0.0))), "n", v.err)
    if v.kind == "b":
        return guarded(F.coalesce(v.col.cast("double"), F.lit(0.0)), "n", v.err)
    if v.kind == "z":
        return literal(0.0)
    plain = F.regexp_replace(F.trim(v.col), r"\s*%$", "").try_cast("double")
    got = F.when(v.col.isNull(), 0.0).when(v.col.rlike(NUMERIC), F.when(F.trim(v.col).endswith("%"), plain / 100).otherwise(plain))
    return guarded(got, "n", v.err, error_if(v.col.isNotNull() & ~v.col.rlike(NUMERIC), "#VALUE!"))


def number_text(x: Column) -> Column:
    """At most 15 significant digits; plain from 1e-4 to 1e21, else scientific."""
    size, digits = F.abs(x), F.format_string("%.15g", x)
    short = F.when(F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits)
    long = F.format_string("%.14e", x)
    whole = long.cast("double").cast("decimal(38,0)").cast("string")
    power = F.concat(F.regexp_replace(F.substring_index(long, "e", 1), r"\.?0+$", ""), F.lit("E"), F.substring_index(long, "e", -1))
    return F.when(x == 0, "0").when((size >= 1e-4) & (size < 1e15), short).when((size >= 1e15) & (size < 1e21), whole).otherwise(power)


def text(v: Value) -> Value:
    if v.kind == "s":
        return guarded(F.coalesce(v.col, F.lit("")), "s", v.err)
    if v.kind == "z":
        return literal("")
    if v.kind == "b":
        return guarded(F.when(v.col.isNull(), "").when(v.col, "TRUE").otherwise("FALSE"), "s", v.err)
    return guarded(F.coalesce(number_text(v.col), F.lit("")), "s", v.err)


def logical(v: Value) -> Value:
    if v.kind == "b":
        return guarded(F.coalesce(v.col, F.lit(False)), "b", v.err)
    if v.kind == "n":
        return guarded(F.coalesce(v.col != 0, F.lit(False)), "b", v.err)
    if v.kind == "z":
        return literal(False)
    low = F.lower(F.trim(v.col))
    return guarded(F.coalesce(low == "true", F.lit(False)), "b", v.err, error_if(v.col.isNotNull() & ~low.isin("true", "false"), "#VALUE!"))


def snap(x: Column) -> Column:
    """14 significant digits."""
    return F.format_string("%.13e", x).cast("double")


def compare(op: str, a: Value, b: Value) -> Value:
    """number < text < logical; text without case; empty takes the other's side."""
    ops = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    rank = {"n": 1, "s": 2, "b": 3}
    neutral = {"n": F.lit(0.0), "s": F.lit(""), "b": F.lit(False)}
    ka, kb = (b.kind if a.kind == "z" else a.kind), (a.kind if b.kind == "z" else b.kind)
    if "z" in (ka, kb):
        ka = kb = "n"
    if ka != kb:
        return guarded(F.lit(ops[op](rank[ka], rank[kb])), "b", a.err, b.err)
    side = lambda v: F.coalesce(v.col, neutral[ka]) if v.kind != "z" else neutral[ka]
    x, y = side(a), side(b)
    if ka == "s":
        x, y = F.lower(x), F.lower(y)
    return guarded(ops[op](x, y), "b", a.err, b.err)


def wildcard(pattern: str) -> str:
    """A criterion's * ? ~ as a regular expression over a whole text."""
    import re

    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            out += re.escape(pattern[i + 1])
            i += 1
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c))
        i += 1
    return f"(?i)^{out}$"


def criterion(v: Value, c) -> Column:
    """Which cells of a range a SUMIF criterion takes; c is a Python value."""
    import re

    if isinstance(c, bool):
        return F.coalesce(v.col == c, F.lit(False)) if v.kind == "b" else F.lit(False)
    if isinstance(c, (int, float)):
        return F.coalesce(v.col == float(c), F.lit(False)) if v.kind == "n" else F.lit(False)
    if c is None:
        return v.col.isNull()
    op, operand = re.match(r"(<=|>=|<>|<|>|=)?(.*)", c, re.S).groups()
    op = op or "="
    if re.match(NUMERIC, operand):
        n = float(operand.strip().rstrip("%")) / (100 if operand.strip().endswith("%") else 1)
        return F.coalesce(compare(op, Value(v.col, "n"), literal(n)).col & v.col.isNotNull(), F.lit(False)) if v.kind == "n" else F.lit(False)
    if v.kind != "s":
        return F.lit(False)
    if op in ("=", "<>"):
        hit = v.col.rlike(wildcard(operand))
        return F.coalesce(hit if op == "=" else ~hit, F.lit(False))
    return F.coalesce(compare(op, v, literal(operand)).col & v.col.isNotNull(), F.lit(False))
