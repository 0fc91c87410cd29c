"""Row-wise functions: name -> builder from values to a value.

``FUNCTIONS`` holds (least arguments, most, builder). Builders see values as
given, so that those which inspect errors can; ``_n`` and ``_s`` wrap builders
over numbers and texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..plans.values import Value, compare, error_if, first_error, guarded, literal, logical, number, number_text, text

FUNCTIONS: dict[str, tuple] = {}
SERIAL_ZERO = "1899-12-30"


def put(name: str, least: int, most: int, build) -> None:
    for n in name.split():
        FUNCTIONS[n] = (least, most, build)


def _n(name: str, least: int, most: int, f, *tests, kind: str = "n", defaults: tuple = ()) -> None:
    """f over number Columns; tests: (predicate of the same Columns, error)."""

    def build(*args: Value) -> Value:
        a = [number(x) for x in args] + [literal(float(d)) for d in defaults[len(args) - least :]]
        cols = [x.col for x in a]
        before = first_error(*(x.err for x in a))
        own = [error_if(t(*cols), e) for t, e in tests]
        out = guarded(f(*cols), kind, before, *own)
        if kind != "n":
            return out
        bad = F.when(F.isnan(out.col) | (F.abs(out.col) == math.inf), F.lit("#NUM!"))
        return guarded(out.col, "n", out.err, bad) if f in _CHECKED else out

    put(name, least, most, build)


_CHECKED: set = set()


def _checked(f):
    _CHECKED.add(f)
    return f


# -- mathematics ------------------------------------------------------------
def _half_up(x: Column, digits: Column, f) -> Column:
    """f rounds |x| scaled by digits; 15 significant digits are kept before."""
    p = F.pow(F.lit(10.0), digits)
    scaled = F.abs(x) * p
    return F.signum(x) * f(scaled) / p


def _trunc(x):
    return F.signum(x) * F.floor(F.abs(x)).cast("double")


_dbl = lambda c: c.cast("double")
_n("ROUND", 2, 2, lambda x, d: _half_up(x, _trunc(d), lambda v: _dbl(F.floor(v + 0.5))))
_n("ROUNDUP", 2, 2, lambda x, d: _half_up(x, _trunc(d), lambda v: _dbl(F.ceil(v - 1e-9 * F.greatest(v, F.lit(1.0)) * 1e-3))))
_n("ROUNDDOWN", 2, 2, lambda x, d: _half_up(x, _trunc(d), lambda v: _dbl(F.floor(v + 1e-12 * F.greatest(v, F.lit(1.0))))))
_n("TRUNC", 1, 2, lambda x, d: _half_up(x, _trunc(d), lambda v: _dbl(F.floor(v + 1e-12 * F.greatest(v, F.lit(1.0))))), defaults=(0,))
for _name, _f in {"ABS": F.abs, "SIGN": F.signum, "INT": lambda x: _dbl(F.floor(x)), "ATAN": F.atan, "TANH": F.tanh, "ASINH": lambda x: F.signum(x) * F.ln(F.abs(x) + F.sqrt(x * x + 1)), "RADIANS": F.radians, "DEGREES": F.degrees, "SIN": F.sin, "COS": F.cos}.items():
    _n(_name, 1, 1, _f)
for _name, _f in {"EXP": F.exp, "SINH": F.sinh, "COSH": F.cosh, "TAN": F.tan}.items():
    _n(_name, 1, 1, _checked(lambda x, f=_f: f(x)))
_n("SQRT", 1, 1, F.sqrt, (lambda x: x < 0, "#NUM!"))
_n("SQRTPI", 1, 1, lambda x: F.sqrt(x * math.pi), (lambda x: x < 0, "#NUM!"))
_n("LN", 1, 1, F.ln, (lambda x: x <= 0, "#NUM!"))
_n("LOG10", 1, 1, F.log10, (lambda x: x <= 0, "#NUM!"))
_n("LOG", 1, 2, lambda x, b: F.try_divide(F.ln(x), F.ln(b)), (lambda x, b: (x <= 0) | (b <= 0), "#NUM!"), (lambda x, b: b == 1, "#DIV/0!"), defaults=(10,))
_n("ASIN", 1, 1, F.asin, (lambda x: F.abs(x) > 1, "#NUM!"))
_n("ACOS", 1, 1, F.acos, (lambda x: F.abs(x) > 1, "#NUM!"))
_n("ACOSH", 1, 1, lambda x: F.ln(x + F.sqrt(x * x - 1)), (lambda x: x < 1, "#NUM!"))
_n("ATANH", 1, 1, lambda x: 0.5 * F.ln(F.try_divide(1 + x, 1 - x)), (lambda x: F.abs(x) >= 1, "#NUM!"))
_n("ATAN2", 2, 2, lambda x, y: F.atan2(y, x), (lambda x, y: (x == 0) & (y == 0), "#DIV/0!"))
_n("POWER", 2, 2, _checked(lambda x, y: F.pow(x, y)), (lambda x, y: (x == 0) & (y == 0), "#NUM!"))
_n("MOD", 2, 2, lambda x, y: x - y * _dbl(F.floor(F.try_divide(x, y))), (lambda x, y: y == 0, "#DIV/0!"))
_n("CEILING", 2, 2, lambda x, s: F.when(s == 0, 0.0).otherwise(_dbl(F.ceil(F.try_divide(x, s))) * s), (lambda x, s: (x > 0) & (s < 0), "#NUM!"))
_n("FLOOR", 2, 2, lambda x, s: _dbl(F.floor(F.try_divide(x, s))) * s, (lambda x, s: s == 0, "#DIV/0!"), (lambda x, s: (x > 0) & (s < 0), "#NUM!"))
_n("MROUND", 2, 2, lambda x, m: F.when(m == 0, 0.0).otherwise(_dbl(F.floor(F.abs(F.try_divide(x, m)) + 0.5)) * m), (lambda x, m: x * m < 0, "#NUM!"))
_n("EVEN", 1, 1, lambda x: F.signum(x) * _dbl(F.ceil(F.abs(x) / 2)) * 2)
_n("ODD", 1, 1, lambda x: F.when(x == 0, 1.0).otherwise(F.signum(x) * (_dbl(F.ceil((F.abs(x) + 1) / 2)) * 2 - 1)))
_n("FACT", 1, 1, lambda x: F.aggregate(F.sequence(F.lit(1), F.greatest(F.floor(x), F.lit(1)).cast("int")), F.lit(1.0), lambda a, i: a * i), (lambda x: (x < 0) | (x >= 171), "#NUM!"))


def _falling(n, k):
    return F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(0)).cast("int")), F.lit(1.0), lambda a, i: F.when(i < k, a * (n - i)).otherwise(a))


_n("PERMUT", 2, 2, lambda n, k: _falling(_trunc(n), _trunc(k)), (lambda n, k: (n < 0) | (k < 0) | (n < k), "#NUM!"))
_n("COMBIN", 2, 2, lambda n, k: F.aggregate(F.sequence(F.lit(0), F.greatest(_trunc(k), F.lit(0.0)).cast("int")), F.lit(1.0), lambda a, i: F.when(i < _trunc(k), _dbl(F.round(a * (_trunc(n) - i) / (i + 1)))).otherwise(a)), (lambda n, k: (n < 0) | (k < 0) | (n < k), "#NUM!"))
_n("PI", 0, 0, lambda: F.lit(math.pi))
_n("DELTA", 1, 2, lambda x, y: _dbl((x == y).cast("int")), defaults=(0,))
_n("GESTEP", 1, 2, lambda x, y: _dbl((x >= y).cast("int")), defaults=(0,))
_BAD_BITS = (lambda x, y: (x < 0) | (y < 0) | (x != F.floor(x)) | (y != F.floor(y)) | (x >= 2.0**48) | (y >= 2.0**48), "#NUM!")
for _name, _f in {"BITAND": "bitwiseAND", "BITOR": "bitwiseOR", "BITXOR": "bitwiseXOR"}.items():
    _n(_name, 2, 2, lambda x, y, f=_f: _dbl(getattr(x.cast("long"), f)(y.cast("long"))), _BAD_BITS)
_BAD_SHIFT = (lambda x, y: (x < 0) | (x != F.floor(x)) | (x >= 2.0**48) | (F.abs(y) > 53), "#NUM!")
_n("BITLSHIFT", 2, 2, lambda x, y: _dbl(F.floor(x * F.pow(F.lit(2.0), _trunc(y)))), _BAD_SHIFT)
_n("BITRSHIFT", 2, 2, lambda x, y: _dbl(F.floor(x / F.pow(F.lit(2.0), _trunc(y)))), _BAD_SHIFT)


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 75 are enough below 2^53."""
    start = F.struct(_trunc(a).alias("x"), _trunc(b).alias("y"))
    step = lambda s, i: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] - s["y"] * _dbl(F.floor(F.try_divide(s["x"], s["y"])))).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(75)), start, step, lambda s: s["x"])


def _fold(f):
    def go(*cols):
        out = cols[0]
        for c in cols[1:]:
            out = f(out, c)
        return _trunc(out)

    return go


_any_negative = (lambda *c: F.greatest(F.lit(False), *[x < 0 for x in c]), "#NUM!")
_n("GCD", 1, 255, _fold(_gcd), _any_negative)
_n("LCM", 1, 255, _fold(lambda a, b: F.coalesce(F.try_divide(_trunc(a) * _trunc(b), _gcd(a, b)), F.lit(0.0))), _any_negative)
_ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def _roman(x: Column, *_form) -> Column:
    out, left = F.lit(""), _trunc(x).cast("int")
    for n, s in _ROMAN:
        out, left = F.concat(out, F.repeat(F.lit(s), (left / n).cast("int"))), left % n
    return out


_n("ROMAN", 1, 2, _roman, (lambda x, *f: (x < 0) | (x >= 4000), "#VALUE!"), kind="s")


def _arabic(v: Value) -> Value:
    t = text(v)
    u = F.upper(F.trim(t.col))
    sign = F.when(u.startswith("-"), -1.0).otherwise(1.0)
    values = F.transform(F.split(F.regexp_replace(u, "^-", ""), ""), lambda c: F.coalesce(*[F.when(c == s, n) for n, s in _ROMAN if len(s) == 1], F.lit(0)))
    total = F.aggregate(F.sequence(F.lit(0), F.size(values) - 1), F.lit(0), lambda a, i: a + F.when(F.get(values, i) < F.coalesce(F.get(values, i + 1), F.lit(0)), -F.get(values, i)).otherwise(F.get(values, i)))
    return guarded(sign * total, "n", t.err, error_if(~u.rlike("^-?[MDCLXVI]*$"), "#VALUE!"))


put("ARABIC", 1, 1, _arabic)


DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _base(*args: Value) -> Value:
    x, r, m = [*(number(a) for a in args), literal(0.0)][:3]
    bad = error_if((x.col < 0) | (x.col >= 2.0**53) | (r.col < 2) | (r.col > 36) | (m.col < 0), "#NUM!")
    radix = F.greatest(r.col, F.lit(2.0)).cast("long")
    step = lambda a, i: F.when(a["n"] == 0, a).otherwise(F.struct(F.floor(a["n"] / radix).cast("long").alias("n"), F.concat(F.substr(F.lit(DIGITS), (a["n"] % radix + 1).cast("int"), F.lit(1)), a["s"]).alias("s")))
    digits = F.aggregate(F.sequence(F.lit(1), F.lit(53)), F.struct(F.floor(x.col).cast("long").alias("n"), F.lit("").alias("s")), step, lambda a: F.when(a["s"] == "", "0").otherwise(a["s"]))
    return guarded(F.when(F.length(digits) < m.col, F.lpad(digits, m.col.cast("int"), F.lit("0"))).otherwise(digits), "s", x.err, r.err, m.err, bad)


put("BASE", 2, 3, _base)


def _decimal(v: Value, radix: Value) -> Value:
    t, r = text(v), number(radix)
    values = F.transform(F.split(F.upper(F.trim(t.col)), ""), lambda c: F.call_function("instr", F.lit(DIGITS), c) - 1)
    bad = error_if((r.col < 2) | (r.col > 36) | F.exists(values, lambda d: (d < 0) | (d >= r.col)), "#NUM!")
    return guarded(F.aggregate(values, F.lit(0.0), lambda a, d: a * r.col + d), "n", t.err, r.err, bad)


put("DECIMAL", 2, 2, _decimal)

# -- logic and information --------------------------------------------------
put("TRUE", 0, 0, lambda: literal(True))
put("FALSE", 0, 0, lambda: literal(False))


def _unify(*vs: Value) -> tuple[str, list[Column]]:
    kinds = {v.kind for v in vs if v.kind != "z"}
    kind = kinds.pop() if len(kinds) == 1 else "n" if not kinds else "s"
    neutral = {"n": F.lit(0.0), "s": F.lit(""), "b": F.lit(False)}[kind]
    return kind, [neutral if v.kind == "z" else v.col if v.kind == kind else text(v).col for v in vs]


def _if(test: Value, yes: Value, no: Value | None = None) -> Value:
    t = logical(test)
    kind, (a, b) = _unify(yes, no if no is not None else literal(False))
    no = no if no is not None else literal(False)
    none = F.lit(None).cast("string")
    err = None
    if not (t.err is None and yes.err is None and no.err is None):
        err = F.coalesce(t.err if t.err is not None else none, F.when(t.col, yes.err if yes.err is not None else none).otherwise(no.err if no.err is not None else none))
    return Value(F.when(t.col, a).otherwise(b), kind, err)


def _ifs(*args: Value) -> Value:
    out = Value(F.lit(None).cast("double"), "z", F.lit("#N/A"))
    for test, value in reversed(list(zip(args[::2], args[1::2]))):
        out = _if(test, value, Value(F.lit(None), value.kind, out.err) if out.kind == "z" else out)
    return out


def _switch(x: Value, *rest: Value) -> Value:
    pairs = len(rest) // 2
    out = rest[-1] if len(rest) % 2 else Value(F.lit(None), rest[1].kind, F.lit("#N/A"))
    for k in reversed(range(pairs)):
        out = _if(compare("=", x, rest[2 * k]), rest[2 * k + 1], out)
    return out


def _choose(i: Value, *rest: Value) -> Value:
    n = number(i)
    at = F.floor(n.col)
    out = Value(F.lit(None), rest[0].kind, F.lit("#VALUE!"))
    for k in reversed(range(len(rest))):
        out = _if(guarded(at == k + 1, "b", n.err), rest[k], out)
    return out


def _if_error(v: Value, other: Value, only: str | None = None) -> Value:
    if v.err is None:
        return v
    hit = v.err == only if only else v.err.isNotNull()
    kind, (a, b) = _unify(v, other)
    err = F.when(F.coalesce(hit, F.lit(False)), other.err if other.err is not None else F.lit(None).cast("string")).otherwise(v.err)
    return Value(F.when(F.coalesce(hit, F.lit(False)), b).otherwise(a), kind, err)


put("IF", 2, 3, _if)
put("IFS", 2, 254, _ifs)
put("SWITCH", 3, 254, _switch)
put("CHOOSE", 2, 255, _choose)
put("IFERROR", 2, 2, _if_error)
put("IFNA", 2, 2, lambda v, o: _if_error(v, o, "#N/A"))


def _bools(f):
    def build(*args: Value) -> Value:
        got = [logical(a) for a in args]
        out = got[0].col
        for g in got[1:]:
            out = f(out, g.col)
        return guarded(out, "b", *(g.err for g in got))

    return build


put("AND", 1, 255, _bools(lambda a, b: a & b))
put("OR", 1, 255, _bools(lambda a, b: a | b))
put("XOR", 1, 255, _bools(lambda a, b: a != b))
put("NOT", 1, 1, lambda v: (lambda g: guarded(~g.col, "b", g.err))(logical(v)))


def _is(f):
    return lambda v: Value(F.coalesce(f(v), F.lit(False)), "b")


_fine = lambda v: F.lit(True) if v.err is None else v.err.isNull()
put("ISBLANK", 1, 1, _is(lambda v: v.col.isNull() & _fine(v)))
put("ISNUMBER", 1, 1, _is(lambda v: (v.col.isNotNull() & _fine(v)) if v.kind == "n" else F.lit(False)))
put("ISTEXT", 1, 1, _is(lambda v: (v.col.isNotNull() & _fine(v)) if v.kind == "s" else F.lit(False)))
put("ISNONTEXT", 1, 1, _is(lambda v: ~((v.col.isNotNull() & _fine(v)) if v.kind == "s" else F.lit(False))))
put("ISLOGICAL", 1, 1, _is(lambda v: (v.col.isNotNull() & _fine(v)) if v.kind == "b" else F.lit(False)))
put("ISERROR", 1, 1, _is(lambda v: F.lit(False) if v.err is None else v.err.isNotNull()))
put("ISERR", 1, 1, _is(lambda v: F.lit(False) if v.err is None else v.err.isNotNull() & (v.err != "#N/A")))
put("ISNA", 1, 1, _is(lambda v: F.lit(False) if v.err is None else v.err == "#N/A"))
_n("ISEVEN", 1, 1, lambda x: F.abs(_trunc(x)) % 2 == 0, kind="b")
_n("ISODD", 1, 1, lambda x: F.abs(_trunc(x)) % 2 == 1, kind="b")
put("NA", 0, 0, lambda: Value(F.lit(None).cast("double"), "n", F.lit("#N/A")))
put("N", 1, 1, lambda v: number(v) if v.kind in "nb" else guarded(F.lit(0.0), "n", v.err))
put("T", 1, 1, lambda v: text(v) if v.kind == "s" else guarded(F.lit(""), "s", v.err))
put("TYPE", 1, 1, lambda v: Value(F.when(~_fine(v), 16.0).when(v.col.isNull(), 1.0).otherwise(F.lit({"n": 1.0, "s": 2.0, "b": 4.0, "z": 1.0}[v.kind])), "n"))
_ERROR_TYPES = {"#NULL!": 1, "#DIV/0!": 2, "#VALUE!": 3, "#REF!": 4, "#NAME?": 5, "#NUM!": 6, "#N/A": 7}
put("ERROR.TYPE", 1, 1, lambda v: Value(F.lit(None).cast("double"), "n", F.lit("#N/A")) if v.err is None else guarded(F.coalesce(*[F.when(v.err == k, float(n)) for k, n in _ERROR_TYPES.items()]), "n", F.when(v.err.isNull() | ~v.err.isin(*_ERROR_TYPES), F.lit("#N/A"))))

# -- text -------------------------------------------------------------------
def _s(name: str, least: int, most: int, f, *tests, types: str = "s", kind: str = "s", defaults: tuple = ()) -> None:
    """types: s or n for each argument, the last repeated."""

    def build(*args: Value) -> Value:
        args = [*args, *(literal(d) for d in defaults[len(args) - least :])]
        a = [(text if types[min(i, len(types) - 1)] == "s" else number)(x) for i, x in enumerate(args)]
        cols = [x.col for x in a]
        return guarded(f(*cols), kind, *(x.err for x in a), *(error_if(t(*cols), e) for t, e in tests))

    put(name, least, most, build)


_int = lambda c: F.floor(c).cast("int")
_s("CONCATENATE CONCAT", 1, 255, lambda *c: F.concat(*c))
_s("LEFT", 1, 2, lambda s, n: F.left(s, _int(n)), (lambda s, n: n < 0, "#VALUE!"), types="sn", defaults=(1.0,))
_s("RIGHT", 1, 2, lambda s, n: F.right(s, _int(n)), (lambda s, n: n < 0, "#VALUE!"), types="sn", defaults=(1.0,))
_s("MID", 3, 3, lambda s, i, n: F.substr(s, _int(i), _int(n)), (lambda s, i, n: (i < 1) | (n < 0), "#VALUE!"), types="snn")
_s("LEN", 1, 1, lambda s: F.length(s).cast("double"), kind="n")
_s("UPPER", 1, 1, F.upper)
_s("LOWER", 1, 1, F.lower)
_s("TRIM", 1, 1, lambda s: F.trim(F.regexp_replace(s, " +", " ")))
_s("CLEAN", 1, 1, lambda s: F.regexp_replace(s, r"[\x00-\x1f]", ""))
_s("EXACT", 2, 2, lambda a, b: a == b, kind="b")
_s("REPT", 2, 2, lambda s, n: F.repeat(s, _int(n)), (lambda s, n: (n < 0) | (n * F.length(s) > 32767), "#VALUE!"), types="sn")
_s("REPLACE", 4, 4, lambda s, i, n, t: F.concat(F.left(s, _int(i) - 1), t, F.substr(s, _int(i) + _int(n), F.length(s))), (lambda s, i, n, t: (i < 1) | (n < 0), "#VALUE!"), types="snns")
_s("FIND", 2, 3, lambda a, s, i: F.call_function("locate", a, s, _int(i)).cast("double"), (lambda a, s, i: (i < 1) | (F.call_function("locate", a, s, _int(i)) == 0), "#VALUE!"), types="ssn", kind="n", defaults=(1.0,))
_s("CODE UNICODE", 1, 1, lambda s: F.ascii(s).cast("double"), (lambda s: s == "", "#VALUE!"), kind="n")
_n("CHAR", 1, 1, lambda x: F.chr(_int(x)), (lambda x: (x < 1) | (x > 255), "#VALUE!"), kind="s")
_n("UNICHAR", 1, 1, lambda x: F.decode(F.unhex(F.lpad(F.hex(_trunc(x).cast("long")), 8, "0")), "UTF-32"), (lambda x: (x < 1) | (x >= 0x110000) | ((x >= 0xD800) & (x < 0xE000)), "#VALUE!"), kind="s")
_s("PROPER", 1, 1, lambda s: F.array_join(F.transform(F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2), F.length(w))))), ""))
_s("VALUE", 1, 1, lambda s: s, kind="s")
put("VALUE", 1, 1, lambda v: number(text(v)) if v.kind == "s" else number(v))


def _search(a: Value, s: Value, i: Value | None = None) -> Value:
    """FIND without case and with wildcards, which become a regular expression."""
    a, s, i = text(a), text(s), number(i if i is not None else literal(1.0))
    pattern = F.lower(a.col)
    for mark, kept in (("~~", "\x03"), ("~*", "\x01"), ("~?", "\x02")):
        pattern = F.replace(pattern, F.lit(mark), F.lit(kept))
    pattern = F.regexp_replace(pattern, r"([\\^$.|+()\[\]{}])", r"\\$1")
    for mark, meant in (("?", "."), ("*", ".*?"), ("\x01", r"\*"), ("\x02", r"\?"), ("\x03", "~")):
        pattern = F.replace(pattern, F.lit(mark), F.lit(meant))
    rest = F.substr(F.lower(s.col), _int(i.col), F.length(s.col))
    hit = F.regexp_instr(rest, F.concat(F.lit("(?s)"), pattern))
    return guarded((hit + i.col - 1).cast("double"), "n", a.err, s.err, i.err, error_if((i.col < 1) | (hit == 0), "#VALUE!"))


put("SEARCH", 2, 3, _search)


def _substitute(s: Value, old: Value, new: Value, nth: Value | None = None) -> Value:
    s, old, new = text(s), text(old), text(new)
    if nth is None:
        return guarded(F.when(old.col == "", s.col).otherwise(F.replace(s.col, old.col, new.col)), "s", s.err, old.err, new.err)
    k = number(nth)
    parts = F.split(s.col, F.concat(F.lit(r"\Q"), old.col, F.lit(r"\E")))
    n = _int(k.col)
    swapped = F.concat(F.call_function("array_join", F.slice(parts, F.lit(1), n), old.col), new.col, F.call_function("array_join", F.slice(parts, n + 1, F.size(parts)), old.col))
    return guarded(F.when((old.col == "") | (F.size(parts) <= n), s.col).otherwise(swapped), "s", s.err, old.err, new.err, k.err, error_if(k.col < 1, "#VALUE!"))


put("SUBSTITUTE", 3, 4, _substitute)


def _textjoin(sep: Value, skip: Value, *parts: Value) -> Value:
    sep, skip, parts = text(sep), logical(skip), [text(p) for p in parts]
    kept = F.filter(F.array(*[p.col for p in parts]), lambda p: ~skip.col | (p != ""))
    return guarded(F.call_function("array_join", kept, sep.col), "s", sep.err, skip.err, *(p.err for p in parts))


put("TEXTJOIN", 3, 255, _textjoin)


def _beside(before: bool):
    def build(s: Value, sep: Value, nth: Value | None = None, *_rest: Value) -> Value:
        s, sep, k = text(s), text(sep), number(nth if nth is not None else literal(1.0))
        n = _trunc(k.col).cast("int")
        found = F.size(F.split(s.col, F.concat(F.lit(r"\Q"), sep.col, F.lit(r"\E")))) - 1
        at = F.when(n > 0, n).otherwise(found + n + 1)
        parts = F.split(s.col, F.concat(F.lit(r"\Q"), sep.col, F.lit(r"\E")))
        got = F.call_function("array_join", F.slice(parts, F.lit(1), F.greatest(at, F.lit(0))) if before else F.slice(parts, F.greatest(at, F.lit(0)) + 1, F.size(parts)), sep.col)
        return guarded(got, "s", s.err, sep.err, k.err, error_if(n == 0, "#VALUE!"), error_if((at < 1) | (at > found), "#N/A"))

    return build


put("TEXTBEFORE", 2, 3, _beside(True))
put("TEXTAFTER", 2, 3, _beside(False))


def _fixed(x: Value, digits: Value | None = None, plain: Value | None = None) -> Value:
    x, d, p = number(x), number(digits if digits is not None else literal(2.0)), logical(plain if plain is not None else literal(False))
    r = FUNCTIONS["ROUND"][2](x, d).col
    body = F.call_function("format_number", r, F.greatest(_int(d.col), F.lit(0)))
    return guarded(F.when(p.col, F.replace(body, F.lit(","), F.lit(""))).otherwise(body), "s", x.err, d.err, p.err)


put("FIXED", 1, 3, _fixed)


def _dollar(x: Value, digits: Value | None = None) -> Value:
    body = _fixed(x, digits)
    return guarded(F.when(body.col.startswith("-"), F.concat(F.lit("($"), F.substr(body.col, F.lit(2), F.length(body.col)), F.lit(")"))).otherwise(F.concat(F.lit("$"), body.col)), "s", body.err)


put("DOLLAR", 1, 2, _dollar)

# -- dates: serial numbers --------------------------------------------------
def to_serial(date: Column) -> Column:
    """A date or timestamp column as a serial number (1900-03-01 and later exact)."""
    day = F.datediff(date.cast("date"), F.lit(SERIAL_ZERO).cast("date")).cast("double")
    return F.when(day <= 60, day - 1).otherwise(day)


def from_serial(n: Column) -> Column:
    whole = F.floor(n).cast("int")
    return F.date_add(F.lit(SERIAL_ZERO).cast("date"), F.when(whole < 60, whole + 1).when(whole == 60, 60).otherwise(whole))


_BAD_DATE = (lambda x, *r: x < 0, "#NUM!")
for _name, (_f, _zero) in {"YEAR": (F.year, 1900.0), "MONTH": (F.month, 1.0), "DAY": (F.dayofmonth, 0.0)}.items():
    _n(_name, 1, 1, lambda x, f=_f, z=_zero: F.when(F.floor(x) == 0, z).otherwise(f(from_serial(x)).cast("double")), _BAD_DATE)
_seconds = lambda x: F.floor((x - F.floor(x)) * 86400 + 0.5)
_n("HOUR", 1, 1, lambda x: _dbl(F.floor(_seconds(x) / 3600) % 24), _BAD_DATE)
_n("MINUTE", 1, 1, lambda x: _dbl(F.floor(_seconds(x) / 60) % 60), _BAD_DATE)
_n("SECOND", 1, 1, lambda x: _dbl(_seconds(x) % 60), _BAD_DATE)
_n("TIME", 3, 3, lambda h, m, s: (lambda t: (t % 86400) / 86400)(_trunc(h) * 3600 + _trunc(m) * 60 + _trunc(s)), (lambda h, m, s: _trunc(h) * 3600 + _trunc(m) * 60 + _trunc(s) < 0, "#NUM!"))


def _first_of(year: Column, month: Column) -> Column:
    y = F.when(year < 1900, year + 1900).otherwise(year)
    months = y * 12 + month - 1
    return F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))


_n("DATE", 3, 3, lambda y, m, d: to_serial(_first_of(_trunc(y), _trunc(m))) + _trunc(d) - 1, (lambda y, m, d: (y < 0) | (y >= 10000), "#NUM!"))
_n("DAYS", 2, 2, lambda a, b: _trunc(a) - _trunc(b))
def _week_start(kind: Column) -> Column:
    """The first day of a week, Sunday being 0, by the number of the system."""
    return F.when(kind.isin(1.0, 17.0), 0.0).when(kind.isin(2.0, 3.0), 1.0).otherwise(kind - 10)


_n("WEEKDAY", 1, 2, lambda x, t: (F.pmod(F.floor(x) - 1 - _week_start(_trunc(t)), F.lit(7.0)) + F.when(_trunc(t) == 3, 0.0).otherwise(1.0)), _BAD_DATE, (lambda x, t: ~_trunc(t).isin(1.0, 2.0, 3.0, *map(float, range(11, 18))), "#NUM!"), defaults=(1,))
_n("EDATE", 2, 2, lambda x, m: to_serial(F.add_months(from_serial(x), _int(m))), _BAD_DATE)
_n("EOMONTH", 2, 2, lambda x, m: to_serial(F.last_day(F.add_months(from_serial(x), _int(m)))), _BAD_DATE)
def _weeknum(x, t):
    day = from_serial(x)
    january = to_serial(F.make_date(F.when(F.floor(x) == 0, 1900).otherwise(F.year(day)), F.lit(1), F.lit(1)))
    own = F.floor((F.floor(x) - january + F.pmod(january - 1 - _week_start(_trunc(t)), F.lit(7.0))) / 7) + 1
    return F.when(_trunc(t) == 21, F.weekofyear(day)).otherwise(own).cast("double")


_n("WEEKNUM", 1, 2, _weeknum, _BAD_DATE, (lambda x, t: ~_trunc(t).isin(1.0, 2.0, 21.0, *map(float, range(11, 18))), "#NUM!"), defaults=(1,))


def _days360(a, b, method):
    d1, d2 = F.dayofmonth(from_serial(a)), F.dayofmonth(from_serial(b))
    y1, y2, m1, m2 = F.year(from_serial(a)), F.year(from_serial(b)), F.month(from_serial(a)), F.month(from_serial(b))
    end1 = F.last_day(from_serial(a)) == from_serial(a)
    us1 = F.when(end1, 30).otherwise(d1)
    eu1, eu2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    us2 = F.when((d2 == 31) & (us1 >= 30), 30).otherwise(d2)
    days = (y2 - y1) * 360 + (m2 - m1) * 30
    return _dbl(days + F.when(method != 0, eu2 - eu1).otherwise(us2 - us1))


_n("DAYS360", 2, 3, _days360, _BAD_DATE, defaults=(0,))


def _yearfrac(a, b, basis):
    lo, hi = F.least(a, b), F.greatest(a, b)
    y1, y2 = F.year(from_serial(lo)), F.year(from_serial(hi))
    leap = lambda y: ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    actual = F.when(y1 == y2, F.when(leap(y1), 366.0).otherwise(365.0)).otherwise(F.datediff(F.make_date(y2 + 1, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(1), F.lit(1))) / (y2 - y1 + 1))
    days = F.floor(hi) - F.floor(lo)
    return F.when(basis == 0, _days360(lo, hi, F.lit(0)) / 360).when(basis == 1, days / actual).when(basis == 2, days / 360).when(basis == 3, days / 365).otherwise(_days360(lo, hi, F.lit(1)) / 360).cast("double")


_n("YEARFRAC", 2, 3, _yearfrac, (lambda a, b, k: (a < 0) | (b < 0) | (k < 0) | (k >= 5), "#NUM!"), defaults=(0,))


def _datedif(a: Value, b: Value, unit: Value) -> Value:
    a, b, u = number(a), number(b), text(unit)
    x, y, k = from_serial(a.col), from_serial(b.col), F.upper(u.col)
    months = (F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x) - (F.dayofmonth(y) < F.dayofmonth(x)).cast("int")
    got = F.when(k == "D", F.floor(b.col) - F.floor(a.col)).when(k == "M", months).when(k == "Y", F.floor(months / 12)).when(k == "YM", F.pmod(months, F.lit(12))).when(k == "MD", F.datediff(y, F.add_months(x, months))).when(k == "YD", F.datediff(y, F.add_months(x, (F.floor(months / 12) * 12).cast("int"))))
    return guarded(got.cast("double"), "n", a.err, b.err, u.err, error_if((a.col > b.col) | (a.col < 0) | ~k.isin("D", "M", "Y", "YM", "MD", "YD"), "#NUM!"))


put("DATEDIF", 3, 3, _datedif)


def _workdays_upto(n):
    """Mondays to Fridays among the serials 1 to n (1 is a Sunday)."""
    return F.floor(n / 7) * 5 + F.greatest(F.lit(0), F.least(n - F.floor(n / 7) * 7 - 1, F.lit(5)))


_n("NETWORKDAYS", 2, 2, lambda a, b: F.when(a <= b, _workdays_upto(F.floor(b)) - _workdays_upto(F.floor(a) - 1)).otherwise(-(_workdays_upto(F.floor(a)) - _workdays_upto(F.floor(b) - 1))).cast("double"), _BAD_DATE)


def _workday(a, n):
    """Whole weeks, then at most four days more around a weekend."""
    start, n = F.floor(a), _trunc(n)
    day = F.pmod(start - 2, F.lit(7))  # Monday is 0
    base = F.when(n > 0, F.when(day > 4, start - (day - 4)).otherwise(start)).otherwise(F.when(day > 4, start + (7 - day)).otherwise(start))
    weekday = F.pmod(base - 2, F.lit(7))
    weeks, rest = _trunc(n / 5), n - _trunc(n / 5) * 5
    forward = base + weeks * 7 + rest + F.when(weekday + rest > 4, 2).otherwise(0)
    backward = base + weeks * 7 + rest - F.when(weekday + rest < 0, 2).otherwise(0)
    return F.when(n == 0, start).when(n > 0, forward).otherwise(backward).cast("double")


_n("WORKDAY", 2, 2, _workday, _BAD_DATE)

# -- finance ----------------------------------------------------------------
_grow = lambda r, n: F.pow(1 + r, n)


def _pmt(r, n, pv, fv, t):
    g = _grow(r, n)
    return F.when(r == 0, -(pv + fv) / n).otherwise(-F.try_divide(r * (pv * g + fv), (1 + r * t) * (g - 1)))


def _fv(r, n, pmt, pv, t):
    g = _grow(r, n)
    return F.when(r == 0, -(pv + pmt * n)).otherwise(-(pv * g + pmt * (1 + r * t) * F.try_divide(g - 1, r)))


def _pv(r, n, pmt, fv, t):
    g = _grow(r, n)
    return F.when(r == 0, -(fv + pmt * n)).otherwise(-F.try_divide(fv + pmt * (1 + r * t) * F.try_divide(g - 1, r), g))


def _ipmt(r, per, n, pv, fv, t):
    p = _pmt(r, n, pv, fv, t)
    owed = _fv(r, per - 1, p, pv, t)
    return F.when(t == 0, owed * r).otherwise(F.when(per == 1, 0.0).otherwise(F.try_divide(owed * r, 1 + r)))


_ZERO_TERM = (lambda r, n, *x: n == 0, "#NUM!")
_n("PMT", 3, 5, _pmt, _ZERO_TERM, defaults=(0, 0))
_n("FV", 3, 5, _fv, defaults=(0, 0))
_n("PV", 3, 5, _pv, defaults=(0, 0))
def _nper(r, p, pv, fv, t):
    due = p * (1 + r * t)
    ratio = F.try_divide(due - fv * r, pv * r + due)
    return F.when(r == 0, F.try_divide(-(pv + fv), p)).otherwise(F.try_divide(F.ln(F.when(ratio > 0, ratio)), F.ln(1 + r)))


_n("NPER", 3, 5, _nper, (lambda *a: _nper(*a).isNull(), "#NUM!"), defaults=(0, 0))
_bad_per = (lambda r, per, n, *x: (per < 1) | (per > n), "#NUM!")
_n("IPMT", 4, 6, _ipmt, _bad_per, defaults=(0, 0))
_n("PPMT", 4, 6, lambda r, per, n, pv, fv, t: _pmt(r, n, pv, fv, t) - _ipmt(r, per, n, pv, fv, t), _bad_per, defaults=(0, 0))
_n("NPV", 2, 255, lambda r, *flows: sum((F.try_divide(v, _grow(r, F.lit(float(i)))) for i, v in enumerate(flows, 1)), F.lit(0.0)), (lambda r, *flows: r == -1, "#DIV/0!"))
_n("SLN", 3, 3, lambda c, s, n: F.try_divide(c - s, n), (lambda c, s, n: n == 0, "#DIV/0!"))
_n("SYD", 4, 4, lambda c, s, n, p: F.try_divide((c - s) * (n - p + 1) * 2, n * (n + 1)), (lambda c, s, n, p: (n <= 0) | (p < 1) | (p > n), "#NUM!"))


def _ddb(c, s, n, p, f):
    """The book value before a period, and what may still be taken off."""
    rate = F.least(F.try_divide(f, n), F.lit(1.0))
    before = F.greatest(c * F.pow(1 - rate, p - 1), F.least(s, c))
    return F.greatest(F.least(before * rate, before - s), F.lit(0.0))


_n("DDB", 4, 5, _ddb, (lambda c, s, n, p, f: (c < 0) | (s < 0) | (n <= 0) | (p < 1) | (p > n) | (f <= 0), "#NUM!"), defaults=(2,))


def _db(c, s, n, p, m):
    rate = F.floor((1 - F.pow(F.try_divide(s, c), F.try_divide(F.lit(1.0), n))) * 1000 + 0.5) / 1000
    first = c * rate * m / 12
    later = (c - first) * F.pow(1 - rate, p - 2) * rate
    last = (c - first) * F.pow(1 - rate, n - 1) * rate * (12 - m) / 12
    return F.when(c == 0, 0.0).when(p == 1, first).when(p <= n, later).otherwise(last)


_n("DB", 4, 5, _db, (lambda c, s, n, p, m: (c < 0) | (s < 0) | (n <= 0) | (p < 1) | (p > n + (m < 12).cast("int")) | (m < 1) | (m > 12), "#NUM!"), defaults=(12,))
