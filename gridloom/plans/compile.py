"""Syntax trees to Columns: row-wise formulas and measures.

What holds no column is a constant: the kernel evaluates it while the plan is
made. Arrays in a row-wise formula have a known shape, so operators and scalar
functions are lifted over them here, element by element, and range functions
fold them. Only a function without a Spark expression becomes a Python Column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import aggregate as A
from ..functions.scalar import FUNCTIONS, SERIAL_ZERO, to_serial
from ..kernel.cells import Err, Fail, Grid, grid, logical as truth_of, numbers
from ..kernel.evaluate import Cells, Evaluator
from ..kernel.library import LIBRARY
from .formula import parse
from .kernel_column import kernel_column, kind_of
from .values import Value, compare, error, error_if, first_error, guarded, literal, number, snap, text

_CONDITIONAL = {"SUMIF", "COUNTIF", "AVERAGEIF", "SUMIFS", "COUNTIFS", "AVERAGEIFS", "MAXIFS", "MINIFS"}
_TESTS = ("=", "<>", "<", ">", "<=", ">=")
_VOLATILE = {"TODAY", "NOW"}
#: Functions whose arrays' shapes are known only with their arguments.
_DYNAMIC = {"SEQUENCE", "UNIQUE", "SORT", "SORTBY", "FILTER", "TEXTSPLIT"}
#: Range functions that are built from the values of one row, one after another.
_SPREADING = {"AND", "OR", "XOR", "CONCAT", "GCD", "LCM", "NPV", "TEXTJOIN"}
_KINDS = {"SLOPE", "INTERCEPT", "COVAR", "CORREL"}


@dataclass(frozen=True)
class Block:
    """An array of known shape, by rows."""

    rows: tuple[tuple[Value, ...], ...]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.rows), len(self.rows[0])

    def flat(self) -> list[Value]:
        return [v for r in self.rows for v in r]


def columns_of(df: DataFrame) -> dict[str, Value]:
    """A table's columns as values; dates and timestamps become serial numbers."""
    out = {}
    for f in df.schema.fields:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if isinstance(t, T.StringType):
            out[f.name] = Value(c, "s")
        elif isinstance(t, T.BooleanType):
            out[f.name] = Value(c, "b")
        elif isinstance(t, T.NumericType):
            out[f.name] = Value(c.cast("double"), "n")
        elif isinstance(t, T.DateType):
            out[f.name] = Value(to_serial(c), "n")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            day = F.to_date(c)
            out[f.name] = Value(to_serial(c) + (F.unix_micros(c.cast("timestamp")) - F.unix_micros(day.cast("timestamp"))) / 86400e6, "n")
    return out


def value_of(x) -> Value | Block:
    """A constant as a value."""
    if isinstance(x, Grid):
        return Block(tuple(tuple(value_of(v) for v in row) for row in x.rows))
    if isinstance(x, Err):
        return error(x.code)
    return Value(F.lit(None), "z") if x is None else literal(x)


def lifted(f, args: list) -> Value | Block:
    """f element by element over the arrays among the arguments."""
    shapes = [a.shape for a in args if isinstance(a, Block)]
    if not shapes:
        return f(*args)
    h, w = max(s[0] for s in shapes), max(s[1] for s in shapes)

    def at(a, i, j):
        if not isinstance(a, Block):
            return a
        m, n = a.shape
        i, j = 0 if m == 1 else i, 0 if n == 1 else j
        return a.rows[i][j] if i < m and j < n else error("#N/A")

    return Block(tuple(tuple(f(*[at(a, i, j) for a in args]) for j in range(w)) for i in range(h)))


class Compiler:
    """precision: "fast" snaps a sum to 14 digits where it is compared or
    written as text; "snap" at once."""

    def __init__(self, columns: dict[str, Value], names: dict[str, str] | None = None, macros: dict[str, Callable] | None = None, precision: str = "fast", order: list[str] | None = None):
        self.columns, self.names, self.macros, self.precision, self.order = columns, names or {}, macros or {}, precision, order or []

    def formula(self, source: str) -> Value:
        """Of an array, the first element."""
        got = self.of(parse(source))
        return got.rows[0][0] if isinstance(got, Block) else got

    # what a tree holds
    def _parts(self, t):
        """The trees below, names resolved; stops at calls of macros."""
        if t[0] == "name" and t[1] in self.names:
            return [parse(self.names[t[1]])]
        if t[0] == "un":
            return [t[2]]
        if t[0] == "bin":
            return [t[2], t[3]]
        return list(t[2]) if t[0] == "call" else []

    def holds_column(self, t) -> bool:
        return t[0] == "col" or any(map(self.holds_column, self._parts(t)))

    def _columns_in(self, t) -> set[str]:
        return ({t[1]} if t[0] == "col" else set()).union(*map(self._columns_in, self._parts(t)))

    def constant(self, t) -> bool:
        if t[0] in ("col", "cell", "range") or (t[0] == "call" and (t[1] in self.macros or t[1] in _VOLATILE)):
            return False
        return all(map(self.constant, self._parts(t)))

    def dynamic(self, t) -> bool:
        """Whether an array below has a shape that differs from row to row."""
        return (t[0] == "call" and t[1] in _DYNAMIC and self.holds_column(t)) or any(map(self.dynamic, self._parts(t)))

    def constant_value(self, t):
        """Of a tree without columns, by the kernel; an error value is returned."""
        trees = {n: parse(s) for n, s in self.names.items()}

        class Named(Cells):
            def name(self, name):
                return trees.get(name)

        return Evaluator(Named()).value(t)

    # trees to values
    def of(self, t) -> Value | Block:
        kind = t[0]
        if kind == "empty":
            return Value(F.lit(None), "z")
        if kind in ("num", "text", "bool"):
            return literal(t[1])
        if kind in ("bin", "un", "call", "array") and self.constant(t):
            return value_of(self.constant_value(t))
        if kind in ("bin", "un", "call") and self.dynamic(t):
            return self._kernel(t)
        if kind == "err":
            return error(t[1])
        if kind == "col":
            return self.columns.get(t[1]) or error("#REF!")
        if kind == "name":
            return self.of(parse(self.names[t[1]])) if t[1] in self.names else error("#NAME?")
        if kind == "un":
            return lifted(lambda v: self._unary(t[1], v), [self.of(t[2])])
        if kind == "bin":
            a, b = self.of(t[2]), self.of(t[3])
            if self.precision == "fast" and (t[1] == "&" or t[1] in _TESTS):
                a, b = self._snapped(t[2], a), self._snapped(t[3], b)
            return lifted(lambda x, y: self._binary(t[1], x, y), [a, b])
        if kind == "call":
            return self._call(t[1], t[2])
        return error("#VALUE!")

    def _snapped(self, t, v):
        if t[0] == "bin" and t[1] in "+-":
            return lifted(lambda x: Value(snap(x.col), "n", x.err), [v])
        return v

    def _unary(self, op: str, v: Value) -> Value:
        if op == "+":
            return v
        n = number(v)
        return Value(-n.col if op == "-" else n.col / 100, "n", n.err)

    def _binary(self, op: str, a: Value, b: Value) -> Value:
        if op == "&":
            a, b = text(a), text(b)
            return guarded(F.concat(a.col, b.col), "s", a.err, b.err)
        if op in _TESTS:
            return compare(op, a, b)
        x, y = number(a), number(b)
        if op == "/":
            return guarded(F.try_divide(x.col, y.col), "n", x.err, y.err, error_if(y.col == 0, "#DIV/0!"))
        if op == "^":
            return FUNCTIONS["POWER"][2](a, b)
        got = {"+": x.col + y.col, "-": x.col - y.col, "*": x.col * y.col}.get(op)
        if got is None:
            return error("#NULL!")
        if op != "*" and self.precision == "snap":
            got = snap(got)
        return guarded(got, "n", x.err, y.err)

    def _call(self, name: str, args: list) -> Value | Block:
        if name in self.macros:
            return self.macros[name](*[self.of(a) for a in args])
        if name == "TODAY":
            return Value(to_serial(F.current_date()), "n")
        if name == "NOW":
            return Value(F.unix_micros(F.current_timestamp()) / 86400e6 + 25569, "n")
        if name not in FUNCTIONS and name not in LIBRARY:
            return error("#NAME?")
        least, most = (LIBRARY[name].least, LIBRARY[name].most) if name in LIBRARY else FUNCTIONS[name][:2]
        if not least <= len(args) <= most:
            return error("#N/A")
        got = self._native(name, args)
        return got if got is not None else self._kernel(("call", name, args))

    def _cells(self, args: list) -> list[tuple[Value, bool]]:
        out = []
        for a in map(self.of, args):
            out += [(v, True) for v in a.flat()] if isinstance(a, Block) else [(a, False)]
        return out

    def _native(self, name: str, args: list) -> Value | Block | None:
        """By Spark's expressions, if there are any."""
        if name in A.ROW_AGGREGATES:
            return A.row_aggregate(name, self._cells(args), number)
        if name == "COUNT":
            return A.row_count(self._cells(args), number)
        if name == "COUNTA":
            return A.row_counta(self._cells(args))
        if name in ("LARGE", "SMALL"):
            return self._nth(name, args)
        if name in ("VLOOKUP", "HLOOKUP", "MATCH", "LOOKUP") and all(map(self.constant, args[1:])):
            return self._looked_up(name, args)
        if name == "SUMPRODUCT":
            blocks = [b if isinstance(b, Block) else Block(((b,),)) for b in map(self.of, args)]
            if len({b.shape for b in blocks}) > 1:
                return error("#VALUE!")
            total, errors = F.lit(0.0), []
            for row in zip(*[b.flat() for b in blocks]):
                errors += [v.err for v in row if v.err is not None]
                term = F.lit(1.0)
                for v in row:
                    term = term * (F.coalesce(v.col, F.lit(0.0)) if v.kind == "n" else F.lit(0.0))
                total = total + term
            return guarded(total, "n", *errors)
        if name not in FUNCTIONS or len(args) > FUNCTIONS[name][1]:
            return None
        build = FUNCTIONS[name][2]
        values = [self.of(a) for a in args]
        if name in _SPREADING:
            if name in ("AND", "OR", "XOR"):  # texts and blanks of arrays are skipped
                values = [v for v, inside in self._cells(args) if not inside or v.kind in "nb"]
            else:
                values = [v for v, inside in self._cells(args) if not inside or v.kind == "n" or name in ("CONCAT", "TEXTJOIN")]
            return build(*values) if values else error("#VALUE!")
        if name == "IFERROR" and isinstance(values[0], Block):
            return values[1]
        return lifted(build, values)

    def _nth(self, name: str, args: list) -> Value:
        xs, errors = A._row_numbers([(v, True) for v, _ in self._cells(args[:1])], number)
        k = number(self.of(args[1]))
        at = F.floor(k.col).cast("int")
        bad = error_if((k.col < 1) | (at > F.size(xs)), "#NUM!")
        return guarded(F.get(F.sort_array(xs, asc=name == "SMALL"), at - 1), "n", *errors, k.err, bad)

    def _looked_up(self, name: str, args: list) -> Value | None:
        """A key looked up in constants: tested one after another."""
        x, rest = self.of(args[0]), [self.constant_value(a) for a in args[1:]]
        if isinstance(x, Block) or any(isinstance(r, Err) for r in rest):
            return None
        table = grid(rest[0]) if name != "HLOOKUP" else grid(rest[0]).turned()
        if name in ("VLOOKUP", "HLOOKUP"):
            keys, k = [r[0] for r in table.rows], rest[1]
            near = len(rest) < 3 or truth_of(rest[2])
            if not isinstance(k, float) or not 1 <= k < len(table.rows[0]) + 1:
                return None
            values = [r[int(k) - 1] for r in table.rows]
        elif name == "MATCH":
            how = rest[1] if len(rest) > 1 else 1.0
            if how not in (0.0, 1.0) or min(table.shape) != 1:
                return None
            keys, near = table.flat(), how == 1.0
            values = [i + 1.0 for i in range(len(keys))]
        else:
            wide = table.shape[1] > table.shape[0]
            lines = table.rows if wide else table.turned().rows
            keys, values = (table.flat(), grid(rest[1]).flat()) if len(rest) > 1 else (lines[0], lines[-1])
            near = True
            if len(values) < len(keys):
                return None
        places = range(len(keys) - 1, -1, -1) if near else range(len(keys))
        kinds = {value_of(v).kind for v in values}
        if len(kinds) != 1 or any(isinstance(v, Err) for v in (*keys, *values)):
            return None
        hit = F.lit(None).cast("int")
        tests = []
        for i in places:
            key = value_of(keys[i])
            if key.kind == x.kind or (x.kind == "z" and key.kind == "n"):
                tests.append((i, compare(">=" if near else "=", x, key).col))
        for i, test in reversed(tests):
            hit = F.when(F.coalesce(test, F.lit(False)), i).otherwise(hit)
        found = F.get(F.array(*[value_of(v).col for v in values]), hit)
        return guarded(found, kinds.pop(), x.err, error_if(hit.isNull(), "#N/A"))

    def _kernel(self, t) -> Value:
        used = {c: self.columns[c] for c in self._columns_in(t) if c in self.columns}
        trees = {n: parse(s) for n, s in self.names.items()}
        kind = kind_of(t, {c: v.kind for c, v in self.columns.items()}, trees.get)
        arguments = {c: v.col for c, v in used.items()} or {"": F.lit(0)}
        got = kernel_column(t, arguments, kind, {}, trees)
        before = first_error(*(v.err for v in used.values()))
        return got if before is None else Value(got.col, got.kind, F.coalesce(before, got.err))


class MeasureCompiler(Compiler):
    """Formulas over whole columns; what stands inside an aggregate is row-wise.
    order: columns that say which row comes first, where that counts. sides: gets
    what a table beside the rows must give for each group first (``A.Side``);
    without it the kernel does these functions."""

    def __init__(self, columns, *args, sides: list | None = None, **kw):
        super().__init__(columns, *args, **kw)
        self.rows = Compiler(columns, *args, **kw)
        self.sides = sides

    def _aggregates(self, t) -> bool:
        own = t[0] == "call" and t[1] in LIBRARY and LIBRARY[t[1]].mode == "range" and t[1] not in _SPREADING and self.holds_column(t)
        return own or any(map(self._aggregates, self._parts(t)))

    def _range(self, t) -> Value:
        if self._aggregates(t):
            raise ValueError("an aggregate inside a measure's range: make it a measure of its own")
        got = self.rows.of(t)
        if isinstance(got, Block):
            raise ValueError("an array inside a measure's range")
        return got

    def _fixed(self, t):
        """A constant argument, as a Python value."""
        if not self.constant(t):
            raise ValueError("a criterion or parameter must be a constant of the formula")
        got = self.constant_value(t)
        if isinstance(got, Err):
            raise Fail(got)
        return got

    def _split(self, args: list) -> tuple[list[Value], list]:
        """Ranges, and the values of the constant arguments."""
        ranges = [self._range(a) for a in args if not self.constant(a)]
        return ranges, [self._fixed(a) for a in args if self.constant(a)]

    def _native(self, name: str, args: list) -> Value | Block | None:
        if not any(map(self.holds_column, args)):
            return super()._native(name, args)
        try:
            return self._measure(name, args)
        except Fail as e:
            return error(e.error.code)

    def _measure(self, name: str, args: list) -> Value | Block | None:
        if name in _CONDITIONAL:
            if name in ("SUMIF", "COUNTIF", "AVERAGEIF"):
                target = self._range(args[2] if len(args) > 2 else args[0])
                return A.conditional(name, target, [(self._range(args[0]), self._fixed(args[1]))])
            target, rest = (None, args) if name == "COUNTIFS" else (self._range(args[0]), args[1:])
            return A.conditional(name, target, [(self._range(a), self._fixed(c)) for a, c in zip(rest[::2], rest[1::2])])
        if name in ("PERCENTILE", "QUARTILE"):
            k = numbers([self._fixed(args[1])])[0]
            return A.percentile(self._range(args[0]), k if name == "PERCENTILE" else int(k) / 4, self.order)
        if name == "FORECAST":
            return A.forecast(numbers([self._fixed(args[0])])[0], [self._range(a) for a in args[1:]], self.order)
        if name in _KINDS:
            return A.AGGREGATES[name]([self._range(a) for a in args], [], self.order)
        if name in A.AGGREGATES:
            ranges, fixed = self._split(args)
            if name == "COUNT":
                return A.AGGREGATES[name](ranges, [0.0] * int(LIBRARY["COUNT"].run(*fixed) if fixed else 0), self.order)
            return A.AGGREGATES[name](ranges, numbers(fixed), self.order)
        if name == "COUNTA":
            ranges, fixed = self._split(args)
            return A.counta(ranges, int(LIBRARY["COUNTA"].run(*fixed)) if fixed else 0)
        if name == "COUNTBLANK":
            return A.countblank(self._range(args[0]))
        if name in ("AND", "OR", "XOR"):
            ranges, fixed = self._split(args)
            return A.truth(name, ranges, [truth_of(x) for f in fixed for x in grid(f).flat()], self.order)
        if name == "ROWS":
            return Value(F.count("*").cast("double"), "n")
        if name in A.SIDED and self.sides is not None:
            places = [(self._range(a), []) if not self.constant(a) else (None, numbers([self._fixed(a)])) for a in args]
            side = A.Side(f"_gridloom_side{len(self.sides)}", name, places)
            self.sides.append(side)
            return A.SIDED[name](side, self.order)
        if name in FUNCTIONS and name not in _SPREADING:
            return super()._native(name, args)
        return self._grouped(name, args)

    def _grouped(self, name: str, args: list) -> Value:
        """The kernel over a group's cells, in the rows' order: for functions that
        are no aggregate in Spark. A group's cells are held together."""
        arguments, trees, kinds, errors = {}, [], {}, []
        for i, a in enumerate(args):
            if self.constant(a):
                trees.append(a)
                continue
            v, key = self._range(a), f"range {i}"
            packed = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(self.order)], v.col.alias("v"))))
            arguments[key] = F.transform(packed, lambda x: x["v"])
            kinds[key] = v.kind
            if v.err is not None:
                errors.append(A.first_error_of([v], self.order))
            trees.append(("col", key))
        t = ("call", name, trees)
        names = {n: parse(s) for n, s in self.names.items()}
        got = kernel_column(t, arguments, kind_of(t, kinds, names.get), {}, names, ranges=True)
        before = first_error(*errors)
        return got if before is None else Value(got.col, got.kind, F.coalesce(before, got.err))


__all__ = ["Block", "Compiler", "MeasureCompiler", "columns_of", "SERIAL_ZERO", "Column"]
