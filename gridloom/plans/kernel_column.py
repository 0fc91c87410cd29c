"""Formulas as Arrow-batched Python Columns, for functions without a Spark
expression: the kernel evaluates the tree for each row (or group) of a batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .values import Value

_TEXT = set("CONCAT CONCATENATE LEFT RIGHT MID UPPER LOWER TRIM TEXT PROPER CLEAN CHAR UNICHAR FIXED SUBSTITUTE REPLACE REPT TEXTJOIN DOLLAR TEXTBEFORE TEXTAFTER TEXTSPLIT ROMAN BASE T ADDRESS FORMULATEXT".split())
_LOGICAL = set("AND OR XOR NOT TRUE FALSE EXACT ISBLANK ISNUMBER ISTEXT ISNONTEXT ISLOGICAL ISERROR ISERR ISNA ISEVEN ISODD ISREF ISFORMULA".split())
_RESULT = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType()), T.StructField("e", T.StringType())])


def _union(kinds: set[str]) -> str:
    kinds = kinds - {"z"}
    return kinds.pop() if len(kinds) == 1 else "s" if kinds else "n"


def kind_of(tree, columns: dict[str, str], names: Callable = lambda n: None) -> str:
    """The kind of a formula's results; of unlike kinds, text."""
    of = lambda t: kind_of(t, columns, names)
    kind = tree[0]
    if kind in ("num", "text", "bool", "empty", "err"):
        return {"num": "n", "text": "s", "bool": "b", "empty": "z", "err": "z"}[kind]
    if kind == "col":
        return columns.get(tree[1], "z")
    if kind == "name":
        found = names(tree[1])
        return of(found) if found else "z"
    if kind == "array":
        return _union({of(x) for row in tree[1] for x in row})
    if kind == "un":
        return of(tree[2]) if tree[1] == "+" else "n"
    if kind == "bin":
        return "s" if tree[1] == "&" else "b" if tree[1] in ("=", "<>", "<", ">", "<=", ">=") else "n"
    name, args = tree[1], tree[2]
    if name in _TEXT or name in _LOGICAL:
        return "s" if name in _TEXT else "b"
    if name == "IF":
        return _union({of(a) for a in args[1:]} | ({"b"} if len(args) == 2 else set()))
    if name in ("IFS", "CHOOSE", "IFERROR", "IFNA"):
        return _union({of(a) for a in (args[1::2] if name == "IFS" else args[1:] if name == "CHOOSE" else args)})
    if name == "SWITCH":
        return _union({of(a) for a in args[2::2]} | ({of(args[-1])} if len(args) % 2 == 0 else set()))
    if name in ("VLOOKUP", "HLOOKUP") and args[1][0] == "array" and args[2][0] == "num":
        rows, k = args[1][1], int(args[2][1]) - 1
        if 0 <= k < len(rows[0] if name == "VLOOKUP" else rows):
            return _union({of(x) for x in ([r[k] for r in rows] if name == "VLOOKUP" else rows[k])})
    if name in ("INDEX", "SORT", "SORTBY", "UNIQUE", "FILTER"):
        return of(args[0])
    if name in ("LOOKUP", "XLOOKUP"):
        return _union({of(args[2] if len(args) > 2 else args[1])} | ({of(args[3])} if len(args) > 3 else set()))
    return "n"


def kernel_column(tree, arguments: dict[str, Column], kind: str, macros: dict, names: dict[str, object], ranges: bool = False) -> Value:
    """The tree's value over columns; with ``ranges``, each is an array column
    and stands for a column of cells. Of an array, the first cell is taken."""
    order = list(arguments)

    @F.pandas_udf(_RESULT)
    def run(*series: pd.Series) -> pd.DataFrame:
        from gridloom.kernel.cells import Err, Grid, text
        from gridloom.kernel.evaluate import Cells, Evaluator, shown

        class Named(Cells):
            def name(self, name):
                return names.get(name)

        def cell(x):
            if x is None or x is pd.NA or (isinstance(x, float) and x != x):
                return None
            return x if isinstance(x, str) else bool(x) if type(x).__name__ in ("bool", "bool_") else float(x)

        def one(x):
            return Grid([[cell(v)] for v in x]) if ranges and x is not None and len(x) else cell(None) if ranges else cell(x)

        out = []
        for values in zip(*(s.tolist() if not ranges else s for s in series)):
            x = shown(Evaluator(Named(), columns=dict(zip(order, map(one, values))), macros=macros).value(tree))
            while isinstance(x, Grid):
                x = shown(x.rows[0][0])
            if isinstance(x, Err):
                out.append((None, None, None, x.code))
            elif kind == "s":
                out.append((None, text(x), None, None))
            elif kind == "b":
                out.append((None, None, bool(x), None))
            else:
                out.append((float(x) if not isinstance(x, str) else None, None, None, "#VALUE!" if isinstance(x, str) else None))
        return pd.DataFrame(out, columns=["n", "s", "b", "e"]).astype({"n": "float64", "s": "object", "b": "object", "e": "object"})

    got = run(*[arguments[c] for c in order])
    return Value(got[kind if kind in "nsb" else "n"], kind if kind in "nsb" else "n", got["e"])
