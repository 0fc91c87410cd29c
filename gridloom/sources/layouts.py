"""Workbooks of one layout, evaluated together.

Two workbooks have one layout if the same cells hold numbers and the others the
same formulas. A layout's formulas are parsed and ordered once, then each is
worked out for all its workbooks: numbers, references, + - * / %, ROW and COLUMN
of the cell itself, and SUM, AVERAGE, MIN, MAX, COUNT of cells. Whatever else a
layout holds leaves its workbooks to ``Workbook``, and so does a workbook of
which a step gives an error or no finite number. Results are ``Workbook``'s to
the last bit.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

from ..kernel.cells import Err
from ..operators.workbook import is_formula, parse_content
from ..plans.formula import FormulaError, parse

Cell = tuple[str, int, int]
#: Workbooks of one layout from which a plan is worth its making.
LEAST = 4
_FOLDS: dict[str, Callable] = {"SUM": sum, "AVERAGE": lambda xs: sum(xs) / len(xs), "MIN": min, "MAX": max, "COUNT": len}


class Unsupported(Exception):
    """A layout that only a workbook can evaluate."""


@lru_cache(20_000)
def parsed_formula(content: str) -> tuple:
    try:
        return parse(content)
    except FormulaError:
        raise Unsupported from None


def snapped(x: np.ndarray) -> np.ndarray:
    return np.array([float(f"{v:.13e}") for v in x.tolist()])


class Plan:
    """cells in order, each with its formula or None for a number."""

    def __init__(self, cells: list[Cell], formulas: list[str | None], macros: dict):
        self.at = {k: i for i, k in enumerate(cells)}
        self.cells, self.macros = cells, macros
        self.sheets = {}
        for s in {k[0] for k in cells}:
            if self.sheets.setdefault(s.lower(), s) != s:
                raise Unsupported
        self.steps: list[tuple[int, Callable]] = []
        made, reads = {}, {}
        for i, f in enumerate(formulas):
            if f is not None:
                reads[i] = set()
                made[i] = self._compiled(parsed_formula(f), cells[i], reads[i])
        done = {i for i, f in enumerate(formulas) if f is None}
        for root in made:
            work = [(root, iter(reads[root]))] if root not in done else []
            on = {root}
            while work:
                i, more = work[-1]
                j = next((j for j in more if j not in done), None)
                if j is None:
                    work.pop()
                    on.discard(i)
                    done.add(i)
                    self.steps.append((i, made[i]))
                elif j in on:
                    raise Unsupported  # a cycle
                else:
                    on.add(j)
                    work.append((j, iter(reads[j])))

    def _place(self, t, here: Cell) -> Cell:
        sheet = here[0] if t[1] is None else self.sheets.get(t[1].lower())
        if sheet is None:
            raise Unsupported
        return (sheet, t[3][0], t[2][0])

    def _inside(self, t, here: Cell) -> list[int]:
        """Filled cells of a reference, by rows."""
        a, b = (t, t) if t[0] == "cell" else (t[1], t[2])
        sheet, r0, c0 = self._place(a, here)
        (r0, r1), (c0, c1) = sorted((r0, b[3][0])), sorted((c0, b[2][0]))
        return sorted((i for k, i in self.at.items() if k[0] == sheet and r0 <= k[1] <= r1 and c0 <= k[2] <= c1), key=lambda i: self.cells[i][1:])

    def _compiled(self, t, here: Cell, reads: set[int]) -> Callable:
        """f(values of all cells, workbooks to leave out) -> the tree's values."""
        kind = t[0]
        if kind == "num":
            return lambda v, bad, x=float(t[1]): np.full(v.shape[1], x)
        if kind == "cell":
            i = self.at.get(self._place(t, here))
            if i is None:
                return lambda v, bad: np.zeros(v.shape[1])
            reads.add(i)
            return lambda v, bad: v[i]
        if kind == "un":
            x = self._compiled(t[2], here, reads)
            if t[1] == "-":
                return lambda v, bad: -x(v, bad)
            return x if t[1] == "+" else lambda v, bad: x(v, bad) / 100
        if kind == "bin" and t[1] in ("+", "-", "*", "/"):
            return self._pair(t[1], self._compiled(t[2], here, reads), self._compiled(t[3], here, reads))
        if kind == "call" and t[1] not in self.macros:
            if t[1] in ("ROW", "COLUMN") and not t[2]:
                return lambda v, bad, x=here[1 if t[1] == "ROW" else 2] + 1.0: np.full(v.shape[1], x)
            if t[1] in _FOLDS and t[2] and all(a[0] in ("cell", "range") for a in t[2]):
                return self._fold(t[1], [i for a in t[2] for i in self._inside(a, here)], reads)
        raise Unsupported

    @staticmethod
    def _pair(op: str, x: Callable, y: Callable) -> Callable:
        def run(v, bad):
            a, b = x(v, bad), y(v, bad)
            if op == "/":
                bad |= b == 0
            got = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b
            bad |= ~np.isfinite(got)
            return snapped(got) if op in "+-" else got

        return run

    @staticmethod
    def _fold(name: str, inside: list[int], reads: set[int]) -> Callable:
        reads.update(inside)
        if not inside:
            if name == "AVERAGE":
                raise Unsupported
            return lambda v, bad: np.zeros(v.shape[1])
        f = _FOLDS[name]
        return lambda v, bad: np.array([f(xs) for xs in v[inside].T.tolist()], float)

    def run(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values by cells and workbooks, and which workbooks can't be taken."""
        values = np.array(numbers, float)
        bad = ~np.isfinite(values).all(axis=0)
        with np.errstate(all="ignore"):
            for i, step in self.steps:
                got = step(values, bad)
                bad |= ~np.isfinite(got)
                values[i] = np.where(got == 0, 0.0, got)
        return values, bad


class Layouts:
    """Plans of the layouts met so far."""

    def __init__(self, macros: dict | None = None, most: int = 2_000):
        self.macros, self.most, self.plans = macros or {}, most, {}

    def plan(self, cells: tuple[Cell, ...], formulas: tuple) -> Plan | None:
        key = cells, formulas
        if key not in self.plans:
            if len(self.plans) >= self.most:
                self.plans.clear()
            try:
                self.plans[key] = Plan(list(cells), list(formulas), self.macros)
            except Unsupported:
                self.plans[key] = None
        return self.plans[key]

    def evaluate(self, book, sheet, row, column, contents, known: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of cells in the order of their books, sheets, rows and columns: their
        values, which of them are settled, and which are formulas. book: numbers
        from 0; sheet and contents: places in the lists of ``known``."""
        sheets, texts = known
        number, marker = np.zeros(len(texts) + 1), np.full(len(texts) + 1, -2)
        for i, x in enumerate(texts):
            got = parse_content(x)
            if is_formula(got):
                marker[i] = i
            elif isinstance(got, float) and not isinstance(got, Err):
                marker[i], number[i] = -1, got
        mark, n = marker[contents], number[contents]
        settled, formula = np.zeros(len(book), bool), mark >= 0
        begins = np.flatnonzero(np.diff(book, prepend=-1))
        sizes = np.diff(begins, append=len(book))
        shape = np.stack([sheet, row, column, mark])
        same = np.ones(len(book), bool)
        same[1:] = (shape[:3, 1:] == shape[:3, :-1]).all(axis=0) & (book[1:] == book[:-1])
        odd = np.logical_or.reduceat((mark == -2) | np.r_[False, same[1:]], begins)
        with np.errstate(over="ignore"):
            mixed = (np.arange(1, 5, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) * (shape.astype(np.uint64) + np.uint64(7))).sum(axis=0, dtype=np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            sums = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), begins)
        rest = np.flatnonzero(~odd)
        order = rest[np.lexsort((sums[rest], sizes[rest]))]
        cuts = np.flatnonzero((np.diff(sizes[order]) != 0) | (np.diff(sums[order].astype(np.int64)) != 0)) + 1
        for books in np.split(order, cuts):
            if len(books) < LEAST:
                continue
            at = begins[books][None, :] + np.arange(sizes[books[0]])[:, None]
            alike = (shape[:, at] == shape[:, at[:, :1]]).all(axis=(0, 1))
            at = at[:, alike]
            first = at[:, 0]
            cells = tuple((sheets[s], int(r), int(c)) for s, r, c in zip(sheet[first], row[first], column[first]))
            plan = self.plan(cells, tuple(texts[m] if m >= 0 else None for m in mark[first]))
            if plan is not None:
                values, bad = plan.run(n[at])
                good = at[:, ~bad]
                n[good], settled[good] = values[:, ~bad], True
        return n, settled, formula
