"""Spreadsheet formulas as Spark plans."""

from .kernel.cells import Err, Grid, compare, criterion, logical, number, number_text, text
from .kernel.evaluate import Cells, Evaluator, evaluate
from .plans.formula import FormulaError, column_letters, column_number, parse, serialise, tokens

__all__ = ["Cells", "Err", "Evaluator", "FormulaError", "Grid", "column_letters", "column_number", "compare", "criterion", "evaluate", "logical", "number", "number_text", "parse", "serialise", "text", "tokens"]
