"""Formula values and functions one at a time, for what is no Column: constants
of a plan, cells of a workbook, and the functions Spark has no expression for."""
