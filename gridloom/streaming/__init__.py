"""Formulas over streams."""
