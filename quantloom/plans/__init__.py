"""Whole research runs: named result tables built from the operators."""
