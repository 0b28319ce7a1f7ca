"""Whole builds and runs composed of operators."""
