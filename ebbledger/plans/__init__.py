"""Whole computations: the facts and the views."""
