"""Operators of a training-data pipeline: cleaning, duplicates, leaks, mixing, archives and scoring.

Nothing else in the library imports this package.
"""
