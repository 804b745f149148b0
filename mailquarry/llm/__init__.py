"""Operators for training-data preparation on text. Nothing outside this package imports it."""
