"""Operators for training data made from free text. Nothing outside this package imports it."""
