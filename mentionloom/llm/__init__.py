"""Operators for training data made of text. Nothing else in the library imports this subpackage."""
