"""Operators for training data from agent traces and texts. Nothing else in the library imports this package."""
