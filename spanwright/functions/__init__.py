"""Scalar building blocks shared by all operators."""
