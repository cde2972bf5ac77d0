"""Scalar helpers: types and bit-level functions."""
