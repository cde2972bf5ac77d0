"""Operators that turn plans into DataFrame expressions."""
