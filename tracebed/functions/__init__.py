"""Scalar functions: format strings, packed values, clocks."""
