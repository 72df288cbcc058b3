"""Scalar functions and the parsing of names."""
