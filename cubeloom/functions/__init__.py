"""Scalar functions on names, sequences and distributions."""
