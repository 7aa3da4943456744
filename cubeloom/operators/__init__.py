"""Operators on count cubes, hierarchies, sequences and key lists: ``DataFrame -> DataFrame``."""
