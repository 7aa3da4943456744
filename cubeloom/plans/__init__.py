"""Fixture plans and the query catalogue."""
