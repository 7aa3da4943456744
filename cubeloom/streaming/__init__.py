"""Append workloads: incremental cubes, caches that take new results."""
