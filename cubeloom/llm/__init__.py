"""Training-data operators: scoring, deduplication, extraction, filtering, tokenising.

Nothing outside this subpackage imports it.  ``queries`` registers one thin
query per operator; the operators themselves keep general interfaces.
"""
