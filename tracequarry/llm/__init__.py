"""Training-data operators: token counts, near-duplicate joins, filters, extraction, mixing, sharding.

Nothing outside this subpackage imports it.  ``queries.py`` registers the thin digest queries.
"""
