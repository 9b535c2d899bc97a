"""Training-data operators: search, near-duplicates, scoring, archives, tokens, filters.

Nothing outside this subpackage imports it.  Every module holds one operator
with a general interface; ``queries`` derives the registered result tables.
"""
