"""Training-data operators: dedup, tokens, filters, mixing, packing, output formats.

Nothing outside this subpackage imports it, so the rest of the library works
without it.  ``queries.py`` registers one query per operator.
"""
