"""Operators for large text corpora (cleaning, deduplication, tokenising, scoring, search).

Nothing outside this subpackage imports it; ``queries.py`` registers its queries.
"""
