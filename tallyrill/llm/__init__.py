"""Training-data operators: ten operators for document corpora, one module each.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_*`` queries and their SQL.
"""
