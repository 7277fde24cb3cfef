"""Operators that prepare crawled text for training language models.

Nothing outside this subpackage imports it. ``queries.py`` holds the thin
queries, ``sql.py`` the SQL they are compared with.
"""
