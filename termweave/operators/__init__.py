"""Relational operators of retrieval and entity linking."""
