"""Incremental runs over arriving shots."""
