"""Readers, writers and the tables derived from the supplied Parquet files."""
