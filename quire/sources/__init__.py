"""Readers for the input tables and derived views; sinks."""

from quire.sources.tables import read_table  # noqa: F401
