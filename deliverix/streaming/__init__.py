"""Streaming entry points.

The reference has no streaming: every run rebuilds all tables from the raw
exports.  :mod:`ingest_stream` re-expresses that run on Structured
Streaming: new raw files landing in a folder are parsed (with quarantine)
and appended exactly once, then the batch build runs over the tables.
"""

from deliverix.streaming.ingest_stream import start_ingest_stream, tables_from_parquet

__all__ = ["start_ingest_stream", "tables_from_parquet"]
