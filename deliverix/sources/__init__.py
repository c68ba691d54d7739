"""Readers and writers.

``MarketTables`` is the canonical input of every job: the eight marketplace
tables of the reference (the geo table is never queried and not carried).
It is produced either by :func:`csv_ingest.ingest_csv` (raw CSV exports) or
by :func:`testdata.load_testdata` (driver star-schema parquet).
"""

from deliverix.sources.tables import MarketTables

__all__ = ["MarketTables"]
