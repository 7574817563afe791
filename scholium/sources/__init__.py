"""Readers and writers."""

from scholium.sources.keyed import KeyedTable
from scholium.sources.tables import Tables, event_stream, parquet_stream, pin_utc

__all__ = ["KeyedTable", "Tables", "event_stream", "parquet_stream", "pin_utc"]
