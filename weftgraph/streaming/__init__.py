"""Logs that grow while they are read."""

from .ingest import last_entries_stream, rates_stream, upsert_last

__all__ = ["last_entries_stream", "rates_stream", "upsert_last"]
