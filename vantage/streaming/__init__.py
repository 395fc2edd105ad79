"""Incremental ingest of a file connection (C8 uploads + K1 materialise).

The viewer has no streams of its own. What it does over time is receive
uploads into a connection's folder and copy each table to Parquet; done
once per upload, that re-reads every file. Here a folder table is a
Structured Streaming file source: each run picks up only the files that
arrived since the last one (tracked in a checkpoint in the shared folder),
applies the same filter specs, and appends to a Parquet table, exactly once, or
(``ingest_replacing``) puts each upload in the place of the one that had its name.
"""

from vantage.streaming.ingest import ingest, ingest_replacing, watch

__all__ = ["watch", "ingest", "ingest_replacing"]
