"""Scans, ingest checks, catalogues and sinks."""
