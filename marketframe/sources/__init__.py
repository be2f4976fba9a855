"""Readers, ingest rules and sinks."""
