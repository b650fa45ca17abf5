"""Packet ingest as a keyed stateful stream."""
