"""Readers of trace files, and adapters to canonical events."""
