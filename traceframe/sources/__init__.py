"""Readers, writers and merges of trace data."""
