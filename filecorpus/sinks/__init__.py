"""Sinks: delivery of batches to an API, and tables."""
