"""Inventory and fingerprinting of large file and document collections on Spark."""
