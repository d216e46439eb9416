"""Readers, writers and the binding of the driver's tables to history tables."""
