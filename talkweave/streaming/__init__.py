"""Structured Streaming forms of the monitors, the reconciler and the chunk plan."""
