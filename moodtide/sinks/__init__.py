"""Sinks: every write is distributed, nothing passes through the driver."""
