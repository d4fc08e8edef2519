"""Structured Streaming forms; they share every operator with the batch jobs."""
