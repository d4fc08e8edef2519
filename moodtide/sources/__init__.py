"""Scans: files, listings and message streams as DataFrames."""
