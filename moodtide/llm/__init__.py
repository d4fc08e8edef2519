"""Operators for preparing training data: filters, deduplication, packing and sharding of documents.

Every operator reads only the columns it names, so extra columns of any name
pass by or are left out, and never clash with its own.
"""
