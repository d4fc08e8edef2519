"""Registered queries, each with the SQL that gives the same answer where SQL can."""

from __future__ import annotations

from moodtide.queries import features, files, jobs, model, scalar, series, streams, texts
from moodtide.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "features", "files", "jobs", "model", "scalar", "series", "streams", "texts"]
