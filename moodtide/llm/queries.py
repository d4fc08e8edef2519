"""All queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from moodtide.llm import (
    binary,
    conversations,
    decontaminate,
    hardnegatives,
    jaccard,
    minslack,
    quality,
    quotations,
    secrets,
    sharding,
    simhash,
    substrings,
    toxicity,
)
from moodtide.llm.registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "binary", "conversations", "decontaminate", "hardnegatives", "jaccard", "minslack", "quality", "quotations", "secrets", "sharding", "simhash",
    "substrings", "toxicity",
]
