"""Registered queries of the document operators, each with SQL that computes the same rows where SQL can."""

from docloom.plans.base import ORACLES, QUERIES
from docloom.plans import bilingual_queries, chat_queries, segment_queries, source_queries, text_queries, workflow_queries  # noqa: F401  # they register

__all__ = ["ORACLES", "QUERIES"]
