"""The registered queries of the engine."""

from tidewire.plans import accounts, answers, articles, context, corpus, details, events, maintenance, pages, personal, relational, retrieval  # noqa: F401
from tidewire.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
