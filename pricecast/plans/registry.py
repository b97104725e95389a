"""Imports every query module so its ``@register`` entries are recorded."""

from __future__ import annotations

from pricecast.plans import (eval_queries, feature_queries, meta_queries, null_queries,  # noqa: F401
                             model_queries, serve_queries)
from pricecast.plans.catalog import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
