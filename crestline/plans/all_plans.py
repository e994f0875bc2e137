"""Imports every module that registers queries, and hands the registry on."""

from crestline.plans import catalog_plans, chat_plans, function_plans, moments, source_plans, stream_plans, text_plans  # noqa: F401
from crestline.plans.catalog import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
