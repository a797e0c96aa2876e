"""Imports every module that registers queries."""

from hustings.plans import io_queries, score_queries, space_queries, table_queries, tally_queries  # noqa: F401
