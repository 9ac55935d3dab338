"""All core queries and their SQL equivalents."""

from __future__ import annotations

from . import aggregate_queries, dedup_queries, extra_queries, io_queries, line_queries, more_queries, relational_queries, stats_queries, stream_queries, text_queries, tokenizer_queries  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
