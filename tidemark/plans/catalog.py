"""All registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import asof_queries, coverage_queries, episode_queries, evaluation_queries, extraction_queries, forecast_queries, issuance_queries, link_queries, metric_queries, model_queries, profile_queries, record_queries, revision_queries, source_queries, stream_queries, text_queries, timing_queries, training_queries, validation_queries

_MODULES = (revision_queries, metric_queries, text_queries, model_queries, episode_queries, evaluation_queries, coverage_queries, training_queries, record_queries, forecast_queries, link_queries, extraction_queries, source_queries, profile_queries, stream_queries, issuance_queries, timing_queries, asof_queries, validation_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
