"""Queries of the engine's own operators over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbline.plans import checks, detectors, files, markets, more, rulesets, series, strategies

ENTRIES = {**series.OUT, **markets.OUT, **more.OUT, **strategies.OUT, **detectors.OUT, **checks.OUT, **rulesets.OUT, **files.OUT}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend entries and exits of regional daily bars."""
    return ENTRIES["trend_entry_candidates"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
