"""The corpus queries and their DuckDB twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import chat_format, fingerprints, html_text, license_scan, line_dedup, mixing, near_dups, neighbours, packing, periodic_runs, quality, repeats, vector_codes

MODULES = (license_scan, html_text, line_dedup, packing, quality, repeats, near_dups, neighbours, fingerprints, mixing, periodic_runs, chat_format, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
