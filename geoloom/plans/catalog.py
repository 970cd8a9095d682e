"""Queries of the core operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.plans import nearby, shapes, skew

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**shapes.QUERIES, **skew.QUERIES, **nearby.QUERIES}
ORACLE_SQL: dict[str, str] = {**shapes.ORACLE_SQL, **skew.ORACLE_SQL, **nearby.ORACLE_SQL}
FLAGSHIP = shapes.agg_topn_perimeter
