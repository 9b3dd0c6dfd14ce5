"""Every query of the engine by name, with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import check_queries, grid_queries, layout_queries, render_queries, section_queries, table_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (text_queries, section_queries, table_queries, check_queries, render_queries, grid_queries, layout_queries):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
