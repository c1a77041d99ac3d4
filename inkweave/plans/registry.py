"""All queries of the core and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkweave.plans import checks, history, layouts, records, units


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return units.QUERIES | records.QUERIES | layouts.QUERIES | checks.QUERIES | {"p5_found": history.p5_found}


def oracle_sql() -> dict[str, str]:
    return units.ORACLE | records.ORACLE | layouts.ORACLE | checks.ORACLE | history.ORACLE
