"""Physical-plan inspection used by the tests and the bench notes (``df.explain`` in code form)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """The physical plan text (the initial adaptive plan when AQE is on)."""
    return df._jdf.queryExecution().executedPlan().toString()


def formatted_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def has_cartesian_product(df: DataFrame) -> bool:
    return "CartesianProduct" in physical_plan(df)


def scan_schemas(df: DataFrame) -> list[str]:
    """ReadSchema of every file scan: shows column pruning reaching the parquet reader."""
    return re.findall(r"ReadSchema: (struct<[^>]*>)", formatted_plan(df))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", formatted_plan(df))


def exchange_count(df: DataFrame) -> int:
    return len(re.findall(r"Exchange ", physical_plan(df)))
