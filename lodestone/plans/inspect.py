"""Counts of a plan's operators."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> Counter:
    """How often each operator stands in the plan before it runs."""
    return Counter(m[1] for m in re.finditer(r"^[\s:|+\-]*(?:\*\(\d+\) )?(\w+)", text(df), re.M))


def shuffles(df: DataFrame) -> int:
    return operators(df)["Exchange"]


def read_columns(df: DataFrame) -> list[str]:
    """The columns that scans read."""
    return [c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", text(df)) for c in re.findall(r"(\w+:[^,<]+(?:<[^>]*>)?)", s)]
