"""Registered queries: a function of (spark, sf_dir), and where SQL can say it the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"registered twice: {name}")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Figures to a few digits, so that the order of a sum doesn't show; minus zero becomes zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def sql_round(expression: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0::DOUBLE AS {name or expression}"
