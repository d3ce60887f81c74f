"""The registry of named queries and helpers for their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions.stats import rounded
from meterloom.session import tune

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (session, folder); its result's doubles are rounded to six digits."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(tune(spark), sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded, counts as long: what both engines can agree on."""
    kinds = {"double": lambda c: rounded(F.col(c)), "float": lambda c: rounded(F.col(c).cast("double")), "int": lambda c: F.col(c).cast("long")}
    return df.select(*[(kinds[t](c) if t in kinds else F.col(c)).alias(c) for c, t in df.dtypes])


def cols(doubles: dict[str, str] | None = None, longs: dict[str, str] | None = None, others: str = "") -> str:
    """A select list: doubles rounded as tidy does, longs cast."""
    parts = [others] if others else []
    parts += [f"round(CAST({x} AS DOUBLE) + 1e-9, 6) AS {n}" for n, x in (doubles or {}).items()]
    parts += [f"CAST({x} AS BIGINT) AS {n}" for n, x in (longs or {}).items()]
    return ", ".join(parts)


def rat(a: str, b: str) -> str:
    return f"(({a}) / CASE WHEN ({b}) > 0 THEN ({b}) END)"


def clip(x: str, low: str = "0.02") -> str:
    """greatest(x, low) where x is there (DuckDB's greatest skips nulls, as Spark's does)."""
    return f"greatest({x}, {low}::DOUBLE)"


SUMMER, WINTER = "month(date) IN (5, 6, 7, 8)", "month(date) IN (11, 12, 1, 2)"
MID, NIGHT, DAY, LATE, NZ, EVE = "(k >= 44 AND k < 60)", "(k >= 4 AND k < 20)", "(k >= 36 AND k < 68)", "(k >= 80 OR k < 24)", "(k >= 88 OR k < 24)", "(k >= 68 AND k < 92)"
