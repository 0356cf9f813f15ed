"""Where queries over the harness tables are registered, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.functions import exprs as X
from ticklane.sources import domain as D

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def R(x: str, digits: int = 4) -> str:  # noqa: N802
    return D.rounded_sql(x, digits)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[X.rounded(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def rounded_ieee(df: DataFrame, **digits: int) -> DataFrame:
    """As ``rounded``, but NaN and infinities stay, as they do in R."""
    return df.select(*[F.when(X.finite(c), X.rounded(c, digits[c])).otherwise(F.col(c)).alias(c) if c in digits else F.col(c) for c in df.columns])
