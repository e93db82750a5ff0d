"""Read-only SQL over registered views, with a truncation probe."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_only_sql(spark: SparkSession, sql: str, limit: int = 1000, args: dict | list | None = None) -> DataFrame:
    """Rows of one SELECT or WITH statement, at most ``limit`` (1..10000), and ``truncated``: were there more.

    Anything else, or several statements, is refused. Parameters are named (:x) or positional (?).
    """
    body = sql.strip().rstrip(";")
    if not re.match(r"(?is)^(select|with)\b", body) or ";" in re.sub(r"'(?:[^']|'')*'", "", body):
        raise ValueError("only one SELECT or WITH statement is read")
    limit = max(1, min(int(limit), 10_000))
    rows = spark.sql(body, args=args or {}).limit(limit + 1)
    more = rows.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return rows.limit(limit).crossJoin(F.broadcast(more))  # one row
