"""Skew-safe building blocks: grouped prefix sums and lookups that never put a hot key into one task.

In lookups a key is *hot* when it holds more than ``max(HOT_ROWS, rows / 1000)`` rows, so at most 1000 keys are ever hot and
the list of them is safe to collect and broadcast. In prefix sums every group beyond ``HOT_ROWS`` rows is hot; their table
is broadcast only while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.plans.session import materialize

HOT_ROWS = 200_000
MOST_BROADCAST = 100_000


def hot_limit(rows: int, hot_rows: int | None = None) -> int:
    return max(hot_rows or HOT_ROWS, rows // 1000)


def hot_keys(df: DataFrame, key: str, hot_rows: int | None = None) -> list:
    """Values of ``key`` with more rows than the limit; at most 1000 by construction."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = hot_limit(total or 0, hot_rows)
    if (most or 0) <= limit:
        return []
    return [r[0] for r in counts.where(F.col("n") > limit).select(key).collect()]


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join ``left`` to ``right`` (``key`` unique in ``right``); rows of hot keys meet a broadcast of the few right rows."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right, key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how)
    return cold.unionByName(warm)


def prefix_sums(
    df: DataFrame, group: str, order: list[Column], sums: dict[str, Column], hot_rows: int | None = None
) -> DataFrame:
    """Add, per ``group`` in ``order``, the sums over all earlier rows (exclusive) named in ``sums``.

    Usual groups use one window. Hot groups are range-partitioned by (group, order); each range gets its own running
    sum and the sums of the ranges before it (one row per range) are added.
    """
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    plain = {k: F.coalesce(F.sum(v).over(before), F.lit(0)) for k, v in sums.items()}
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    hot = materialize(counts.where(F.col("n") > (hot_rows or HOT_ROWS)).select(group, F.lit(True).alias("_hot")), "hot")
    n_hot = hot.count()
    if not n_hot:
        return df.withColumns(plain)
    tagged = df.join(F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot, group, "left")
    is_hot = F.coalesce("_hot", F.lit(False))
    cold = tagged.where(~is_hot).drop("_hot").withColumns(plain)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        tagged.where(is_hot)
        .drop("_hot")
        .withColumns({f"_v_{k}": v for k, v in sums.items()})
        .repartitionByRange(max(parts, 2), F.col(group), *order)
        .withColumn("_pid", F.spark_partition_id())
    )
    ranged = materialize(ranged, "ranges")
    totals = ranged.groupBy(group, "_pid").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        group, "_pid", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_b_{k}") for k in sums]
    )
    inside = Window.partitionBy(group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    warm = (
        ranged.withColumns({f"_w_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in sums})
        .join(bases, [group, "_pid"])
        .withColumns({k: F.col(f"_w_{k}") + F.col(f"_b_{k}") for k in sums})
        .select(cold.columns)
    )
    return cold.unionByName(warm)
