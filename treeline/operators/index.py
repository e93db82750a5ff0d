"""Derived indexes as tables: upsert, reconciliation against the source of truth, coverage, maintenance in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows of ``new`` (the last per key by ``seq``) in place of those of ``old`` with the same key."""
    rest = [c for c in new.columns if c not in (key, seq)]
    last = new.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
    return old.join(last, key, "left_anti").unionByName(last)


def reconcile(live: DataFrame, index: DataFrame, mark: str) -> DataFrame:
    """What an index lacks or has too much: id, state ('pending' not indexed, 'orphan' no such row, 'stale' other mark).

    The content mark (hash or time) is compared in one full join on the id; equal rows leave at once.
    """
    both = live.select("id", F.col(mark).alias("m"), F.lit(True).alias("a")).join(
        index.select("id", F.col(mark).alias("k"), F.lit(True).alias("b")), "id", "full"
    )
    state = F.when(F.col("b").isNull(), "pending").when(F.col("a").isNull(), "orphan").when(~F.col("m").eqNullSafe(F.col("k")), "stale")
    return both.select("id", state.alias("state")).where("state is not null")


def coverage(nodes: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per document: rows that should be indexed, rows that are, status."""
    have = indexed.select("id").distinct().withColumn("h", F.lit(1))
    per = nodes.join(have, "id", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count("h").alias("n_indexed"))
    return per.withColumn("status", F.when(F.col("n_nodes") == F.col("n_indexed"), "ready").otherwise("missing"))


def require_complete(cover: DataFrame) -> None:
    """Refuse to search where any document's index is incomplete."""
    lacking = cover.where("status <> 'ready'").limit(1).collect()
    if lacking:
        raise RuntimeError(f"index incomplete, for example document {lacking[0].doc_id}")
