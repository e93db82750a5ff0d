"""Current and live rows of ``nodes`` and ``axioms``.

The current row of an id is the one with the latest ``updated_at`` (ties: latest ``loaded_at``, then the greatest row).
An id is live when no deletion names it, or its latest ``updated_at`` is later than every deletion. Rows with a null or
blank id are no records. An ``updated_at`` in neither known format counts as older than everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.columns import clean_ref, moment


def deletions_of(deletions: DataFrame, kind: str) -> DataFrame:
    """Latest deletion per target of one kind: (id, _deleted)."""
    return (
        deletions.where(F.lower(F.trim("target_type")) == kind)
        .select(clean_ref(F.col("target_id")).alias("id"), F.col("deleted_at").cast("timestamp_ntz").alias("d"))
        .where(F.col("id").isNotNull() & F.col("d").isNotNull())
        .groupBy("id")
        .agg(F.max("d").alias("_deleted"))
    )


def current_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row per id: ``columns`` of its latest version, and ``_updated``."""
    loaded = F.col("loaded_at") if "loaded_at" in table.columns else F.lit(None).cast("timestamp_ntz")
    row = F.struct(moment(F.col("updated_at")).alias("u"), loaded.alias("l"), *[F.col(c) for c in columns])
    return (
        table.where(F.col("id").isNotNull() & (F.trim("id") != ""))
        .groupBy("id")
        .agg(F.max(row).alias("r"))
        .select("id", F.col("r.u").alias("_updated"), *[F.col(f"r.{c}").alias(c) for c in columns])
    )


def live_rows(table: DataFrame, deletions: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Current rows that no later (or equally late) deletion removes."""
    gone = deletions_of(deletions, kind)
    kept = current_rows(table, columns).join(gone, "id", "left")
    return kept.where(F.col("_deleted").isNull() | (F.col("_updated") > F.col("_deleted"))).drop("_deleted", "_updated")
