"""Append streams: contiguous addresses, idempotent pushes, session volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Idle time until a volume is sealed, cool-down until it may be distilled, memory of push keys.
SEAL_IDLE = "24 hours"
COOL_DOWN_HOURS = 24
PUSH_MEMORY = "10 seconds"


def session_volumes(events: DataFrame, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Volumes of each key: a gap of a day or more starts a new one: key, started, last_activity, n. For batch and stream
    (with a watermark) alike."""
    return events.groupBy(key, F.session_window(ts, SEAL_IDLE).alias("w")).agg(F.min(ts).alias("started"), F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("n")).drop("w")


def volume_state(last_activity: Column, now: Column, sealed_at: Column | None = None, distilled_at: Column | None = None) -> Column:
    """'active', 'sealed', 'distillable' or 'distilled': a pure function of times."""
    seal = last_activity + F.expr("INTERVAL 24 HOURS") if sealed_at is None else F.coalesce(sealed_at, last_activity + F.expr("INTERVAL 24 HOURS"))
    closed = (now >= seal) if sealed_at is None else sealed_at.isNotNull() | (now >= seal)
    state = F.when(~closed, "active")
    if distilled_at is not None:
        state = state.when(distilled_at >= seal, "distilled")
    return state.when(now >= seal + F.expr("INTERVAL 24 HOURS"), "distillable").otherwise("sealed")


def deduplicated(pushes: DataFrame, key: str = "idempotency_key", ts: str = "ts") -> DataFrame:
    """Stream of pushes without repeats of a key within its memory (event time)."""
    return pushes.withWatermark(ts, PUSH_MEMORY).dropDuplicatesWithinWatermark([key])


def deduplicated_batch(pushes: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Batch form: a push is dropped when the same key was pushed less than the memory before it."""
    w = Window.partitionBy(key).orderBy(ts, order)
    recent = F.lag(ts).over(w)
    return pushes.withColumn("_last", recent).where(F.col("_last").isNull() | (F.col(ts) > F.col("_last") + F.expr("INTERVAL 10 SECONDS"))).drop("_last")


def contiguity_errors(pushed: DataFrame, existing: DataFrame) -> DataFrame:
    """Pushed rows (batch_id, parent_address, address) that do not continue their parent's children one by one after
    ``existing`` (parent_address, last_order): batch_id, address, error."""
    prefix = F.regexp_replace("address", "-?[0-9]+$", "")
    order = F.regexp_extract("address", "([0-9]+)$", 1).try_cast("int")
    placed = pushed.withColumns({"prefix": prefix, "ord": order})
    nth = F.row_number().over(Window.partitionBy("parent_address").orderBy("batch_id", "ord", "address"))
    checked = placed.join(existing, "parent_address", "left").withColumn("expected", F.coalesce("last_order", F.lit(0)) + nth)
    error = (
        F.when(F.coalesce("address", F.lit("")) == "", "missing").when(F.col("prefix") != F.col("parent_address"), "prefix")
        .when(F.col("ord").isNull() | (F.col("ord") <= 0), "number").when(F.col("ord") != F.col("expected"), "gap")
    )
    return checked.select("batch_id", "address", error.alias("error")).where("error is not null")


def with_ordinals(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Pushes (parent_id, seq, ...) with ``sort_order`` behind the greatest stored one of their parent, in the order of seq."""
    nth = F.row_number().over(Window.partitionBy("parent_id").orderBy("seq"))
    if stored is None:
        return batch.withColumn("sort_order", nth)
    last = stored.groupBy("parent_id").agg(F.max("sort_order").alias("_last"))
    return batch.join(last, "parent_id", "left").withColumn("sort_order", F.coalesce("_last", F.lit(0)) + nth).drop("_last")


def start_append(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of pushes to a table. Within the memory repeats are dropped; pushes that have parent_id and seq get ordinals
    that continue those of earlier batches. A batch is written under its own id and looks at earlier ones only, so it replays safely.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if {"parent_id", "seq"} <= set(batch.columns):
            stored = None
            if batch_id > 0:
                spark = batch.sparkSession
                earlier = [f"{path}/batch={k}" for k in range(batch_id)]
                fs_path = spark._jvm.org.apache.hadoop.fs.Path
                fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
                have = [p for p in earlier if fs.exists(fs_path(p))]
                stored = spark.read.parquet(*have).select("parent_id", "sort_order") if have else None
            rows = with_ordinals(batch, stored)
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return deduplicated(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
