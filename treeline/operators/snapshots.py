"""What changed between full snapshots (problem 2).

Method: invertible Bloom lookup tables. Every row of a snapshot becomes an element (key hash, value hash); the element
is added to the table of the step that ends at its snapshot and subtracted from the table of the step that starts
there, so equal rows of two consecutive snapshots cancel inside the aggregation and only the differences are left in
the cells. A document's keys are split into hash buckets of about ``BUCKET_ROWS`` keys (a huge document is spread over many),
and each bucket has its own small table. Tables are peeled cell by cell; a bucket that cannot be peeled, or whose
recovered elements do not add up to its independent digest, is built again with four times the cells and new hashes
until none is left. The recovered key hashes are then classified as added, removed or changed per field.

Only digests (8 bytes a field) are shuffled to find the changes; texts are touched for the values of changed fields only.
"""

from __future__ import annotations

import struct as _struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.plans.session import materialize
from treeline.plans.skew import lookup

#: The fields compared.
FIELDS = ("text", "node_title", "node_note", "node_type", "trust_level", "parent_id")
BUCKET_ROWS = 512
HASHES = 3
FIRST_CELLS = 24
MAX_ROUNDS = 16
_PEELED = "ok boolean, elements array<struct<k1:bigint,k2:bigint,v:bigint,s:int>>"


def _value(field: str) -> Column:
    """Compared form: exact, but in trust_level null and the empty string are the same."""
    return F.coalesce(F.col(field), F.lit("")) if field == "trust_level" else F.col(field)


def _digest(field: str) -> Column:
    return F.xxhash64(F.col(field).isNull(), F.col(field)) if field != "trust_level" else F.xxhash64(_value(field))


def snapshot_steps(rows: DataFrame) -> DataFrame:
    """Consecutive snapshot numbers per document: skey, prev_no, next_no, buckets."""
    sizes = rows.groupBy("doc_id", "snapshot_no").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("doc_id").orderBy("snapshot_no")
    return sizes.select(
        _step_key().alias("skey"), F.lag("snapshot_no").over(along).alias("prev_no"), F.lead("snapshot_no").over(along).alias("next_no"),
        F.ceil(F.max("n").over(Window.partitionBy("doc_id")) / F.lit(BUCKET_ROWS)).cast("int").alias("buckets"),
    )


def _step_key() -> Column:
    return F.concat_ws("\t", F.col("snapshot_no").cast("string"), "doc_id")


def digests(snapshots: DataFrame) -> DataFrame:
    """Last loaded row per (doc_id, snapshot_no, id) as digests, with its bucket and neighbouring snapshots.

    Ties of ``loaded_at`` are decided by the greatest digests; rows with a null doc_id, snapshot_no or id are no records.
    """
    rows = snapshots.where(F.col("doc_id").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("id").isNotNull())
    steps = materialize(snapshot_steps(rows), "steps")
    thin = rows.select(
        "doc_id", "snapshot_no", "id", F.xxhash64("id").alias("k1"),
        F.struct(F.col("loaded_at").alias("at"), *[_digest(f).alias(f) for f in FIELDS]).alias("row"), _step_key().alias("skey"),
    )
    placed = lookup(thin, steps, "skey").withColumn("bucket", F.pmod(F.col("k1"), F.col("buckets").cast("long")).cast("int"))
    last = (
        placed.drop("k1").repartition(F.col("doc_id"), F.col("bucket"))
        .groupBy("doc_id", "bucket", "snapshot_no", "prev_no", "next_no", "id")
        .agg(F.max("row").alias("row"))
    )
    return last.select("doc_id", "bucket", "snapshot_no", "prev_no", "next_no", "id", *[F.col(f"row.{f}").alias(f) for f in FIELDS])


def elements(digested: DataFrame) -> DataFrame:
    """Digested rows with both key hashes and the value hash, which are derived and need not be stored."""
    return digested.withColumns({"k1": F.xxhash64("id"), "k2": F.xxhash64("id", F.lit("second")), "v": F.xxhash64(*FIELDS)})


def build_tables(rows: DataFrame, cells: int, seed: int) -> DataFrame:
    """One subtracted table per (doc_id, snapshot_no, bucket): its non-empty cells; cell -1 is the digest."""
    side = F.array(
        F.struct(F.col("snapshot_no").alias("step"), F.lit(1).alias("s"), F.col("prev_no").isNotNull().alias("real")),
        F.struct(F.col("next_no").alias("step"), F.lit(-1).alias("s"), F.col("next_no").isNotNull().alias("real")),
    )
    marked = rows.withColumn("c", F.xxhash64("k1", "k2", "v")).withColumn("e", F.explode(F.filter(side, lambda x: x["real"])))
    spots = F.array(
        F.lit(-1),
        *[
            (F.pmod(F.xxhash64("c", F.lit(seed * HASHES + j).cast("long")), F.lit(cells).cast("long")) + j * cells).cast("int")
            for j in range(HASHES)
        ],
    )
    spread = marked.select("doc_id", "bucket", "e.step", "e.s", "k1", "k2", "v", "c", F.explode(spots).alias("cell"))
    check = F.when(F.col("cell") >= 0, F.col("c")).otherwise(F.xxhash64("v", "k2", "k1"))
    summed = spread.groupBy("doc_id", "bucket", "step", "cell").agg(
        F.sum("s").cast("int").alias("n"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.bit_xor("v").alias("v"), F.bit_xor(check).alias("c")
    )
    full = (F.col("n") != 0) | (F.col("k1") != 0) | (F.col("k2") != 0) | (F.col("v") != 0) | (F.col("c") != 0)
    return (
        summed.where(full)
        .groupBy("doc_id", "bucket", "step")
        .agg(F.collect_list(F.struct("cell", "n", "k1", "k2", "v", "c")).alias("cells"))
    )


def _h(*values: int) -> int:
    """Spark's xxhash64 of long columns."""
    seed = 42
    for x in values:
        seed = xxhash.xxh64_intdigest(_struct.pack("<q", x), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def peel(table: list, cells: int, seed: int) -> tuple[bool, list]:
    """Recover the elements of one subtracted table: (digest holds and nothing is left, [(k1, k2, v, sign)])."""
    at = {x["cell"]: [x["n"], x["k1"], x["k2"], x["v"], x["c"]] for x in table}
    digest = at.pop(-1, [0, 0, 0, 0, 0])
    ready, out = [i for i, x in at.items() if x[0] in (1, -1)], []
    while ready:
        x = at.get(ready.pop())
        if x is None or x[0] not in (1, -1) or _h(x[1], x[2], x[3]) != x[4]:
            continue
        n, k1, k2, v, c = x
        out.append((k1, k2, v, n))
        for j in range(HASHES):
            spot = _h(c, seed * HASHES + j) % cells + j * cells
            y = at.setdefault(spot, [0, 0, 0, 0, 0])
            y[0] -= n
            y[1] ^= k1
            y[2] ^= k2
            y[3] ^= v
            y[4] ^= c
            if y[0] in (1, -1):
                ready.append(spot)
            elif y == [0, 0, 0, 0, 0]:
                del at[spot]
    left = [0, 0, 0, 0, 0]
    for k1, k2, v, n in out:
        left = [left[0] + n, left[1] ^ k1, left[2] ^ k2, left[3] ^ v, left[4] ^ _h(v, k2, k1)]
    return not at and left == digest, out


def changed_keys(rows: DataFrame, cells: int = FIRST_CELLS) -> DataFrame:
    """Differences of consecutive snapshots by key hash: doc_id, bucket, step, k1, k2, in_old, in_new."""
    todo, parts = rows, []
    for seed in range(MAX_ROUNDS):
        m = cells * 4**seed

        def opened(batches: Iterator[pd.DataFrame], m: int = m, seed: int = seed) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                done = [peel(t, m, seed) for t in pdf["cells"]]
                yield pdf[["doc_id", "bucket", "step"]].assign(
                    ok=[d[0] for d in done],
                    elements=[[dict(zip(("k1", "k2", "v", "s"), e)) for e in d[1]] if d[0] else [] for d in done],
                )

        tables = build_tables(todo, m, seed)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tables.schema.fields[:3]) + ", " + _PEELED
        solved = materialize(tables.mapInPandas(opened, schema), "peeled")
        parts.append(solved.where("ok").select("doc_id", "bucket", "step", F.explode("elements").alias("e")))
        failed = solved.where("not ok").select("doc_id", "bucket", "step")
        if failed.isEmpty():
            break
        keep = failed.select("doc_id", "bucket", F.col("step").alias("f_step")).distinct()
        again = (
            todo.join(keep, ["doc_id", "bucket"])
            .where((F.col("snapshot_no") == F.col("f_step")) | (F.col("next_no") == F.col("f_step")))
            .withColumns({
                "prev_no": F.when(F.col("snapshot_no") == F.col("f_step"), F.col("prev_no")),
                "next_no": F.when(F.col("next_no") == F.col("f_step"), F.col("next_no")),
            })
            .drop("f_step")
        )
        todo = materialize(again, "again")
    else:
        raise RuntimeError("tables of some buckets cannot be peeled")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc_id", "bucket", "step", F.col("e.k1").alias("k1"), F.col("e.k2").alias("k2")).agg(
        F.max(F.col("e.s") == -1).alias("in_old"), F.max(F.col("e.s") == 1).alias("in_new")
    )


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Cases between consecutive snapshots: doc_id, snapshot_no (the later), node_id, diff_kind ('added',
    'removed' or the changed field). The first snapshot of a document gives none; gaps in the numbers are skipped;
    deliveries out of order and repeated rows do not matter. An empty table gives an empty result."""
    rows = elements(materialize(digests(snapshots), "digests"))
    keys = changed_keys(rows)
    sides = rows.select("doc_id", "bucket", "k1", "k2", "id", "snapshot_no", "next_no", F.struct(*FIELDS).alias("f"))
    both = sides.withColumn(
        "e", F.explode(F.array(F.struct(F.col("snapshot_no").alias("step"), F.lit(True).alias("new")), F.struct(F.col("next_no").alias("step"), F.lit(False).alias("new"))))
    ).select("doc_id", "bucket", "k1", "k2", "id", "e.step", "e.new", "f")
    hit = both.join(keys, ["doc_id", "bucket", "step", "k1", "k2"])
    flat = hit.groupBy("doc_id", "step", F.col("id").alias("node_id")).agg(
        F.first("in_old").alias("in_old"), F.first("in_new").alias("in_new"),
        F.max(F.when(~F.col("new"), F.col("f"))).alias("o"), F.max(F.when(F.col("new"), F.col("f"))).alias("w"),
    )
    fields = F.filter(
        F.array(*[F.when(F.col(f"o.{f}") != F.col(f"w.{f}"), F.lit(f)) for f in FIELDS]), lambda x: x.isNotNull()
    )
    kinds = (
        F.when(~F.col("in_old"), F.array(F.lit("added"))).when(~F.col("in_new"), F.array(F.lit("removed"))).otherwise(fields)
    )
    return flat.select("doc_id", F.col("step").alias("snapshot_no"), "node_id", F.explode(kinds).alias("diff_kind"))


def field_values(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes with former value (``base``) and new value of the changed field; null for added and removed."""
    rows = snapshots.where(F.col("id").isNotNull()).select(
        "doc_id", "snapshot_no", F.col("id").alias("node_id"), "loaded_at", *[_value(f).alias(f) for f in FIELDS]
    )
    order = Window.partitionBy("doc_id").orderBy("snapshot_no")
    steps = rows.select("doc_id", "snapshot_no").where("doc_id is not null and snapshot_no is not null").distinct()
    steps = steps.withColumn("prev_no", F.lag("snapshot_no").over(order))
    asked = changes.join(steps, ["doc_id", "snapshot_no"])
    want = asked.select("doc_id", "node_id", F.explode(F.array("snapshot_no", "prev_no")).alias("snapshot_no")).distinct()
    last = (
        rows.join(want, ["doc_id", "snapshot_no", "node_id"])
        .groupBy("doc_id", "snapshot_no", "node_id")
        .agg(F.max_by(F.struct(*FIELDS), F.struct("loaded_at", *[_digest(f) for f in FIELDS])).alias("f"))
    )
    new = last.withColumnRenamed("f", "w")
    old = last.select("doc_id", "node_id", F.col("snapshot_no").alias("prev_no"), F.col("f").alias("o"))
    both = asked.join(new, ["doc_id", "snapshot_no", "node_id"], "left").join(old, ["doc_id", "prev_no", "node_id"], "left")

    def picked(side: str) -> Column:
        return F.coalesce(*[F.when(F.col("diff_kind") == f, F.col(f"{side}.{f}")) for f in FIELDS])

    return both.select(
        "doc_id", "snapshot_no", "node_id", "diff_kind", picked("o").alias("base"), picked("w").alias("value")
    )
