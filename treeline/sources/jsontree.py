"""Import trees as flat rows: address checks, exact coverage of the source, explicit trust."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def address_errors(rows: DataFrame, key: str) -> DataFrame:
    """(key, address, kind): 'malformed', 'duplicate', 'no-parent' (other than the root) or 'gap' among siblings."""
    parent = F.regexp_replace("address", "-?[0-9]+$", "")
    good = F.coalesce(F.col("address").rlike(r"^[1-9][0-9]*(-[1-9][0-9]*)*$"), F.lit(False))
    base = rows.select(key, "address", parent.alias("parent"), F.regexp_extract("address", "([0-9]+)$", 1).try_cast("long").alias("ord"), good.alias("good"))
    one = base.where("good").groupBy(key, "address", "parent", "ord").agg(F.count(F.lit(1)).alias("n"))
    have = one.select(key, F.col("address").alias("parent"), F.lit(True).alias("there"))
    before = F.lag("ord", 1, 0).over(Window.partitionBy(key, "parent").orderBy("ord"))
    checked = one.withColumn("gap", F.col("ord") != before + 1).join(have, [key, "parent"], "left")
    kinds = F.filter(
        F.array(
            F.when(F.col("n") > 1, F.lit("duplicate")),
            F.when((F.col("parent") != "") & F.col("there").isNull() & (F.col("parent") != "1"), F.lit("no-parent")),
            F.when(F.col("gap"), F.lit("gap")),
        ),
        lambda x: x.isNotNull(),
    )
    bad = base.where(~F.col("good")).select(key, "address", F.lit("malformed").alias("kind")).distinct()
    return checked.select(key, "address", F.explode(kinds).alias("kind")).unionByName(bad)


def reassigned(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Addresses made contiguous again: siblings are renumbered by (position, id), parents first (by depth)."""
    order = Window.partitionBy(key, "parent").orderBy(F.col("source_position").asc_nulls_last(), id_col)
    parent = F.regexp_replace("address", "-?[0-9]+$", "")
    return rows.withColumn("parent", parent).select(key, id_col, F.when(F.col("parent") == "", F.lit("1")).otherwise(F.concat_ws("-", "parent", F.row_number().over(order).cast("string"))).alias("address"))


def coverage_errors(rows: DataFrame, sources: DataFrame, key: str, id_col: str) -> DataFrame:
    """Texts of (key, position, text) rows must be the source cut up, in order, apart from white space: (key, id, kind) with
    'not-in-source', and (key, null, 'incomplete') where the texts together are shorter than the source."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    run = Window.partitionBy(key).orderBy("source_position", id_col)
    sized = rows.select(key, id_col, "source_position", bare(F.col("text")).alias("t"))
    placed = sized.withColumn("at", F.sum(F.length("t")).over(run) - F.length("t"))
    src = sources.select(key, bare(F.col("source_text")).alias("s"))
    met = placed.join(src, key)
    wrong = met.where(F.substring("s", F.col("at") + 1, F.length("t")) != F.col("t")).select(key, id_col, F.lit("not-in-source").alias("kind"))
    total = placed.groupBy(key).agg(F.sum(F.length("t")).alias("n")).join(src, key).where(F.col("n") < F.length("s"))
    return wrong.unionByName(total.select(key, F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col), F.lit("incomplete").alias("kind")))
