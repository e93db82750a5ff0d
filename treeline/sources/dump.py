"""Whole-database export and import, and library folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that are derived on read and left out of an export.
DERIVED = ("content_hash", "subtree_hash", "title_chars", "text_chars", "note_chars", "child_count")


def export_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        df.drop(*DERIVED).write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def import_tables(spark: SparkSession, path: str, expected: dict[str, list[str]], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Tables of an export with the columns both sides know."""
    out = {}
    for name, columns in expected.items():
        df = spark.read.format(fmt).load(f"{path}/{name}")
        out[name] = df.select(*[c for c in columns if c in df.columns])
    return out


def foreign_key_errors(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``column`` names no row of ``parent``."""
    known = parent.select(F.col(key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def folder_tree(paths: DataFrame, max_depth: int = 12) -> DataFrame:
    """Folders over the file paths, hidden ones left out: folder, depth, n_files (directly inside), n_below (anywhere below)."""
    parts = F.split("path", "/")
    seen = paths.where(F.col("path").isNotNull() & ~F.exists(parts, lambda s: s.startswith("."))).withColumn("p", parts)
    up = seen.select("path", F.size("p").alias("n"), F.explode(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1)))).alias("k"), "p").where((F.col("k") < F.col("n")) & (F.col("k") <= max_depth))
    folder = F.array_join(F.slice("p", 1, F.col("k")), "/")
    return up.groupBy(folder.alias("folder"), F.col("k").alias("depth")).agg(F.sum((F.col("k") == F.col("n") - 1).cast("long")).alias("n_files"), F.count(F.lit(1)).alias("n_below"))
