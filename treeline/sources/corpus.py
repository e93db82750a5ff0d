"""The corpus as tables: documents cut into addressed trees (root, paragraphs, their further lines).

The trees are written once per application, as an import does, and read by all queries: columns are pruned and filters pushed
down to that table, whose rows stand in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.functions.columns import WS, address_key
from treeline.plans.session import exists, materialize, scratch_dir, table

TRUSTED = "受控"


def filled(x: Column) -> Column:
    return F.length(F.regexp_replace(x, WS, "")) > 0


def corpus_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text: doc_id, title, path, source_type, lang, updated_at (string), source_text, folder_id, meta."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    meta = F.when(F.col("doc_id") % 11 == 0, F.lit('{"memoryVolume":{"agent":"scribe","workspace":"w1"}}')).when(
        F.col("doc_id") % 13 == 0, F.lit("{broken")
    )
    return d.select(
        "doc_id", "title", F.col("original_path").alias("path"), "source_type", "lang",
        F.date_format("imported_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
        F.regexp_replace("text", "\r", "").alias("source_text"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 5).cast("int")).alias("folder_id"), meta.alias("meta"),
    )


_STORED: dict[tuple[str, str], DataFrame] = {}


def corpus_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cut_nodes`` as a stored table; written again where it has gone."""
    key = (scratch_dir(spark), sf_dir)
    if key not in _STORED or not exists(_STORED[key]):
        cut = cut_nodes(spark, sf_dir)
        _STORED[key] = materialize(cut.sortWithinPartitions("doc_id", address_key(F.col("address"))), "nodes")
    stored = _STORED[key]
    fresh = spark.read.schema(stored.schema).parquet(stored._treeline_path)  # every call has its own columns, for self-joins
    fresh._treeline_path = stored._treeline_path
    return fresh


def cut_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree of every document: doc_id, id, parent_id, sort_order, address, depth, node_type, text, node_title, node_note,
    trust_level, updated_at. Paragraphs are children of the root; a paragraph's text is its first line, its further
    lines are its children."""
    d = corpus_docs(spark, sf_dir)
    root = d.select(
        "doc_id", F.lit("1").alias("address"), F.lit(1).alias("sort_order"), F.lit(1).alias("depth"), F.lit("").alias("text"),
        F.coalesce("title", F.lit("")).alias("node_title"), F.lit("SECTION").alias("node_type"), "updated_at",
    )
    paras = d.select(
        "doc_id", "updated_at", F.posexplode(F.filter(F.split("source_text", "\n\n"), filled)).alias("k", "p")
    ).select("doc_id", "updated_at", (F.col("k") + 1).alias("i"), F.filter(F.split("p", "\n"), filled).alias("lines"))
    heads = paras.select(
        "doc_id", F.concat(F.lit("1-"), F.col("i")).alias("address"), F.col("i").alias("sort_order"), F.lit(2).alias("depth"),
        F.col("lines")[0].alias("text"), F.regexp_extract(F.col("lines")[0], "^#+ (.*)$", 1).alias("node_title"),
        F.when(F.col("lines")[0].startswith("#"), "SECTION").otherwise("TEXT").alias("node_type"), "updated_at",
    )
    rest = paras.select("doc_id", "updated_at", "i", F.posexplode("lines").alias("j", "text")).where("j > 0")
    rest = rest.select(
        "doc_id", F.concat_ws("-", F.lit("1"), "i", "j").alias("address"), F.col("j").alias("sort_order"), F.lit(3).alias("depth"),
        "text", F.lit("").alias("node_title"), F.lit("TEXT").alias("node_type"), "updated_at",
    )
    every = root.unionByName(heads).unionByName(rest)
    parent = F.when(F.col("depth") > 1, F.regexp_replace("address", "-[0-9]+$", ""))
    return every.select(
        "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), "address").alias("id"),
        F.when(parent.isNotNull(), F.concat_ws(":", F.col("doc_id").cast("string"), parent)).alias("parent_id"),
        "sort_order", "address", "depth", "node_type", "text", "node_title",
        F.when(F.col("sort_order") % 5 == 0, F.concat(F.lit("note "), F.col("sort_order").cast("string"))).alias("node_note"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(TRUSTED)).alias("trust_level"), "updated_at",
    )


#: The same in SQL, as common table expressions ``dc`` (documents) and ``n`` (nodes).
WS_SQL = r"[\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def body_sql(x: str) -> str:
    return f"coalesce(length(regexp_replace({x}, '{WS_SQL}', '', 'g')), 0)"


CORPUS_SQL = f"""
dc AS (
  SELECT doc_id, title, original_path AS path, source_type, lang, strftime(imported_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
         replace(text, chr(13), '') AS source_text, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id % 5 AS int) END AS folder_id,
         CASE WHEN doc_id % 11 = 0 THEN '{{"memoryVolume":{{"agent":"scribe","workspace":"w1"}}}}' WHEN doc_id % 13 = 0 THEN '{{broken' END AS meta
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
ps AS (SELECT doc_id, updated_at, list_filter(string_split(source_text, chr(10) || chr(10)), lambda x: {body_sql("x")} > 0) AS ps FROM dc),
pl AS (
  SELECT doc_id, updated_at, i, list_filter(string_split(p, chr(10)), lambda x: {body_sql("x")} > 0) AS lines
  FROM (SELECT doc_id, updated_at, unnest(ps) AS p, unnest(generate_series(1, len(ps))) AS i FROM ps)),
ln AS (SELECT doc_id, updated_at, i, unnest(lines) AS text, unnest(generate_series(0, len(lines) - 1)) AS j FROM pl),
u AS (
  SELECT doc_id, '1' AS address, 1 AS sort_order, 1 AS depth, '' AS text, coalesce(title, '') AS node_title, 'SECTION' AS node_type, updated_at FROM dc
  UNION ALL SELECT doc_id, '1-' || i, i, 2, text, regexp_extract(text, '^#+ (.*)$', 1), CASE WHEN starts_with(text, '#') THEN 'SECTION' ELSE 'TEXT' END, updated_at FROM ln WHERE j = 0
  UNION ALL SELECT doc_id, '1-' || i || '-' || j, j, 3, text, '', 'TEXT', updated_at FROM ln WHERE j > 0),
n AS (
  SELECT doc_id, doc_id || ':' || address AS id, CASE WHEN depth > 1 THEN doc_id || ':' || regexp_replace(address, '-[0-9]+$', '') END AS parent_id,
         CAST(sort_order AS int) AS sort_order, address, depth, node_type, text, node_title, CASE WHEN sort_order % 5 = 0 THEN 'note ' || sort_order END AS node_note,
         CASE WHEN doc_id % 7 = 0 THEN '{TRUSTED}' END AS trust_level, updated_at FROM u)"""
