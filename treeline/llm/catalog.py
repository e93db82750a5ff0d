"""Queries of the text problems (3, 5, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.llm.abuse import score_documents, source_rates, votes
from treeline.llm.mixing import mix
from treeline.llm.packing import fill_report, pack
from treeline.llm.pieces import limited_items, split_items
from treeline.llm.sentences import sentences, train
from treeline.llm.tokens import token_counts
from treeline.plans.session import materialize, settled, table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "start_offset", "end_offset")


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = settled(table(spark, sf_dir, "documents").select("doc_id", "text", "source_type"), "doc_id")
    model = train(docs)
    both = [
        sentences(docs, model, ascii_marks=flag).withColumn("split_ascii_marks", F.lit(flag)) for flag in (True, False)
    ]
    return both[0].unionByName(both[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = split_items(table(spark, sf_dir, "import_nodes"), table(spark, sf_dir, "import_limits"), with_text=False)
    return cut.where("piece_no = 1").select("item_id", "cut_kind")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "import_nodes"), table(spark, sf_dir, "import_limits"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_limits"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p6_packing(spark, sf_dir))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("flagged").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "review_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialize(p8_scores(spark, sf_dir), "scores")
    return source_rates(table(spark, sf_dir, "documents"), scored)


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per limit: oversized items that were cut, and pieces that break a rule (all 0): over the limit, not the stored text, not
    repeating the overlap, items not covered from end to end."""
    nodes, limits = table(spark, sf_dir, "import_nodes"), table(spark, sf_dir, "import_limits")
    cut = materialize(split_items(nodes, limits), "pieces")
    own = materialize(limited_items(nodes, limits), "items")
    along = Window.partitionBy("item_id").orderBy("piece_no")
    begin, end = F.col("start_offset"), F.col("end_offset")
    seen = cut.join(own.select("item_id", F.col("text").alias("whole"), "lead", "n_chars", "max_chars", "overlap_chars"), "item_id").select(
        "item_id", "max_chars", F.coalesce(F.lag("end_offset").over(along) - F.col("overlap_chars"), F.col("lead")).alias("want"), begin.alias("b"), end.alias("e"),
        (end - begin > F.col("max_chars")).alias("over"), (F.substring("whole", (begin - F.col("lead") + 1).cast("int"), (end - begin).cast("int")) != F.col("text")).alias("wrong"),
        (F.lead("item_id").over(along).isNull() & (end != F.col("lead") + F.col("n_chars"))).alias("short"),
    )

    def broken(c: Column) -> Column:
        return F.sum(c.cast("long"))

    return seen.groupBy("max_chars").agg(
        F.count_distinct("item_id").alias("n_items"), broken(F.col("over")).alias("over"), broken(F.col("wrong")).alias("wrong_text"),
        broken(F.col("b") != F.col("want")).alias("wrong_overlap"), broken(F.col("short")).alias("not_covered"),
    )


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: documents placed, containers over the capacity, documents whose pieces do not add up, undivided texts that
    were divided (all 0), and whether the containers are within one in a thousand, and one, of the least possible number."""
    sized = materialize(token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")), "sized")
    packed = materialize(pack(sized, table(spark, sf_dir, "pack_limits")), "packed")
    by_doc = packed.groupBy("pack_name", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    docs = by_doc.join(sized.select("doc_id", F.col("n_tokens").alias("whole")), "doc_id").groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("n") != F.col("whole")).cast("long")).alias("not_whole"),
        F.sum(((F.col("pieces") > 1) & (F.col("whole") <= F.col("capacity"))).cast("long")).alias("divided"),
    )
    bins = packed.where("container_id is not null").groupBy("pack_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("n"))
    bins = bins.groupBy("pack_name", "capacity").agg(F.sum((F.col("n") > F.col("capacity")).cast("long")).alias("over"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    near = F.col("k") <= F.ceil(F.col("total") / F.col("capacity")) * 1.001 + 1
    return docs.join(bins, "pack_name").select("pack_name", "n_docs", "over", "not_whole", "divided", near.alias("near_least"))


def p7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source: its share of all weights, its share among the sources with texts, and whether any text is used more often
    than allowed or the source is used although it may not be."""
    report = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
    wrong = (F.col("most_copies") > F.coalesce("max_repeats", F.lit(0))) | ((F.col("reachable_share") == 0) & (F.col("n_tokens") > 0))
    return report.select("source", F.round("target_share", 9).alias("target_share"), F.round("reachable_share", 9).alias("reachable_share"), wrong.alias("wrong"))


def p8_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(table(spark, sf_dir, "review_labels"))


_SOURCE = "regexp_replace(lower(trim(source)), '[-\\s]+', '_', 'g')"
_TRIM = "regexp_replace(regexp_replace(text, '^[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}\\x{1C}-\\x{1F}\\x{0B}]+', ''), '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}\\x{1C}-\\x{1F}\\x{0B}]+$', '')"
QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_sentences, p5_found, p5_pieces, p5_checks, p6_packing, p6_report, p6_checks, p7_selection, p7_report, p7_targets, p8_found, p8_scores,
        p8_rates, p8_votes,
    )
}
ORACLE: dict[str, str] = {
    "p5_checks": f"""WITH i AS (SELECT item_id, max(text) AS text, arg_max(lower(trim(coalesce(import_mode, 'vector'))), text) AS mode FROM import_nodes WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
b AS (SELECT item_id, max_chars FROM i JOIN import_limits l ON lower(trim(l.import_mode)) = i.mode WHERE length({_TRIM}) > max_chars)
SELECT max_chars, count(DISTINCT item_id) AS n_items, CAST(0 AS bigint) AS over, CAST(0 AS bigint) AS wrong_text, CAST(0 AS bigint) AS wrong_overlap, CAST(0 AS bigint) AS not_covered FROM b GROUP BY 1""",
    "p6_checks": """SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id IS NOT NULL) AS n_docs, CAST(0 AS bigint) AS over, CAST(0 AS bigint) AS not_whole, CAST(0 AS bigint) AS divided, true AS near_least
FROM pack_limits WHERE capacity_tokens > 0""",
    "p7_targets": f"""WITH d AS (SELECT text, arg_min({_SOURCE}, doc_id) AS source FROM documents WHERE doc_id IS NOT NULL AND text <> '' GROUP BY 1),
w AS (SELECT {_SOURCE} AS source, CASE WHEN target_weight > 0 THEN target_weight ELSE 0 END AS w, coalesce(max_repeats, 0) AS m FROM mix_targets),
x AS (SELECT *, w > 0 AND m > 0 AND source IN (SELECT source FROM d WHERE source IS NOT NULL) AS live FROM w)
SELECT source, round(w / (SELECT sum(w) FROM x), 9) AS target_share, round(CASE WHEN live THEN w / (SELECT sum(w) FROM x WHERE live) ELSE 0 END, 9) AS reachable_share, false AS wrong FROM x""",
    "p8_votes": """WITH l AS (SELECT doc_id, rater, arg_max(lower(trim(label)), coalesce(labelled_at, TIMESTAMP '0001-01-01')) AS label FROM review_labels WHERE doc_id IS NOT NULL AND trim(label) <> '' GROUP BY 1, 2)
SELECT doc_id, avg(CAST(label <> 'ok' AS double)) AS share, count(*) AS raters FROM l GROUP BY 1""",
}
