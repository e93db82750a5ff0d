"""Queries of text differences, documents, references and entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions.columns import WS
from treeline.functions.embed import HashingEmbedder, embedded
from treeline.functions.textdiff import diff_rows
from treeline.operators import documents as D
from treeline.plans.session import materialize, table
from treeline.sources import pdf
from treeline.sources.corpus import CORPUS_SQL, corpus_docs, corpus_nodes, filled

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {CORPUS_SQL} {sql}"
        return f

    return add


@query("char_diff", """, p AS (SELECT id, text AS old, CASE WHEN sort_order % 3 = 0 THEN replace(text, 'e', '') WHEN sort_order % 3 = 1 THEN 'x' || text || '!' ELSE substr(text, 3) END AS new FROM n WHERE depth = 2)
SELECT id, old, new FROM p WHERE old <> '' OR new <> ''""")  # H16
def char_diff(spark, sf):
    """Both texts put together again from the difference."""
    n = corpus_nodes(spark, sf).where("depth = 2")
    m = F.col("sort_order") % 3
    new = F.when(m == 0, F.replace("text", F.lit("e"), F.lit(""))).when(m == 1, F.concat(F.lit("x"), "text", F.lit("!"))).otherwise(F.substring("text", 3, 1 << 30))
    d = diff_rows(n.select("id", "text", new.alias("changed")), "id", "text", "changed")
    parts = F.array_sort(F.collect_list(F.struct("part_no", "type", "text")))

    def side(drop: str):
        return F.array_join(F.transform(F.filter(parts, lambda x: x["type"] != drop), lambda x: x["text"]), "")

    return d.groupBy("id").agg(side("ins").alias("old"), side("del").alias("new"))


@query("certified_subtree", "SELECT id, CASE WHEN doc_id = 3 AND (address = '1-2' OR starts_with(address, '1-2-')) THEN '受控' ELSE trust_level END AS trust_level, doc_id = 3 AND (address = '1-2' OR starts_with(address, '1-2-')) AND trust_level IS DISTINCT FROM '受控' AS changed FROM n")  # K21
def certified_subtree(spark, sf):
    return D.certified(corpus_nodes(spark, sf), 3, "1-2", "受控").select("id", "trust_level", "changed")


@query("snapshot_find", "SELECT id FROM n WHERE contains(text, 'The') AND contains(text, 'glossary')")  # I19
def snapshot_find(spark, sf):
    return D.snapshot_find(corpus_nodes(spark, sf), ["The", "glossary"]).select("id")


@query("moved_paths", "SELECT doc_id, CASE WHEN path = 'ward/notes' OR starts_with(path, 'ward/notes/') THEN 'clinic' || substr(path, 11) ELSE path END AS path, coalesce(path = 'ward/notes' OR starts_with(path, 'ward/notes/'), false) AS moved FROM dc")  # P4 L14
def moved_paths(spark, sf):
    return D.moved_paths(corpus_docs(spark, sf), "ward/notes", "clinic").select("doc_id", "path", "moved")


@query("deleted_documents", "SELECT id FROM n WHERE doc_id % 6 <> 0 OR doc_id % 11 = 0")  # L14
def deleted_documents(spark, sf):
    docs, nodes = corpus_docs(spark, sf), corpus_nodes(spark, sf)
    return D.without_documents(docs, nodes, nodes.select("doc_id"), docs.where("doc_id % 6 = 0"), docs.where("doc_id % 11 = 0"))[1].select("id")


@query("visible_docs", "SELECT doc_id FROM dc WHERE doc_id NOT IN (SELECT doc_id FROM dc WHERE folder_id = 1)")  # B17
def visible_docs(spark, sf):
    docs = corpus_docs(spark, sf)
    return D.visible(docs, docs.where("folder_id = 1")).select("doc_id")


@query("ref_fold", """, r AS (SELECT id, id AS source_id, parent_id AS target_id FROM n WHERE depth = 3), o AS (SELECT sort_order AS seq, CASE WHEN sort_order % 2 = 0 THEN 'ref.delete' ELSE 'ref.add' END AS kind, CASE WHEN sort_order % 3 = 0 THEN id || 'r' ELSE id END AS id, id AS source_id, CASE WHEN sort_order % 5 = 0 THEN '1:1' ELSE doc_id || ':1' END AS target_id FROM n WHERE depth >= 2)
SELECT id, source_id, target_id FROM r WHERE id NOT IN (SELECT id FROM o) UNION ALL SELECT o.id, source_id, target_id FROM o JOIN n a ON a.id = source_id JOIN n b ON b.id = target_id WHERE kind = 'ref.add' AND a.doc_id = b.doc_id""")  # L12
def ref_fold(spark, sf):
    n = corpus_nodes(spark, sf)
    r = n.where("depth = 3").select("id", F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"))
    s = F.col("sort_order")
    o = n.where("depth >= 2").select(
        s.alias("seq"), F.when(s % 2 == 0, "ref.delete").otherwise("ref.add").alias("kind"), F.when(s % 3 == 0, F.concat("id", F.lit("r"))).otherwise(F.col("id")).alias("id"), F.col("id").alias("source_id"),
        F.when(s % 5 == 0, "1:1").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(":1"))).alias("target_id"),
    )
    return D.fold_refs(r, o, n)


@query("entity_fold", """WITH c AS (SELECT s_nationkey AS doc_id, s_suppkey, lower(trim(s_name)) AS k, s_name FROM supplier), live AS (SELECT * FROM c WHERE s_suppkey % 4 <> 0)
SELECT doc_id, 'entity' AS kind, 's' || s_suppkey AS a, NULL AS b, s_name AS value FROM live UNION ALL
SELECT doc_id, 'binding', 's' || s_suppkey, 'n' || s_suppkey % 7, CASE WHEN s_suppkey % 3 = 0 THEN 'ignored' ELSE 'bound' END FROM live WHERE s_suppkey % 5 <> 0""")  # L13
def entity_fold(spark, sf):
    s = table(spark, sf, "supplier")
    k, who = F.col("s_suppkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    node = F.concat(F.lit("n"), (k % 7).cast("string"))

    def entry(kind, when, body, step):
        return s.where(when).select(F.col("s_nationkey").alias("doc_id"), (k * 10 + step).alias("seq"), kind.alias("kind"), F.to_json(body).alias("entry"), F.lit("active").alias("status"))

    ops = (
        entry(F.lit("entity.create"), k >= 0, F.struct(who.alias("entity"), F.concat(F.lit(" "), "s_name").alias("literal")), 0)
        .unionByName(entry(F.when(k % 3 == 0, "entity.ignoreNode").otherwise("entity.bindNode"), k >= 0, F.struct(who.alias("entity"), node.alias("node")), 1))
        .unionByName(entry(F.lit("entity.clearNodeBinding"), k % 5 == 0, F.struct(who.alias("entity"), node.alias("node")), 2))
        .unionByName(entry(F.lit("entity.delete"), k % 4 == 0, F.struct(who.alias("entity")), 3))
        .unionByName(entry(F.lit("entity.create"), k >= 0, F.struct(F.concat(who, F.lit("x")).alias("entity"), F.upper("s_name").alias("literal")), 4).withColumn("status", F.lit("undone")))
    )
    return D.fold_entities(ops)


@query("stable_ids", r"WITH x AS (SELECT DISTINCT id FROM axiom_refs) SELECT id, CASE WHEN regexp_full_match(trim(id), '[1-9][0-9]*|[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}') THEN trim(id) END AS stable FROM x")  # H28
def stable_ids(spark, sf):
    return table(spark, sf, "axiom_refs").select("id").distinct().select("id", D.stable_id(F.col("id")).alias("stable"))





@query("node_types", "SELECT id, upper(node_type) AS node_type FROM (SELECT DISTINCT id, node_type FROM n)")  # H10
def node_types(spark, sf):
    return corpus_nodes(spark, sf).select("id", D.node_type(F.lower("node_type")).alias("node_type")).distinct()


@query("hit_groups", ", h AS (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'archive', ''))) / 7 AS int) AS s FROM n) SELECT doc_id, count(*) AS n_hits, CAST(sum(s) AS bigint) AS score FROM h WHERE s > 0 GROUP BY 1")  # I20
def hit_groups(spark, sf):
    from treeline.operators.search import occurrences

    hits = corpus_nodes(spark, sf).select("doc_id", occurrences(F.lower("text"), "archive").alias("score")).where("score > 0")
    return D.grouped_hits(hits)


@query("embedded_texts")  # A37 I12
def embedded_texts(spark, sf):
    """Vectors of all nodes with a text, from their title, text and note."""
    trimmed = [F.regexp_replace(F.coalesce(c, F.lit("")), f"^{WS}+|{WS}+$", "") for c in ("node_title", "text", "node_note")]
    put = F.array_join(F.filter(F.array(*trimmed), lambda x: x != ""), "\n")
    return embedded(corpus_nodes(spark, sf).where(filled(F.col("text"))).select("id", put.alias("input")), "id", "input", HashingEmbedder(32))


def _items(spark, sf):
    """Words of every document with a path as a text layer: ten a line, twenty lines a page, first lines larger."""
    words = corpus_docs(spark, sf).where("path is not null").select("path", F.posexplode(F.split("source_text", r"\s+")).alias("k", "text"))
    row, col = F.floor(F.col("k") / 10), F.col("k") % 10
    size = F.when((row % 20 == 0), 14.0).otherwise(10.0)
    return words.where("text <> ''").select(
        "path", (row / 20).cast("int").alias("page"), F.lit(600.0).alias("page_width"), (col * 60.0).alias("x"), (col * 60.0 + 50).alias("x1"),
        ((row % 20) * 20.0).alias("y0"), ((row % 20) * 20.0 + size).alias("y1"), "text", F.lit(False).alias("bold"),
    )


@query("pdf_lines")  # A10 A10a A10b A10c
def pdf_lines(spark, sf):
    return pdf.lines(_items(spark, sf))


@query("pdf_blocks")  # A10d A10g A10h
def pdf_blocks(spark, sf):
    table = materialize(pdf.lines(_items(spark, sf)), "lines")
    return pdf.paragraphs(table, pdf.headings(table))
