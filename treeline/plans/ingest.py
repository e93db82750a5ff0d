"""Queries of ingestion: Markdown, HTML, import trees, folders, exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions.columns import body_chars
from treeline.plans.session import materialize, scratch_dir, table
from treeline.sources import dump, files, jsontree, markdown
from treeline.sources.corpus import CORPUS_SQL, corpus_docs, corpus_nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {CORPUS_SQL} {sql}"
        return f

    return add


@query("markdown_blocks")  # A6
def markdown_blocks(spark, sf):
    return markdown.block_rows(corpus_docs(spark, sf))


@query("markdown_headings", """, l AS (SELECT doc_id, unnest(string_split(source_text, chr(10))) AS line FROM dc WHERE source_text <> ''), h AS (SELECT doc_id, regexp_extract(line, '^[ ]{0,3}#{1,6}[ \\t]+(.*)$', 1) AS title, length(regexp_extract(line, '^[ ]{0,3}(#{1,6})[ \\t]', 1)) AS level FROM l WHERE regexp_matches(line, '^[ ]{0,3}#{1,6}[ \\t]'))
SELECT doc_id, level, trim(title) AS title, count(*) AS n FROM h GROUP BY ALL""")  # A6 A9
def markdown_headings(spark, sf):
    b = markdown.block_rows(corpus_docs(spark, sf)).where("type = 'heading'")
    return b.groupBy("doc_id", F.col("level").cast("long").alias("level"), F.trim("text").alias("title")).agg(F.count(F.lit(1)).alias("n"))


@query("markdown_tree")  # A7 A17 A28
def markdown_tree(spark, sf):
    return markdown.structured(corpus_docs(spark, sf))


@query("import_policy", """, s AS (SELECT doc_id, source_text, list_bool_or(list_transform(string_split(source_text, chr(10)), lambda l: regexp_matches(l, '^[ ]{0,3}#{1,6}[ \\t]'))) AS structured FROM dc WHERE source_text <> '')
SELECT dc.doc_id, CASE WHEN coalesce(structured, false) THEN 'paragraph' WHEN length(dc.source_text) <= 1000 THEN 'direct' ELSE 'refused' END AS import_as FROM dc LEFT JOIN s USING (doc_id)""")  # A9 A19 A20
def import_policy(spark, sf):
    docs = corpus_docs(spark, sf)
    return markdown.import_policy(markdown.inspect(markdown.block_rows(docs)), docs.select("doc_id", F.length("source_text").alias("n_chars")))


@query("import_address_errors", """WITH b AS (SELECT import_id, address, regexp_replace(address, '-?[0-9]+$', '') AS parent, try_cast(regexp_extract(address, '([0-9]+)$', 1) AS bigint) AS ord, coalesce(regexp_full_match(address, '[1-9][0-9]*(-[1-9][0-9]*)*'), false) AS good FROM (SELECT import_id, CASE WHEN item_id % 17 = 0 THEN address || '-9' WHEN item_id % 23 = 0 THEN '1--2' ELSE address END AS address FROM import_nodes)),
o AS (SELECT import_id, address, parent, ord, count(*) AS n FROM b WHERE good GROUP BY ALL), g AS (SELECT *, ord <> lag(ord, 1, 0) OVER (PARTITION BY import_id, parent ORDER BY ord) + 1 AS gap FROM o)
SELECT import_id, address, 'duplicate' AS kind FROM g WHERE n > 1 UNION ALL SELECT import_id, address, 'no-parent' FROM g WHERE parent NOT IN ('', '1') AND (import_id, parent) NOT IN (SELECT (import_id, address) FROM o) UNION ALL SELECT import_id, address, 'gap' FROM g WHERE gap UNION ALL SELECT DISTINCT import_id, address, 'malformed' FROM b WHERE NOT good""")  # A22
def import_address_errors(spark, sf):
    i = table(spark, sf, "import_nodes")
    bad = F.when(F.col("item_id") % 17 == 0, F.concat("address", F.lit("-9"))).when(F.col("item_id") % 23 == 0, "1--2").otherwise(F.col("address"))
    return jsontree.address_errors(i.select("import_id", bad.alias("address")), "import_id")


@query("import_coverage", """, r AS (SELECT doc_id, id, i, j, CASE WHEN doc_id % 10 = 3 AND j = 1 THEN text || 'x' WHEN doc_id % 10 = 4 AND j = 1 THEN '' ELSE text END AS text FROM (SELECT doc_id, i, j, text, doc_id || ':' || i || ':' || j AS id FROM ln)),
t AS (SELECT doc_id, id, i, j, regexp_replace(text, '[\\t-\\r ]+', '', 'g') AS t FROM r), p AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_pos FROM t), s AS (SELECT doc_id, regexp_replace(source_text, '[\\t-\\r ]+', '', 'g') AS s FROM dc)
SELECT doc_id, id, 'not-in-source' AS kind FROM p JOIN s USING (doc_id) WHERE substr(s, CAST(at_pos AS bigint) + 1, length(t)) <> t
UNION ALL SELECT doc_id, NULL, 'incomplete' FROM (SELECT doc_id, sum(length(t)) AS n FROM p GROUP BY 1) JOIN s USING (doc_id) WHERE n < length(s)""")  # A22 A24 A29
def import_coverage(spark, sf):
    from treeline.sources.corpus import filled

    docs = corpus_docs(spark, sf)
    lines = docs.select("doc_id", F.posexplode(F.filter(F.split("source_text", "\n\n"), filled)).alias("i", "p")).select("doc_id", "i", F.posexplode(F.filter(F.split("p", "\n"), filled)).alias("j", "text"))
    text = F.when((F.col("doc_id") % 10 == 3) & (F.col("j") == 1), F.concat("text", F.lit("x"))).when((F.col("doc_id") % 10 == 4) & (F.col("j") == 1), "").otherwise(F.col("text"))
    rows = lines.select("doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), (F.col("i") + 1).cast("string"), F.col("j").cast("string")).alias("id"), (F.col("i") * 100_000 + F.col("j")).alias("source_position"), text.alias("text"))
    return jsontree.coverage_errors(rows, docs, "doc_id", "id")


@query("import_reassigned", """WITH d AS (SELECT DISTINCT import_id, item_id, address, source_position FROM import_nodes WHERE address IS NOT NULL), p AS (SELECT *, regexp_replace(address, '-?[0-9]+$', '') AS parent FROM d)
SELECT import_id, item_id, CASE WHEN parent = '' THEN '1' ELSE parent || '-' || row_number() OVER (PARTITION BY import_id, parent ORDER BY source_position NULLS LAST, item_id) END AS address FROM p""")  # A22 A23
def import_reassigned(spark, sf):
    d = table(spark, sf, "import_nodes").where("address is not null").select("import_id", "item_id", "address", "source_position").distinct()
    return jsontree.reassigned(d, "import_id", "item_id")


@query("html_records")  # A13 A14 A18
def html_records(spark, sf):
    page = F.concat(F.lit("<html><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.regexp_replace(F.regexp_replace("source_text", "<", "&lt;"), "\n\n", "</p><p>"), F.lit("</p></body></html>"))
    made = corpus_docs(spark, sf).select(F.concat("path", F.lit(".html")).alias("path"), page.cast("binary").alias("content")).where("path is not null")
    return files.parse_files(made)


_PARAS = """, f AS (SELECT doc_id, p, i FROM (SELECT doc_id, unnest(list_transform(ps, lambda x: trim(regexp_replace(regexp_replace(x, '[\\x{0}-\\x{8}\\x{E}-\\x{1F}]', '', 'g'), '[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')))) AS p, unnest(generate_series(1, len(ps))) AS i FROM ps)),
g AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f WHERE p <> '')"""


def _paragraphs(docs):
    """Paragraphs of every document with white space run together."""
    flat = F.transform(F.split("source_text", "\n\n"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"[\x00-\x08\x0E-\x1F]", ""), r"[\t-\r \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+", " ")))
    return docs.select("doc_id", F.filter(flat, lambda p: p != "").alias("texts"))


@query("office_records", f"""{_PARAS}, k AS (SELECT unnest(['docx', 'epub', 'xlsx', 'jsonl', 'csv', 'html']) AS kind)
SELECT doc_id || '.' || kind AS path, count(*) AS n, string_agg(p, '|' ORDER BY g.k) AS texts FROM g, k GROUP BY 1""")  # A11 A12 A13 A14 A15 A16 A18 A25
def office_records(spark, sf):
    """Every document's paragraphs written as DOCX, EPUB, XLSX, JSON lines, CSV and HTML, and read again: heading records left out."""
    from collections.abc import Iterator

    import pandas as pd

    from treeline.sources import office

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, texts in zip(pdf["doc_id"], pdf["texts"]):
                own = [(f"{doc}.{kind}", write("Title", list(texts))) for kind, write in office.WRITERS.items()]
                yield pd.DataFrame(own, columns=["path", "content"])

    made = _paragraphs(corpus_docs(spark, sf)).where(F.size("texts") > 0).mapInPandas(written, "path string, content binary")
    read = files.parse_files(made).where("text <> ''")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("record_no", "text"))), lambda x: x["text"])
    return read.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "|").alias("texts"))


@query("python_records", """WITH p AS (SELECT p_partkey, p_size % 4 AS k FROM part) SELECT p_partkey || '.py' AS path, CAST(3 + greatest(k, 1) AS bigint) AS n, 'IMPORT,IF,' || repeat('TEXT,', greatest(k, 1)) || 'TEXT' AS kinds FROM p""")  # A17 A18
def python_records(spark, sf):
    """Small programs made from the parts: two imports, a condition with a growing body, a last statement."""
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 4), lambda i: F.concat(F.lit("    x = "), i.cast("string"))), "\n")
    inner = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("\nif a:\n"), F.regexp_replace(body, r"\n?    x = 0\n?", "")))
    text = F.concat(F.lit("import a\nfrom b import c"), F.coalesce(inner, F.lit("\nif a: pass")), F.lit("\ny = 1\n"))
    made = table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), text.cast("binary").alias("content"))
    return files.parse_files(made).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "title"))), lambda x: x["title"]), ",").alias("kinds"))


@query("file_records")  # A4 A5 A18
def file_records(spark, sf):
    """Texts and Markdown files as they are; chats, which are no JSON lines, are read as text. Documents without a path get one."""
    path = F.regexp_replace(F.coalesce("path", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))), r"\.(jsonl|json)$", ".txt")
    return files.parse_files(corpus_docs(spark, sf).select(path.alias("path"), F.col("source_text").cast("binary").alias("content")))


@query("folder_tree", """, fp AS (SELECT string_split(path, '/') AS p FROM dc WHERE path IS NOT NULL AND NOT list_bool_or(list_transform(string_split(path, '/'), lambda x: starts_with(x, '.')))), fu AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS k FROM fp)
SELECT array_to_string(p[1:k], '/') AS folder, CAST(k AS int) AS depth, CAST(sum(CAST(k = len(p) - 1 AS int)) AS bigint) AS n_files, count(*) AS n_below FROM fu WHERE k <= 12 GROUP BY 1, 2""")  # A26 A27 J17
def folder_tree(spark, sf):
    return dump.folder_tree(corpus_docs(spark, sf))


@query("export_import", "SELECT id, address, text FROM n WHERE doc_id IN (SELECT doc_id FROM dc)")  # A30
def export_import(spark, sf):
    path = f"{scratch_dir(spark)}/dump"
    dump.export_tables({"nodes": corpus_nodes(spark, sf), "docs": corpus_docs(spark, sf)}, path)
    back = dump.import_tables(spark, path, {"nodes": ["id", "doc_id", "address", "text", "unknown"], "docs": ["doc_id"]})
    lost = dump.foreign_key_errors(back["nodes"], "doc_id", back["docs"], "doc_id").select("id").distinct()
    return back["nodes"].join(lost, "id", "left_anti").select("id", "address", "text")


@query("vector_inputs", ", c AS (SELECT id, concat_ws(chr(10), nullif(node_title, ''), text, node_note) AS input FROM n WHERE length(regexp_replace(text, '[\\t-\\r ]', '', 'g')) > 0) SELECT id, input FROM c")  # I12 P6
def vector_inputs(spark, sf):
    n = corpus_nodes(spark, sf).where(F.length(F.regexp_replace("text", r"\s", "")) > 0)
    put = F.concat_ws("\n", F.when(F.col("node_title") != "", F.col("node_title")), "text", "node_note")
    return n.select("id", put.alias("input"))


@query("char_counts", "SELECT id, length(text) AS chars, " + "coalesce(length(regexp_replace(text, '[\\t-\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]', '', 'g')), 0) AS body_chars FROM n")  # H4 N
def char_counts(spark, sf):
    return corpus_nodes(spark, sf).select("id", F.length("text").cast("long").alias("chars"), body_chars(F.col("text")).cast("long").alias("body_chars"))
