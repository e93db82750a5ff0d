"""Queries of scans, filters, tree reads, aggregates and windows over the corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.columns import address_array, address_key, body_chars
from treeline.operators import tree as T
from treeline.plans.session import table
from treeline.sources.corpus import CORPUS_SQL, body_sql, corpus_docs, corpus_nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
_KEY = "array_to_string(list_transform(string_split(address, '-'), lambda x: lpad(x, 10, '0')), '-')"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = f"WITH {CORPUS_SQL} {sql}" if not sql.lstrip().startswith("WITH") else sql
        return f

    return add


def _n(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_nodes(spark, sf)


@query("corpus_nodes", "SELECT id, parent_id, address, depth, node_type, text, node_title, node_note FROM n")
def corpus(spark, sf):
    return _n(spark, sf).select("id", "parent_id", "address", "depth", "node_type", "text", "node_title", "node_note")


@query("scan_child_count", """, c AS (SELECT parent_id AS id, count(*) AS k FROM n GROUP BY 1)
SELECT n.id, coalesce(k, 0) AS child_count FROM n LEFT JOIN c ON c.id = n.id""")  # A1 C1 D7 J10
def scan_child_count(spark, sf):
    return T.child_counts(_n(spark, sf)).select("id", "child_count")


_ASKED = ("3:1-2", "1:1", "3:1-1", "3:1-2", "nowhere", "9:1-1")


@query("rows_by_ids", f", a AS (SELECT unnest({list(dict.fromkeys(_ASKED))}) AS id, unnest(generate_series(0, 4)) AS place) SELECT place, n.id, text FROM a JOIN n ON n.id = a.id")  # A3 J11
def rows_by_ids(spark, sf):
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(_ASKED))], "place long, id string")
    return _n(spark, sf).join(F.broadcast(asked), "id").select("place", "id", "text")


@query("projection_summary", """SELECT id, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS summary, coalesce(node_note, '') AS note, trust_level FROM n WHERE depth > 1""")  # B1 B13
def projection_summary(spark, sf):
    clip = F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 37), F.lit("..."))).otherwise(F.col("text"))
    return _n(spark, sf).where("depth > 1").select("id", clip.alias("summary"), F.coalesce("node_note", F.lit("")).alias("note"), "trust_level")


@query("like_filter", """SELECT id FROM n WHERE (contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the ') OR contains(translate(node_title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the '))
AND contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '100%') = false""")  # B2 H27
def like_filter(spark, sf):
    from treeline.functions.columns import ascii_lower

    text, title = ascii_lower(F.col("text")), ascii_lower(F.col("node_title"))
    return _n(spark, sf).where((text.contains("the ") | title.contains("the ")) & ~text.contains("100%")).select("id")


@query("subtree", "SELECT id, address FROM n WHERE address = '1-2' OR starts_with(address, '1-2-')")  # B3 J2 J8
def subtree(spark, sf):
    return T.subtree(_n(spark, sf), "1-2").select("id", "address")


@query("subtree_levels", "SELECT id FROM n WHERE (address = '1' OR starts_with(address, '1-')) AND depth - 1 < 2")  # B4 J4
def subtree_levels(spark, sf):
    return T.subtree(_n(spark, sf), "1", 2).select("id")


@query("depth_slice", "SELECT id, depth FROM n WHERE depth BETWEEN 2 AND 3")  # B5
def depth_slice(spark, sf):
    return T.depth_range(_n(spark, sf), 3, 2).select("id", "depth")


@query("row_scope", """SELECT id FROM n WHERE doc_id IN (SELECT doc_id FROM dc WHERE source_type = 'md') AND trust_level = '受控' AND (updated_at = '' OR (updated_at >= '2024-01-02' AND updated_at < '2024-02-01'))""")  # B6 C4
def row_scope(spark, sf):
    scope = corpus_docs(spark, sf).where("source_type = 'md'").select("doc_id")
    rows = _n(spark, sf).where((F.col("trust_level") == "受控") & ((F.col("updated_at") == "") | F.col("updated_at").between("2024-01-02", "2024-01-31 99")))
    return rows.join(scope, "doc_id", "left_semi").select("id")


@query("doc_kinds", """, k AS (SELECT dc.doc_id, CASE WHEN json_valid(meta) AND json_extract(meta, '$.memoryVolume') IS NOT NULL THEN 'event'
WHEN dc.doc_id IN (SELECT doc_id FROM n WHERE trust_level IS NOT NULL) THEN 'memory' ELSE 'knowledge' END AS kind FROM dc) SELECT doc_id, kind FROM k""")  # B7 B8 H22 H23
def doc_kinds(spark, sf):
    trusted = _n(spark, sf).where("trust_level is not null").select("doc_id").distinct().withColumn("t", F.lit(True))
    kind = F.when(F.get_json_object("meta", "$.memoryVolume").isNotNull(), "event").when(F.col("t"), "memory").otherwise("knowledge")
    return corpus_docs(spark, sf).join(trusted, "doc_id", "left").select("doc_id", kind.alias("kind"))


@query("folder_filter", """SELECT doc_id FROM dc WHERE (path = 'ward' OR starts_with(coalesce(path, ''), 'ward/')) AND NOT (coalesce(path, '') = 'ward/chat' OR starts_with(coalesce(path, ''), 'ward/chat/'))
AND NOT list_bool_or(list_transform(string_split(coalesce(path, ''), '/'), lambda x: starts_with(x, '.')))""")  # B9 B10 B11 G3 H29
def folder_filter(spark, sf):
    path = F.coalesce("path", F.lit(""))
    under = lambda f: (path == f) | path.startswith(f + "/")
    hidden = F.exists(F.split(path, "/"), lambda s: s.startswith("."))
    docs = corpus_docs(spark, sf)
    include, exclude = docs.where(under("ward")).select("doc_id"), docs.where(~under("ward/chat") & ~hidden).select("doc_id")
    return include.intersect(exclude)


@query("doc_page", "SELECT doc_id, title FROM dc ORDER BY folder_id IS NOT NULL, folder_id, updated_at DESC, doc_id DESC LIMIT 20 OFFSET 40")  # B12 F9
def doc_page(spark, sf):
    order = [F.col("folder_id").isNotNull(), F.col("folder_id"), F.desc("updated_at"), F.desc("doc_id")]
    return corpus_docs(spark, sf).orderBy(*order).offset(40).limit(20).select("doc_id", "title")


@query("unique_titles", "SELECT title, min(doc_id) AS doc_id FROM dc WHERE title IS NOT NULL GROUP BY title HAVING count(*) = 1")  # B15
def unique_titles(spark, sf):
    return corpus_docs(spark, sf).where("title is not null").groupBy("title").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")


@query("node_doc_join", "SELECT n.id, dc.title FROM n JOIN dc USING (doc_id) WHERE n.depth = 3")  # C2
def node_doc_join(spark, sf):
    return _n(spark, sf).where("depth = 3").join(corpus_docs(spark, sf).select("doc_id", "title"), "doc_id").select("id", "title")


@query("doc_listing", f"SELECT doc_id, count(*) AS n_nodes, max(depth) AS max_depth, CAST(sum({body_sql('text')}) AS bigint) AS body_chars FROM n GROUP BY doc_id")  # D1 B19
def doc_listing(spark, sf):
    return _n(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("max_depth"), F.sum(body_chars(F.col("text"))).cast("long").alias("body_chars"))


@query("layers", f"SELECT doc_id, depth, count(*) AS n_nodes, CAST(sum(CASE WHEN depth > 1 THEN {body_sql('text')} ELSE 0 END) AS bigint) AS body_chars FROM n GROUP BY 1, 2")  # D2 D6
def layers(spark, sf):
    return T.layer_counts(_n(spark, sf)).select("doc_id", "depth", "n_nodes", F.col("body_chars").cast("long").alias("body_chars"))


@query("subtree_rollup", f", a AS (SELECT id, doc_id, address, {body_sql('text')} AS v FROM n) SELECT a.id, CAST(sum(b.v) AS bigint) AS total FROM a JOIN a b ON a.doc_id = b.doc_id AND (b.address = a.address OR starts_with(b.address, a.address || '-')) GROUP BY 1")  # D3 D4
def subtree_rollup(spark, sf):
    return T.subtree_rollup(_n(spark, sf), body_chars(F.col("text"))).select("id", F.col("total").cast("long").alias("total"))


@query("group_meta", f""", w AS (SELECT doc_id, max(k) AS max_width FROM (SELECT doc_id, parent_id, count(*) AS k FROM n WHERE parent_id IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT doc_id, count(*) AS n_nodes, min(depth) AS min_depth, max(depth) AS max_depth, max(depth) - min(depth) + 1 AS depth_span, CAST(sum({body_sql('text')}) AS bigint) AS body_chars, coalesce(any_value(max_width), 0) AS max_width
FROM n LEFT JOIN w USING (doc_id) GROUP BY doc_id""")  # D5
def group_meta(spark, sf):
    return T.group_meta(_n(spark, sf)).withColumn("body_chars", F.col("body_chars").cast("long"))


@query("table_stats", "SELECT 'nodes' AS name, count(*) AS n FROM n UNION ALL SELECT 'docs', count(*) FROM dc UNION ALL SELECT 'axioms', count(*) FROM axioms")  # D8 D9 G1
def table_stats(spark, sf):
    parts = {"nodes": _n(spark, sf), "docs": corpus_docs(spark, sf), "axioms": table(spark, sf, "axioms")}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("subtree_text", f"SELECT doc_id, string_agg(text, chr(10) ORDER BY {_KEY}) AS body FROM n WHERE depth > 1 AND {body_sql('text')} > 0 GROUP BY 1")  # D13
def subtree_text(spark, sf):
    return T.subtree_text(_n(spark, sf))


@query("duplicate_addresses", "SELECT doc_id, address, count(*) AS n FROM nodes WHERE address IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")  # D21
def duplicate_addresses(spark, sf):
    return table(spark, sf, "nodes").where("address is not null").groupBy("doc_id", "address").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("axiom_next_label", "SELECT doc_id, 1 + coalesce(max(try_cast(regexp_extract(label, '^A([0-9]+)$', 1) AS int)), 0) AS next_label FROM axioms GROUP BY 1")  # D20 F10
def axiom_next_label(spark, sf):
    n = F.regexp_extract("label", "^A([0-9]+)$", 1).try_cast("int")
    return table(spark, sf, "axioms").groupBy("doc_id").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_label"))


@query("renumber", "SELECT id, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY sort_order NULLS LAST, id) AS ordinal FROM n")  # E1 E2 E9
def renumber(spark, sf):
    return T.renumber(_n(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("siblings", "SELECT id, lag(id) OVER w AS previous_id, lead(id) OVER w AS next_id FROM n WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY sort_order, id)")  # E4 E12 J15
def siblings(spark, sf):
    return T.neighbours(_n(spark, sf))


@query("dfs_order", f"SELECT id, lag(id) OVER w AS before_id, lead(id) OVER w AS after_id FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY {_KEY})")  # H12 F1 F2
def dfs_order(spark, sf):
    return T.dfs_neighbours(_n(spark, sf))


@query("children_page", ", r AS (SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, id) - 1 AS place FROM n WHERE parent_id IS NOT NULL) SELECT * FROM r WHERE place >= 2 AND place < 5")  # E3 J6
def children_page(spark, sf):
    return T.children_page(_n(spark, sf), 2, 3).withColumn("place", F.col("place").cast("long"))


_RUN = f"SELECT doc_id, id, text, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY {_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used_before FROM n WHERE depth > 1"


@query("budget_page", f", r AS ({_RUN}) SELECT doc_id, id, CAST(used_before AS bigint) AS used_before FROM r WHERE used_before < 500")  # E5 J9
def budget_page(spark, sf):
    return T.budget_page(_n(spark, sf), 500)


@query("clipped_text", f", r AS ({_RUN}) SELECT doc_id, id, substr(text, 1, CAST(500 - used_before AS bigint)) AS piece FROM r WHERE used_before < 500")  # E7
def clipped_text(spark, sf):
    return T.clipped_text(_n(spark, sf), 500)


@query("layer_stop", f""", l AS (SELECT doc_id, depth, sum(CASE WHEN depth > 1 THEN {body_sql('text')} ELSE 0 END) AS b FROM n GROUP BY 1, 2),
c AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY depth) AS used, min(CASE WHEN b > 0 THEN depth END) OVER (PARTITION BY doc_id) AS first FROM l)
SELECT doc_id, max(depth) AS stop_depth FROM c WHERE used <= 300 OR depth <= first GROUP BY 1""")  # E6 J3
def layer_stop(spark, sf):
    return T.layer_stop(_n(spark, sf), 300)


@query("ancestors", """, a AS (SELECT doc_id, id, address AS asked, depth FROM n WHERE depth = 3)
SELECT a.doc_id, asked, a.depth - n.depth AS rank, n.id, n.address FROM a JOIN n ON n.doc_id = a.doc_id AND (n.address = asked OR starts_with(asked, n.address || '-'))""")  # C7 J7 J18 H11
def ancestors(spark, sf):
    nodes = _n(spark, sf)
    return T.ancestors(nodes, nodes.where("depth = 3"))


@query("keyset_page", "SELECT id FROM n WHERE id > '5:1' ORDER BY id LIMIT 500")  # F7
def keyset_page(spark, sf):
    return T.keyset_page(_n(spark, sf), "5:1", 500).select("id")


@query("markdown_export", f""", b AS (SELECT doc_id, {_KEY} AS k, concat_ws(chr(10) || chr(10), CASE WHEN node_title <> '' THEN repeat('#', least(greatest(depth, 2), 6)) || ' ' || node_title END, nullif(text, '')) AS t FROM n)
SELECT doc_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY k) FILTER (t <> ''), '') AS markdown FROM b GROUP BY 1""")  # A35
def markdown_export(spark, sf):
    return T.markdown_export(_n(spark, sf))


@query("ascii_tree", f""", c AS (SELECT parent_id AS id, count(*) AS k FROM n GROUP BY 1), f AS (SELECT n.*, coalesce(k, 0) AS k, regexp_replace(coalesce(nullif(node_title, ''), text), '[\\t-\\r ]+', ' ', 'g') AS flat, {_KEY} AS key FROM n LEFT JOIN c ON c.id = n.id)
SELECT doc_id, string_agg(repeat('  ', depth - 1) || '- ' || address || ' ' || CASE WHEN length(flat) > 60 THEN left(flat, 59) || '…' ELSE flat END || ' [children=' || k || ']', chr(10) ORDER BY key) AS listing FROM f GROUP BY 1""")  # A36
def ascii_tree(spark, sf):
    return T.ascii_tree(_n(spark, sf))


@query("single_child_chains", """, c AS (SELECT parent_id, count(*) AS k, min(id) AS child_id FROM n GROUP BY 1), leaf AS (SELECT id FROM n WHERE node_type = 'TEXT' AND id NOT IN (SELECT parent_id FROM n WHERE parent_id IS NOT NULL))
SELECT parent_id AS id, child_id FROM c WHERE parent_id IS NOT NULL AND k = 1 AND child_id IN (SELECT id FROM leaf)""")  # J20
def single_child_chains(spark, sf):
    return T.single_child_chains(_n(spark, sf))


@query("source_order", "SELECT import_id, item_id, row_number() OVER (PARTITION BY import_id ORDER BY source_position NULLS LAST, item_id) AS place FROM (SELECT DISTINCT * FROM import_nodes)")  # F8 E10
def source_order(spark, sf):
    w = Window.partitionBy("import_id").orderBy(F.col("source_position").asc_nulls_last(), "item_id")
    return table(spark, sf, "import_nodes").distinct().select("import_id", "item_id", F.row_number().over(w).cast("long").alias("place"))


@query("address_sorted_load", """WITH d AS (SELECT DISTINCT import_id, address FROM import_nodes WHERE address IS NOT NULL),
p AS (SELECT *, regexp_replace(address, '-[0-9]+$', '') AS parent_address FROM d)
SELECT p.import_id, p.address, CASE WHEN d.address IS NOT NULL AND p.address <> p.parent_address THEN p.parent_address END AS parent_address FROM p LEFT JOIN d ON d.import_id = p.import_id AND d.address = p.parent_address""")  # A28
def address_sorted_load(spark, sf):
    d = table(spark, sf, "import_nodes").where("address is not null").select("import_id", "address").distinct()
    p = d.withColumn("up", F.regexp_replace("address", "-[0-9]+$", ""))
    have = d.select("import_id", F.col("address").alias("up"), F.lit(True).alias("there"))
    parent = F.when(F.col("there") & (F.col("address") != F.col("up")), F.col("up"))
    return p.join(have, ["import_id", "up"], "left").select("import_id", "address", parent.alias("parent_address"))


@query("address_order", "SELECT id, row_number() OVER (PARTITION BY doc_id ORDER BY list_transform(string_split(address, '-'), lambda x: CAST(x AS int)), id) AS place FROM n")  # F1
def address_order(spark, sf):
    w = Window.partitionBy("doc_id").orderBy(address_array(F.col("address")), "id")
    return _n(spark, sf).select("id", F.row_number().over(w).cast("long").alias("place"))


@query("latest_docs", "SELECT doc_id, updated_at FROM dc ORDER BY updated_at DESC, doc_id DESC LIMIT 5")  # F13
def latest_docs(spark, sf):
    return corpus_docs(spark, sf).orderBy(F.desc("updated_at"), F.desc("doc_id")).limit(5).select("doc_id", "updated_at")


@query("truncation_probe", "SELECT id, (SELECT count(*) FROM n WHERE depth = 2) > 1000 AS truncated FROM n WHERE depth = 2 ORDER BY id LIMIT 1000")  # F14 B18
def truncation_probe(spark, sf):
    from treeline.operators.sqlread import read_only_sql

    _n(spark, sf).createOrReplaceTempView("treeline_nodes")
    return read_only_sql(spark, "SELECT id FROM treeline_nodes WHERE depth = :depth ORDER BY id", limit=1000, args={"depth": 2})
