"""Queries of hashes, diffs, merges and histories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.operators import versions as V
from treeline.plans.session import materialize, table
from treeline.sources.corpus import CORPUS_SQL, corpus_nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query_into(queries: dict, oracle: dict[str, str]):
    """Decorator that registers a query and its SQL; SQL that does not begin with WITH continues the corpus tables."""

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = f
            if sql is not None:
                oracle[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {CORPUS_SQL} {sql}"
            return f

        return add

    return query


query = query_into(QUERIES, ORACLE)


_M = "(doc_id * 31 + sort_order * 7 + depth)"
_COLS = ("id", *V.MERGED, "sort_order", "address")


def _sides(spark, sf):
    n = corpus_nodes(spark, sf)
    m = F.col("doc_id") * 31 + F.col("sort_order") * 7 + F.col("depth")
    leaf = F.col("depth") == 3
    ours = n.where(~(leaf & (m % 13 == 0))).withColumns({
        "text": F.when(m % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")),
        "sort_order": F.when((m % 29 == 0) & (F.col("depth") == 2), F.col("sort_order") + 1000).otherwise(F.col("sort_order")),
    })
    added = n.where(m % 17 == 0).withColumn("id", F.concat("id", F.lit("o")))
    theirs = n.where(~((F.col("depth") > 1) & (m % 19 == 0))).withColumns({
        "text": F.when(m % 7 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")),
        "node_title": F.when(m % 11 == 0, F.concat("node_title", F.lit("+"))).otherwise(F.col("node_title")),
        "parent_id": F.when(leaf & (m % 23 == 0), F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("1"))).otherwise(F.col("parent_id")),
    })
    added_t = n.where((m % 34 == 0) | (m % 31 == 0)).withColumns({"id": F.concat("id", F.lit("o")), "node_note": F.when(m % 68 == 0, F.lit("x")).otherwise(F.col("node_note")), "parent_id": F.when(m % 31 == 0, F.col("id")).otherwise(F.col("parent_id"))})
    return n.select(*_COLS), ours.unionByName(added).select(*_COLS), theirs.unionByName(added_t).select(*_COLS)


_FIELDS = ", ".join(V.MERGED)
_SIDES = f""", m AS (SELECT *, {_M} AS m FROM n),
base AS (SELECT id, {_FIELDS}, sort_order, address FROM n),
ours AS (
  SELECT id, CASE WHEN m % 11 = 0 THEN text || '!' ELSE text END AS text, node_title, node_note, node_type, trust_level, parent_id, CASE WHEN m % 29 = 0 AND depth = 2 THEN sort_order + 1000 ELSE sort_order END AS sort_order, address FROM m WHERE NOT (depth = 3 AND m % 13 = 0)
  UNION ALL SELECT id || 'o', {_FIELDS}, sort_order, address FROM m WHERE m % 17 = 0),
theirs AS (
  SELECT id, CASE WHEN m % 7 = 0 THEN text || '?' ELSE text END AS text, CASE WHEN m % 11 = 0 THEN node_title || '+' ELSE node_title END AS node_title, node_note, node_type, trust_level,
    CASE WHEN depth = 3 AND m % 23 = 0 THEN doc_id || ':1' ELSE parent_id END AS parent_id, sort_order, address FROM m WHERE NOT (depth > 1 AND m % 19 = 0)
  UNION ALL SELECT id || 'o', text, node_title, CASE WHEN m % 68 = 0 THEN 'x' ELSE node_note END, node_type, trust_level, CASE WHEN m % 31 = 0 THEN id ELSE parent_id END, sort_order, address FROM m WHERE m % 34 = 0 OR m % 31 = 0)"""
_JSON = "to_json([" + ", ".join(f"coalesce({c}, '')" for c in V.CONTENT) + "])"


@query("content_hashes", f"SELECT id, left(sha256({_JSON}), 32) AS content_hash FROM n")  # H13
def content_hashes(spark, sf):
    return corpus_nodes(spark, sf).select("id", V.content_hash().alias("content_hash"))


@query("merkle", f""", h AS (SELECT id, parent_id, depth, sort_order, left(sha256({_JSON}), 32) AS c FROM n),
d3 AS (SELECT *, left(sha256(to_json([c])), 32) AS s FROM h WHERE depth = 3),
k3 AS (SELECT parent_id, list(s ORDER BY sort_order, id) AS k FROM d3 GROUP BY 1),
d2 AS (SELECT h.*, left(sha256(to_json(list_concat([c], coalesce(k, [])))), 32) AS s FROM h LEFT JOIN k3 ON k3.parent_id = h.id WHERE depth = 2),
k2 AS (SELECT parent_id, list(s ORDER BY sort_order, id) AS k FROM d2 GROUP BY 1),
d1 AS (SELECT h.*, left(sha256(to_json(list_concat([c], coalesce(k, [])))), 32) AS s FROM h LEFT JOIN k2 ON k2.parent_id = h.id WHERE depth = 1)
SELECT id, c AS content_hash, s AS subtree_hash FROM d1 UNION ALL SELECT id, c, s FROM d2 UNION ALL SELECT id, c, s FROM d3""")  # K1 K2 D14 H14 H15
def merkle(spark, sf):
    return V.subtree_hashes(corpus_nodes(spark, sf))


_KIDS = "SELECT coalesce(parent_id, 'root') AS p, list(id ORDER BY id) AS s FROM {} GROUP BY 1"


@query("field_diff", f"""{_SIDES}, same AS (SELECT a.p, a.s = b.s AS same FROM ({_KIDS.format('base')}) a JOIN ({_KIDS.format('ours')}) b USING (p)),
j AS (SELECT b.*, a.text AS a_text, a.node_title AS a_node_title, a.node_note AS a_node_note, a.node_type AS a_node_type, a.trust_level AS a_trust_level, a.parent_id AS a_parent, a.sort_order AS a_sort, a.address AS a_address, same.same FROM base a JOIN ours b USING (id) LEFT JOIN same ON p = coalesce(b.parent_id, 'root'))
SELECT id, '*' AS field, NULL AS old, text AS new FROM ours ANTI JOIN base USING (id) UNION ALL SELECT id, '*', text, NULL FROM base ANTI JOIN ours USING (id)
""" + "".join(f" UNION ALL SELECT id, '{f}', a_{f}, {f} FROM j WHERE {f} IS DISTINCT FROM a_{f}" for f in V.CONTENT) + " UNION ALL SELECT id, '__moved__', a_address, address FROM j WHERE parent_id IS DISTINCT FROM a_parent OR (sort_order <> a_sort AND coalesce(same, false))")  # K7 K17 K18 C8
def field_diff(spark, sf):
    base, ours, _ = _sides(spark, sf)
    return V.field_diff(base, ours)


_RANK = "SELECT x.id, row_number() OVER (PARTITION BY x.parent_id ORDER BY x.sort_order, x.id) AS r FROM {0} x SEMI JOIN {1} USING (id)"


@query("tree_diff", f"""{_SIDES}, r AS (SELECT a.id, a.r AS ra, b.r AS rb FROM ({_RANK.format('base', 'ours')}) a JOIN ({_RANK.format('ours', 'base')}) b USING (id)),
j AS (SELECT coalesce(a.id, b.id) AS id, a.id IS NULL AS came, b.id IS NULL AS gone, concat_ws(',', {', '.join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} THEN '{f}' END" for f in V.MERGED)}, CASE WHEN a.parent_id IS NOT DISTINCT FROM b.parent_id AND ra <> rb THEN 'sort_order' END) AS f
FROM base a FULL JOIN ours b ON a.id = b.id LEFT JOIN r ON r.id = a.id)
SELECT id, CASE WHEN came THEN 'added' WHEN gone THEN 'deleted' WHEN f = '' THEN 'unchanged' ELSE 'modified' END AS status, CASE WHEN came OR gone THEN '' ELSE f END AS changed_fields FROM j""")  # K8 K9 E8 D18
def tree_diff(spark, sf):
    base, ours, _ = _sides(spark, sf)
    return V.tree_diff(base, ours)


def _any(a: str, b: str) -> str:
    return "(" + " OR ".join(f"{a}.{f} IS DISTINCT FROM {b}.{f}" for f in V.MERGED) + ")"


_CLASH = "concat_ws(',', " + ", ".join(f"CASE WHEN a.{f} IS DISTINCT FROM b.{f} AND a.{f} IS DISTINCT FROM c.{f} AND b.{f} IS DISTINCT FROM c.{f} THEN '{f}' END" for f in V.MERGED) + ")"
_NEW = "concat_ws(',', " + ", ".join(f"CASE WHEN b.{f} IS DISTINCT FROM c.{f} THEN '{f}' END" for f in V.MERGED) + ")"
_MERGE = f"""{_SIDES}, ids AS (SELECT id FROM base UNION SELECT id FROM ours UNION SELECT id FROM theirs),
v AS (SELECT ids.id,
 CASE WHEN a.id IS NULL AND b.id IS NOT NULL AND c.id IS NOT NULL THEN {_NEW}
      WHEN a.id IS NOT NULL AND (b.id IS NULL) <> (c.id IS NULL) THEN CASE WHEN (b.id IS NOT NULL AND {_any('a', 'b')}) OR (c.id IS NOT NULL AND {_any('a', 'c')}) THEN '__node__' ELSE '' END
      WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN {_CLASH} ELSE '' END AS f,
 CASE WHEN c.parent_id IS NOT NULL AND c.parent_id NOT IN (SELECT id FROM ours) AND NOT (c.parent_id NOT IN (SELECT id FROM base) AND c.parent_id IN (SELECT id FROM theirs))
   AND ((a.id IS NULL AND b.id IS NULL) OR (a.id IS NOT NULL AND b.id IS NOT NULL AND c.parent_id IS DISTINCT FROM a.parent_id AND b.parent_id IS NOT DISTINCT FROM a.parent_id)) THEN '__parent__' END AS g,
 CASE WHEN a.id IS NULL THEN CASE WHEN b.id IS NOT NULL AND c.id IS NOT NULL THEN 'added-converged' WHEN b.id IS NOT NULL THEN 'added-ours' ELSE 'added-theirs' END
      WHEN b.id IS NULL OR c.id IS NULL THEN 'deleted' WHEN NOT {_any('a', 'b')} AND NOT {_any('a', 'c')} THEN 'unchanged' WHEN NOT {_any('a', 'b')} THEN 'theirs' WHEN NOT {_any('a', 'c')} THEN 'ours' ELSE 'merged' END AS p
 FROM ids LEFT JOIN base a ON a.id = ids.id LEFT JOIN ours b ON b.id = ids.id LEFT JOIN theirs c ON c.id = ids.id),
w AS (SELECT id, concat_ws(',', nullif(f, ''), g) AS conflict_fields, p FROM v)"""


@query("merge3", f"{_MERGE} SELECT id, CASE WHEN conflict_fields <> '' THEN 'conflict' ELSE p END AS resolution, conflict_fields FROM w")  # K10 K11 C9 G2
def merge3(spark, sf):
    return V.three_way(*_sides(spark, sf))


@query("merge3_summary", f"{_MERGE} SELECT CASE WHEN conflict_fields <> '' THEN 'conflict' ELSE p END AS resolution, count(*) AS n FROM w GROUP BY 1")  # D18
def merge3_summary(spark, sf):
    return V.three_way(*_sides(spark, sf)).groupBy("resolution").agg(F.count(F.lit(1)).alias("n"))


def _won(f: str) -> str:
    return f"CASE WHEN c.id IS NULL THEN b.{f} WHEN b.id IS NULL THEN c.{f} WHEN a.id IS NOT NULL AND a.{f} IS NOT DISTINCT FROM b.{f} THEN c.{f} ELSE b.{f} END AS {f}"


@query("merge3_rows", f"""{_MERGE} SELECT w.id, {', '.join(_won(f) for f in V.MERGED)} FROM w LEFT JOIN base a ON a.id = w.id LEFT JOIN ours b ON b.id = w.id LEFT JOIN theirs c ON c.id = w.id
WHERE NOT (p = 'deleted' AND conflict_fields = '') AND NOT (starts_with(conflict_fields, '__node__') AND b.id IS NULL)""")  # K13
def merge3_rows(spark, sf):
    return V.merged_rows(*_sides(spark, sf))


_COMMITS = "c AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)"


def _commits(spark, sf):
    from pyspark.sql.window import Window

    o = table(spark, sf, "orders")
    up, down = Window.partitionBy("o_custkey").orderBy("o_orderkey"), Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    return o.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(up).alias("parent_id"), F.row_number().over(down).alias("r"))


@query("commit_ancestry", f"WITH RECURSIVE {_COMMITS}, t AS (SELECT id AS head, id, 0 AS distance, parent_id FROM c WHERE r = 1 UNION ALL SELECT head, c.id, distance + 1, c.parent_id FROM t JOIN c ON c.id = t.parent_id) SELECT head, id, CAST(distance AS bigint) AS distance FROM t")  # K15 K16
def commit_ancestry(spark, sf):
    c = _commits(spark, sf)
    return V.chain(c.select("id", "parent_id"), c.where("r = 1").select("id"))


@query("gc_objects", f"WITH RECURSIVE {_COMMITS}, t AS (SELECT id, parent_id FROM c WHERE r = 3 UNION SELECT c.id, c.parent_id FROM t JOIN c ON c.id = t.parent_id) SELECT id AS hash FROM c WHERE id NOT IN (SELECT id FROM t)")  # K22 G4
def gc_objects(spark, sf):
    c = materialize(_commits(spark, sf), "commits")
    edges = c.where("parent_id is not null").select(F.col("id").alias("parent"), F.col("parent_id").alias("child"))
    return V.unreachable(c.select(F.col("id").alias("hash")), edges, c.where("r = 3").select(F.col("id").alias("hash")))


@query("new_objects", f", h AS (SELECT DISTINCT left(sha256({_JSON}), 32) AS hash, doc_id % 2 AS old FROM n) SELECT DISTINCT hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE old = 0)")  # K3 K4
def new_objects(spark, sf):
    h = corpus_nodes(spark, sf).select(V.content_hash().alias("hash"), (F.col("doc_id") % 2).alias("old"))
    return V.new_objects(h.where("old = 0"), h.select("hash")).select("hash")


@query("materialised_tree", "SELECT id AS node_id, address, depth, sort_order FROM n WHERE doc_id = (SELECT min(doc_id) FROM n)")  # K5 K24 J21 P3
def materialised_tree(spark, sf):
    nodes = corpus_nodes(spark, sf)
    first = nodes.agg(F.min("doc_id")).first()[0]
    one = nodes.where(F.col("doc_id") == first)
    kids = one.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "id"))), lambda x: x["id"]).alias("children"))
    objects = one.join(kids, "id", "left").select(F.col("id").alias("hash"), F.col("id").alias("node_id"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    return V.materialise_tree(objects, f"{first}:1")


_LOG = """WITH s AS (SELECT doc_id, snapshot_no AS step, id, sha256(text) AS mark FROM node_snapshots QUALIFY row_number() OVER (PARTITION BY doc_id, snapshot_no, id ORDER BY loaded_at DESC) = 1),
st AS (SELECT doc_id, step, lead(step) OVER w AS next_step, lag(step) OVER w AS prev_step FROM (SELECT DISTINCT doc_id, step FROM s) WINDOW w AS (PARTITION BY doc_id ORDER BY step)),
r AS (SELECT s.*, next_step, prev_step, lag(step) OVER w AS last_step, lag(mark) OVER w AS last_mark, lead(step) OVER w AS again FROM s JOIN st USING (doc_id, step) WINDOW w AS (PARTITION BY doc_id, id ORDER BY step))
SELECT doc_id, id, step, CASE WHEN last_step IS NULL OR last_step <> prev_step THEN 'added' ELSE 'changed' END AS event FROM r WHERE last_step IS NULL OR last_step <> prev_step OR last_mark <> mark
UNION ALL SELECT doc_id, id, next_step, 'deleted' FROM r WHERE next_step IS NOT NULL AND again IS DISTINCT FROM next_step"""


@query("node_log", _LOG)  # K16 E11
def node_log(spark, sf):
    s = table(spark, sf, "node_snapshots").groupBy("doc_id", F.col("snapshot_no").alias("step"), "id").agg(F.max_by("text", "loaded_at").alias("text"))
    return V.node_log(s.select("doc_id", "step", "id", F.sha2("text", 256).alias("mark")))


@query("branch_validation", """, o AS (SELECT (doc_id * 1000 + sort_order) * 2 + k AS seq, CASE WHEN sort_order % 6 = 0 THEN id || 'x' ELSE id END AS id, 'text' AS field, CASE WHEN k = 1 THEN text || '1' WHEN sort_order % 4 = 0 THEN 'other' ELSE text END AS old, CASE WHEN k = 0 THEN text || '1' WHEN sort_order % 8 = 0 THEN text ELSE text || '12' END AS new FROM n, (SELECT unnest([0, 1]) AS k) WHERE depth = 2),
p AS (SELECT id, field, arg_min(old, seq) AS old, arg_max(new, seq) AS new FROM o GROUP BY 1, 2)
SELECT p.id, field, old, new, CASE WHEN n.id IS NULL THEN 'blocked:node-deleted' WHEN n.text <> old AND n.text <> new THEN 'conflict:content-drift' ELSE 'ok' END AS verdict FROM p LEFT JOIN n ON n.id = p.id""")  # K12
def branch_validation(spark, sf):
    n = corpus_nodes(spark, sf)
    o = n.where("depth = 2").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        ((F.col("doc_id") * 1000 + F.col("sort_order")) * 2 + F.col("k")).alias("seq"), F.when(F.col("sort_order") % 6 == 0, F.concat("id", F.lit("x"))).otherwise(F.col("id")).alias("id"), F.lit("text").alias("field"),
        F.when(F.col("k") == 1, F.concat("text", F.lit("1"))).when(F.col("sort_order") % 4 == 0, "other").otherwise(F.col("text")).alias("old"),
        F.when(F.col("k") == 0, F.concat("text", F.lit("1"))).when(F.col("sort_order") % 8 == 0, F.col("text")).otherwise(F.concat("text", F.lit("12"))).alias("new"),
    )
    return V.validate_ops(o, n)


@query("diff_view", f"""{_SIDES}, r AS (SELECT a.id, a.r AS ra, b.r AS rb FROM ({_RANK.format('base', 'ours')}) a JOIN ({_RANK.format('ours', 'base')}) b USING (id)),
j AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deleted' WHEN {_any('a', 'b')} OR ra <> rb AND a.parent_id IS NOT DISTINCT FROM b.parent_id THEN 'modified' ELSE 'unchanged' END AS status, coalesce(b.address, a.address) AS address FROM base a FULL JOIN ours b ON a.id = b.id LEFT JOIN r ON r.id = a.id),
d AS (SELECT *, split_part(id, ':', 1) AS doc_id, array_to_string(list_transform(string_split(address, '-'), lambda x: lpad(x, 10, '0')), '-') AS key FROM j),
up AS (SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(string_split(address, '-'))), lambda k: array_to_string(string_split(address, '-')[1:k], '-'))) AS address FROM d WHERE status <> 'unchanged'),
s AS (SELECT d.*, up.address IS NOT NULL AS shown, row_number() OVER (PARTITION BY d.doc_id ORDER BY key, id) AS place FROM d LEFT JOIN up ON up.doc_id = d.doc_id AND up.address = d.address),
mk AS (SELECT *, sum(CAST(shown AS int)) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM s)
SELECT doc_id, CAST(place AS int) AS place, 'row' AS kind, id, status, 1 AS n FROM mk WHERE shown UNION ALL SELECT doc_id, CAST(min(place) AS int), 'fold', NULL, 'unchanged', count(*) FROM mk WHERE NOT shown GROUP BY doc_id, run""")  # K9
def diff_view(spark, sf):
    from treeline.functions.columns import address_key

    base, ours, _ = _sides(spark, sf)
    both = base.select("id", F.col("address").alias("a")).join(ours.select("id", F.col("address").alias("b")), "id", "full")
    address = F.coalesce("b", "a")
    places = both.select(F.split("id", ":")[0].alias("doc_id"), "id", address.alias("address"), address_key(address).alias("key"))
    return V.diff_view(V.tree_diff(base, ours).select("id", "status"), places)
