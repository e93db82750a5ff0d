"""Queries of node reads, appends, commits, restores, reverts, branch merges and index upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.columns import clean_ref
from treeline.operators import lifecycle as L
from treeline.operators import versions as V
from treeline.operators.live import current_rows, live_rows
from treeline.plans.history import _JSON, _MERGE, _SIDES, _commits, _sides, _won, query_into
from treeline.plans.session import materialize, scratch_dir, table
from treeline.plans.training import _LIVE
from treeline.sources.corpus import body_sql, corpus_docs, corpus_nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = query_into(QUERIES, ORACLE)

_KEY = "array_to_string(list_transform(string_split(address, '-'), lambda x: lpad(x, 10, '0')), '-')"
_ASKED = ("1", " 1-2 ", "1-3-1", "1-02", "0", "1-999", "x")


@query("node_reads", f""", a AS (SELECT doc_id, trim(unnest({list(_ASKED)})) AS address FROM dc), c AS (SELECT parent_id AS id, count(*) AS k FROM n GROUP BY 1)
SELECT n.doc_id, n.address, n.id, coalesce(k, 0) AS child_count FROM a JOIN n USING (doc_id, address) LEFT JOIN c ON c.id = n.id""")  # B14 B20 J5
def node_reads(spark, sf):
    """Every third document has lost its stored addresses: there the ordinals are walked."""
    nodes = corpus_nodes(spark, sf)
    asked = corpus_docs(spark, sf).select("doc_id", F.explode(F.array(*[F.lit(a) for a in _ASKED])).alias("address"))
    lost = nodes.withColumn("address", F.when(F.col("doc_id") % 3 != 0, F.col("address")))
    return L.resolve_addresses(lost, asked)


@query("depth_exists", "SELECT dc.doc_id, coalesce(bool_or(n.depth = 3), false) AS present FROM dc LEFT JOIN n ON n.doc_id = dc.doc_id GROUP BY 1")  # B21
def depth_exists(spark, sf):
    return L.has_depth(corpus_nodes(spark, sf), corpus_docs(spark, sf), 3)


@query("docs_with_sources", "WITH s AS (SELECT DISTINCT doc_id, id FROM source_spans WHERE id IS NOT NULL) SELECT docs.id, count(s.id) AS n_spans FROM docs LEFT JOIN s ON s.doc_id = docs.id GROUP BY 1")  # C3
def docs_with_sources(spark, sf):
    spans = table(spark, sf, "source_spans").where("id is not null").select("doc_id", F.col("id").alias("span")).distinct().groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return table(spark, sf, "docs").select("id").join(spans, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("n_spans"))


@query("tree_objects", f""", h AS (SELECT id, parent_id, depth, sort_order, left(sha256({_JSON}), 32) AS c FROM n),
d3 AS (SELECT *, left(sha256(to_json([c, id])), 32) AS s FROM h WHERE depth = 3), k3 AS (SELECT parent_id, list(s ORDER BY sort_order, id) AS k FROM d3 GROUP BY 1),
d2 AS (SELECT h.*, left(sha256(to_json(list_concat([c, h.id], coalesce(k, [])))), 32) AS s FROM h LEFT JOIN k3 ON k3.parent_id = h.id WHERE depth = 2), k2 AS (SELECT parent_id, list(s ORDER BY sort_order, id) AS k FROM d2 GROUP BY 1),
d1 AS (SELECT h.*, left(sha256(to_json(list_concat([c, h.id], coalesce(k, [])))), 32) AS s FROM h LEFT JOIN k2 ON k2.parent_id = h.id WHERE depth = 1)
SELECT id, s AS tree_hash FROM d1 UNION ALL SELECT id, s FROM d2 UNION ALL SELECT id, s FROM d3""")  # H15
def tree_objects(spark, sf):
    return V.subtree_hashes(corpus_nodes(spark, sf), with_id=True).select("id", F.col("subtree_hash").alias("tree_hash"))


_SNAPS = f"s AS (SELECT doc_id, snapshot_no AS step, id, left(sha256({_JSON}), 32) AS hash FROM node_snapshots WHERE doc_id IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, snapshot_no, id ORDER BY loaded_at DESC) = 1)"


def _snaps(spark, sf):
    s = table(spark, sf, "node_snapshots").where("doc_id is not null and id is not null")
    last = s.groupBy("doc_id", F.col("snapshot_no").alias("step"), "id").agg(F.max_by(F.struct(*V.CONTENT), "loaded_at").alias("r"))
    return last.select("doc_id", "step", "id", "r.*").select("doc_id", "step", "id", V.content_hash().alias("hash"))


@query("commit_log", f"""WITH {_SNAPS}, f AS (SELECT doc_id, step, count(*) AS k FROM (SELECT doc_id, hash, min(step) AS step FROM s GROUP BY 1, 2) GROUP BY 1, 2), p AS (SELECT doc_id, step, count(*) AS n FROM s GROUP BY 1, 2)
SELECT p.doc_id, p.doc_id || '@' || p.step AS commit_id, p.doc_id || '@' || lag(p.step) OVER w AS parent_id, lead(p.step) OVER w IS NULL AS is_head, n AS n_nodes, coalesce(k, 0) AS n_new
FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.step = p.step WINDOW w AS (PARTITION BY p.doc_id ORDER BY p.step)""")  # K3 K4
def commit_log(spark, sf):
    return L.commit_log(_snaps(spark, sf))


@query("restored", f"""WITH {_SNAPS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY step DESC) AS back FROM s), sp AS (SELECT DISTINCT id AS span_id, nullif(trim(node_id, E' \\t'), '') AS node_id FROM source_spans), k AS (SELECT node_id AS id, count(DISTINCT span_id) AS k FROM sp WHERE node_id IS NOT NULL GROUP BY 1),
b AS (SELECT coalesce(h.doc_id, t.doc_id) AS doc_id, coalesce(h.id, t.id) AS id, h.id AS h, t.id AS t FROM (FROM r WHERE back = 1) h FULL JOIN (FROM r WHERE back = 2) t ON t.doc_id = h.doc_id AND t.id = h.id)
SELECT doc_id, count(t) AS n_restored, count(*) FILTER (t IS NULL) AS n_removed, count(*) FILTER (h IS NULL) AS n_readded, CAST(coalesce(sum(k) FILTER (t IS NOT NULL), 0) AS bigint) AS n_spans FROM b LEFT JOIN k ON k.id = b.id GROUP BY 1 HAVING count(t) > 0""")  # K19
def restored(spark, sf):
    """Every document reset to the snapshot before its last."""
    s = _snaps(spark, sf)
    steps = s.select("doc_id", "step").distinct().withColumn("back", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("step"))))
    near = materialize(s.join(steps.where("back <= 2"), ["doc_id", "step"]).select("doc_id", "id", "back"), "near")
    spans = table(spark, sf, "source_spans").select(F.col("id").alias("span_id"), clean_ref(F.col("node_id")).alias("node_id")).where("node_id is not null")
    return L.restored(near.where("back = 1"), near.where("back = 2"), spans)


_LATER = f"""SELECT id, CASE WHEN {{x}} % 37 = 0 THEN text || '#' ELSE text END AS text, node_title, CASE WHEN {{x}} % 41 = 0 THEN '%' ELSE node_note END AS node_note, node_type, trust_level, parent_id, CASE WHEN {{x}} % 43 = 0 THEN sort_order + 7 ELSE sort_order END AS sort_order, address FROM t0"""
_REVERT = (
    _SIDES.replace("base AS (", "p0 AS (", 1).replace("ours AS (", "t0 AS (", 1).replace("theirs AS (", "unused AS (", 1)
    + f", base AS (SELECT * FROM t0), ours AS ({_LATER.format(x='length(id || text)')}), theirs AS (SELECT * FROM p0)" + _MERGE[len(_SIDES):]
)


@query("reverted", f"""{_REVERT}, bad AS (SELECT DISTINCT split_part(id, ':', 1) AS doc FROM w WHERE conflict_fields <> '')
SELECT w.id, {', '.join(_won(f) for f in V.MERGED)}, CASE WHEN a.sort_order IS NOT NULL AND b.sort_order = a.sort_order AND c.sort_order IS NOT NULL THEN c.sort_order ELSE coalesce(b.sort_order, c.sort_order) END AS sort_order
FROM w LEFT JOIN base a ON a.id = w.id LEFT JOIN ours b ON b.id = w.id LEFT JOIN theirs c ON c.id = w.id WHERE NOT (p = 'deleted') AND split_part(w.id, ':', 1) NOT IN (SELECT doc FROM bad)""")  # K20
def reverted(spark, sf):
    """The edit that made ``ours`` of the corpus undone, after later edits."""
    parent, target, _ = _sides(spark, sf)
    x = F.length(F.concat("id", "text"))
    head = target.withColumns({
        "text": F.when(x % 37 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text")),
        "node_note": F.when(x % 41 == 0, "%").otherwise(F.col("node_note")),
        "sort_order": F.when(x % 43 == 0, F.col("sort_order") + 7).otherwise(F.col("sort_order")),
    })
    return L.reverted(target, head, parent, F.split("id", ":")[0])


@query("merge_plans", """WITH c AS (SELECT o_custkey, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders), f AS (SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN -1 ELSE id END AS fork, r FROM c WHERE r = 1 + o_custkey % 3)
SELECT o_custkey AS branch, CASE WHEN fork = -1 THEN 'no-base' WHEN r = 1 THEN 'fast-forward' ELSE 'three-way' END AS plan, nullif(fork, -1) AS base, CASE WHEN fork <> -1 THEN r - 1 END AS behind FROM f""")  # K11
def merge_plans(spark, sf):
    c = materialize(_commits(spark, sf).join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("trunk")), "id"), "commits")
    heads = c.where("r = 1").select("trunk", F.col("id").alias("head"))
    fork = F.when(F.col("trunk") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("id"))
    branches = c.where("r = 1 + trunk % 3").select(F.col("trunk").alias("branch"), "trunk", fork.alias("fork"))
    return L.merge_plans(branches, heads, V.chain(c.select("id", "parent_id"), heads.select(F.col("head").alias("id"))))


_CHANGED = ", ".join(f"b.{f} IS DISTINCT FROM a.{f}" for f in ("address", *V.CONTENT)).replace(", ", " OR ")


@query("branch_commit", f"""{_SIDES}, o AS (SELECT * REPLACE (CASE WHEN length(id) % 5 = 0 THEN 'x' ELSE trust_level END AS trust_level) FROM ours)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deleted' ELSE 'touched' END AS effect, b.id IS NOT NULL AND b.text IS DISTINCT FROM a.text AS stale, a.id IS NOT NULL AND b.id IS NOT NULL AND a.trust_level IS DISTINCT FROM b.trust_level AS refused
FROM base a FULL JOIN o b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR {_CHANGED}""")  # K14
def branch_commit(spark, sf):
    base, ours, _ = _sides(spark, sf)
    return L.branch_commit(base, ours.withColumn("trust_level", F.when(F.length("id") % 5 == 0, "x").otherwise(F.col("trust_level"))))


@query("append_pushes", """, l AS (SELECT parent_id, max(sort_order) AS last FROM n GROUP BY 1), p AS (SELECT user_id || ':1' AS parent_id, event_id AS seq, event_type AS text FROM events)
SELECT p.parent_id, seq, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY p.parent_id ORDER BY seq) AS int) AS sort_order, n.address || '-' || (coalesce(last, 0) + row_number() OVER (PARTITION BY p.parent_id ORDER BY seq)) AS address, p.text FROM p JOIN n ON n.id = p.parent_id LEFT JOIN l ON l.parent_id = p.parent_id""")  # M1 M2
def append_pushes(spark, sf):
    """Events pushed as nodes below the root of the document with their user's number."""
    nodes = corpus_nodes(spark, sf)
    pushes = table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.lit("1")).alias("parent_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    return L.placed_appends(pushes, nodes, nodes.select("parent_id", "sort_order"))


@query("keyword_upkeep", f"{_SIDES} SELECT DISTINCT id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM ours")  # M8
def keyword_upkeep(spark, sf):
    """The index of the base brought up to ``ours`` by the touched and deleted nodes only: equal to one built anew."""
    base, ours, _ = _sides(spark, sf)
    effects = materialize(L.branch_commit(base, ours), "effects")
    touched = ours.select("id", "text").join(effects.where("effect <> 'deleted'").select("id"), "id", "left_semi")
    return L.maintained(L.word_rows(base), touched, effects.where("effect = 'deleted'").select("id"))


@query("index_integrity", f"{_SIDES} SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'orphan' ELSE 'drift' END AS state FROM base a FULL JOIN theirs b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.text IS DISTINCT FROM b.text")  # M6 M7
def index_integrity(spark, sf):
    base, _, theirs = _sides(spark, sf)
    return L.integrity(base, theirs)


_TOKENS = "[A-Za-z]+|[0-9]|[^A-Za-z0-9 \\t-\\r]"


@query("token_budget", f", c AS (SELECT id, len(regexp_extract_all(text, '{_TOKENS}')) AS n_tokens FROM n WHERE {body_sql('text')} > 0) SELECT id, CAST(n_tokens AS int) AS n_tokens, n_tokens > 64 AS skipped FROM c".replace("\\\\", "\\"))  # H30
def token_budget(spark, sf):
    """Tokens of a simple public rule (words, single digits, single other characters); any token column can take its place."""
    from treeline.sources.corpus import filled

    rows = corpus_nodes(spark, sf).where(filled(F.col("text"))).select("id", "text")
    return L.within_budget(rows, F.regexp_count("text", F.lit(_TOKENS.replace("\\\\", "\\"))), 64).drop("text")


@query("search_modes", "WITH m AS (SELECT DISTINCT event_type AS m FROM events UNION ALL SELECT unnest(['node', ' NodeAnd', 'STRICT', 'Or ', '', 'and'])) SELECT m, CASE WHEN lower(trim(m)) IN ('node', 'nodeand', 'strict') THEN 'node' WHEN lower(trim(m)) = 'or' THEN 'or' ELSE 'doc' END AS mode FROM m")  # I2
def search_modes(spark, sf):
    given = spark.createDataFrame([(x,) for x in ("node", " NodeAnd", "STRICT", "Or ", "", "and")], "m string")
    return table(spark, sf, "events").select(F.col("event_type").alias("m")).distinct().unionByName(given).select("m", L.search_mode(F.col("m")).alias("mode"))


@query("live_snapshot", f"WITH {_LIVE} SELECT doc_id, count(*) AS n_nodes, count(DISTINCT parent_id) AS n_parents FROM ln GROUP BY 1")  # K6
def live_snapshot(spark, sf):
    live = live_rows(table(spark, sf, "nodes"), table(spark, sf, "deletions"), "node", ["doc_id", "parent_id"])
    return live.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct(clean_ref(F.col("parent_id"))).alias("n_parents"))


@query("pending_branches", "WITH b AS (SELECT o_custkey AS doc, o_orderkey AS branch FROM orders WHERE o_orderstatus = 'O') SELECT doc, count(*) AS n_pending, min(branch) AS oldest FROM b GROUP BY 1")  # K26
def pending_branches(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("doc")).agg(F.count(F.lit(1)).alias("n_pending"), F.min("o_orderkey").alias("oldest"))


@query("sibling_context", f""", x AS (SELECT doc_id, text, {_KEY} AS key, depth, unnest(list_transform(generate_series(1, depth), lambda q: array_to_string(string_split(address, '-')[1:q], '-'))) AS top FROM n WHERE {body_sql('text')} > 0),
st AS (SELECT doc_id, top AS address, string_agg(text, chr(10) ORDER BY key) AS body FROM x GROUP BY 1, 2), o AS (SELECT n.id, n.doc_id, n.parent_id, n.sort_order, coalesce(body, '') AS body FROM n LEFT JOIN st ON st.doc_id = n.doc_id AND st.address = n.address),
p AS (SELECT id, body, lag(body) OVER w AS pb, lead(body) OVER w AS nb FROM o WINDOW w AS (PARTITION BY doc_id, parent_id ORDER BY sort_order, id))
SELECT id, left(pb, 100) AS previous, left(body, 400) AS body, left(nb, 100) AS next, CAST(length(body) > 400 AS int) + coalesce(CAST(length(pb) > 100 AS int), 0) + coalesce(CAST(length(nb) > 100 AS int), 0) AS n_cut FROM p""")  # J15
def sibling_context(spark, sf):
    from treeline.functions.columns import address_key
    from treeline.operators.tree import ancestor_addresses
    from treeline.sources.corpus import filled

    nodes = corpus_nodes(spark, sf)
    up = nodes.where(filled(F.col("text"))).select("doc_id", "text", address_key(F.col("address")).alias("key"), F.explode(ancestor_addresses(F.col("address"))).alias("address"))
    body = up.groupBy("doc_id", "address").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "text"))), lambda x: x["text"]), "\n").alias("body"))
    texts = nodes.select("doc_id", "address", "id").join(body, ["doc_id", "address"]).select("id", "body")
    return L.sibling_context(nodes, texts, 400)


@query("node_anchors", """WITH c AS (SELECT id, doc_id, address, source_position, try_cast(replace(replace(trim(updated_at), 'T', ' '), 'Z', '') AS timestamp) AS u, loaded_at FROM nodes WHERE id IS NOT NULL AND trim(id) <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY u DESC NULLS LAST, loaded_at DESC NULLS LAST) = 1),
v AS (SELECT * FROM c WHERE doc_id IS NOT NULL AND address IS NOT NULL), sp AS (SELECT DISTINCT id AS span_id, doc_id, nullif(trim(node_id, E' \\t'), '') AS node_id, sentence_index, start_offset FROM source_spans),
o AS (SELECT doc_id, node_id AS id, min(start_offset) AS own FROM sp WHERE node_id IS NOT NULL GROUP BY 1, 2), a AS (SELECT v.*, own, floor(source_position) AS want FROM v LEFT JOIN o USING (doc_id, id)),
ne AS (SELECT a.id, arg_min(start_offset, (sentence_index, span_id)) AS near FROM a JOIN sp ON sp.doc_id = a.doc_id AND sp.sentence_index >= a.want AND sp.start_offset IS NOT NULL WHERE own IS NULL AND want IS NOT NULL GROUP BY 1),
be AS (SELECT a.id, min(d.own) AS below FROM a JOIN a d ON d.doc_id = a.doc_id AND d.own IS NOT NULL AND (d.address = a.address OR starts_with(d.address, a.address || '-')) GROUP BY 1)
SELECT a.id, coalesce(own, near, below, 0) AS anchor, CASE WHEN own IS NOT NULL THEN 'span' WHEN near IS NOT NULL THEN 'sentence' WHEN below IS NOT NULL THEN 'subtree' ELSE 'none' END AS found_by FROM a LEFT JOIN ne ON ne.id = a.id LEFT JOIN be ON be.id = a.id""")  # J12
def node_anchors(spark, sf):
    nodes = current_rows(table(spark, sf, "nodes"), ["doc_id", "address", "source_position"]).where("doc_id is not null and address is not null")
    spans = table(spark, sf, "source_spans").select(F.col("id").alias("span_id"), "doc_id", clean_ref(F.col("node_id")).alias("node_id"), "sentence_index", "start_offset").distinct()
    return L.node_anchors(nodes, spans)


@query("streamed_isomorphism", ", c AS (SELECT parent_id AS id, count(*) AS k FROM n GROUP BY 1) SELECT doc_id, count(*) AS n, CAST(0 AS bigint) AS differing, CAST(sum(coalesce(k, 0)) AS bigint) AS n_children FROM n LEFT JOIN c ON c.id = n.id GROUP BY 1")  # P8 M1
def streamed_isomorphism(spark, sf):
    """The nodes sent through a stream and appended batch by batch give the same ordered tree as the table they came from."""
    import uuid

    from treeline.operators.tree import child_counts

    nodes = corpus_nodes(spark, sf)
    base = f"{scratch_dir(spark)}/streamed-{uuid.uuid4().hex[:12]}"
    source = materialize(nodes.select("doc_id", "id", "parent_id", "sort_order", "address", "text"), "sent")
    sent = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(source._treeline_path)
    run = sent.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    order = Window.partitionBy("doc_id").orderBy(F.transform(F.split("address", "-"), lambda p: p.cast("int")))

    def sequence(rows, tag):
        counted = child_counts(rows).select("doc_id", F.row_number().over(order).alias("place"), F.struct("child_count", "text").alias(tag))
        return counted

    both = sequence(nodes, "a").join(sequence(spark.read.schema(source.schema).parquet(f"{base}/out"), "b"), ["doc_id", "place"], "full")
    return both.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("differing"), F.sum("b.child_count").alias("n_children")
    )
