"""Queries of sources, op-logs, streams and maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeline.functions.columns import clean_ref
from treeline.functions.split import span_rows
from treeline.operators import oplog, source as P
from treeline.operators.live import live_rows
from treeline.plans.session import table
from treeline.sources.corpus import CORPUS_SQL, corpus_docs, corpus_nodes
from treeline.streaming import volumes as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {CORPUS_SQL} {sql}"
        return f

    return add


@query("chunks", """, s AS (SELECT doc_id, source_text, unnest(generate_series(0, greatest(0, CAST(ceil((length(source_text) - 512) / 461.0) AS int)))) AS chunk_no FROM dc WHERE length(source_text) > 0)
SELECT doc_id, CAST(chunk_no AS int) AS chunk_no, CAST(chunk_no * 461 AS int) AS start_offset, substr(source_text, chunk_no * 461 + 1, 512) AS text FROM s""")  # A21
def chunks(spark, sf):
    return P.chunks(corpus_docs(spark, sf))


@query("rule_sentences")  # H1 H2 A5 A8 E10
def rule_sentences(spark, sf):
    return span_rows(corpus_docs(spark, sf), "doc_id", "source_text", ascii_marks=True, hard_breaks=True)


_SPANS = "WITH s AS (SELECT DISTINCT id, doc_id, nullif(trim(node_id, E' \\t'), '') AS node_id, sentence_index, start_offset, end_offset FROM source_spans)"


def _spans(spark, sf):
    return table(spark, sf, "source_spans").select("id", "doc_id", clean_ref(F.col("node_id")).alias("node_id"), "sentence_index", "start_offset", "end_offset").distinct()


@query("span_overlap", f"{_SPANS}, w AS (SELECT doc_id, id AS window_id, start_offset - 40 AS lo, end_offset + 40 AS hi FROM s WHERE id % 50 = 0) SELECT window_id, s.id FROM w JOIN s ON s.doc_id = w.doc_id AND s.end_offset > greatest(w.lo, 0) AND s.start_offset < w.hi AND s.end_offset > s.start_offset WHERE hi > greatest(lo, 0)")  # C10 C11
def span_overlap(spark, sf):
    s = _spans(spark, sf)
    w = s.where("id % 50 = 0").select("doc_id", F.col("id").alias("window_id"), F.greatest(F.col("start_offset") - 40, F.lit(0)).alias("lo"), (F.col("end_offset") + 40).alias("hi"))
    return P.overlaps(s, w)


@query("chars_in_spans", f"{_SPANS}, p AS (SELECT DISTINCT doc_id, start_offset + 3 AS pos FROM s) SELECT p.doc_id, pos, s.id FROM p JOIN s ON s.doc_id = p.doc_id AND pos >= start_offset AND pos < end_offset")  # C12
def chars_in_spans(spark, sf):
    s = _spans(spark, sf)
    return P.points_in_spans(s.select("doc_id", (F.col("start_offset") + 3).alias("pos")).distinct(), s)


@query("asof_span", f"{_SPANS}, a AS (SELECT DISTINCT doc_id, sentence_index * 3 AS at_index FROM s WHERE sentence_index IS NOT NULL), m AS (SELECT doc_id, sentence_index, min(start_offset) AS start_offset FROM s GROUP BY 1, 2) SELECT a.doc_id, at_index AS \"at\", (SELECT arg_min(start_offset, sentence_index) FROM m WHERE m.doc_id = a.doc_id AND sentence_index >= at_index) AS start_offset FROM a")  # C13
def asof_span(spark, sf):
    s = _spans(spark, sf)
    return P.next_span(s.where("sentence_index is not null").select("doc_id", (F.col("sentence_index") * 3).alias("at")).distinct(), s)


@query("node_first_span", f"{_SPANS} SELECT node_id, min(start_offset) AS start_offset, count(*) AS n FROM s WHERE node_id IS NOT NULL GROUP BY 1")  # C15
def node_first_span(spark, sf):
    return _spans(spark, sf).where("node_id is not null").groupBy("node_id").agg(F.min("start_offset").alias("start_offset"), F.count(F.lit(1)).alias("n"))


@query("sentence_runs", f"""{_SPANS}, o AS (SELECT DISTINCT node_id, sentence_index FROM s WHERE node_id IS NOT NULL AND sentence_index IS NOT NULL),
g AS (SELECT node_id, sentence_index, sentence_index - row_number() OVER (PARTITION BY node_id ORDER BY sentence_index) AS k FROM o), r AS (SELECT node_id, min(sentence_index) AS lo, max(sentence_index) AS hi FROM g GROUP BY node_id, k)
SELECT node_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS varchar) ELSE lo || '-' || hi END, ';' ORDER BY lo) AS runs FROM r GROUP BY 1""")  # D15 D16
def sentence_runs(spark, sf):
    return P.run_labels(_spans(spark, sf).where("node_id is not null"), "node_id", "sentence_index")


_MERGED = f"""{_SPANS}, f AS (SELECT doc_id, start_offset, end_offset, max(end_offset) OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, id FROM s WHERE end_offset > start_offset),
i AS (SELECT *, sum(CAST(reach IS NULL OR start_offset > reach AS int)) OVER (PARTITION BY doc_id ORDER BY start_offset, end_offset, id) AS k FROM f), r AS (SELECT doc_id, min(start_offset) AS lo, max(end_offset) AS hi FROM i GROUP BY doc_id, k)"""


@query("merged_ranges", f"{_MERGED} SELECT doc_id, lo, hi FROM r")  # D23
def merged_ranges(spark, sf):
    return P.merged_ranges(_spans(spark, sf), "doc_id")


@query("coverage_gaps", f"{_MERGED}, l AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS b FROM r) SELECT doc_id, a AS lo, b AS hi FROM l WHERE b > a")  # E13
def coverage_gaps(spark, sf):
    return P.gaps(_spans(spark, sf), "doc_id")


@query("line_boxes", """WITH c AS (SELECT l_orderkey AS key, l_linenumber AS pos, l_linenumber * 10.0 AS x0, floor(l_linenumber / 3) * 20.0 + l_tax AS y0, l_linenumber * 10.0 + 9 AS x1, floor(l_linenumber / 3) * 20.0 + 10 + l_tax AS y1 FROM (SELECT l_orderkey, l_linenumber, min(l_tax) AS l_tax FROM lineitem GROUP BY ALL)),
b AS (SELECT *, coalesce(CAST(abs((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER w) > greatest(y1 - y0, lag(y1 - y0) OVER w) * 0.5 AS int), 0) AS brk FROM c WINDOW w AS (PARTITION BY key ORDER BY pos)),
l AS (SELECT *, sum(brk) OVER (PARTITION BY key ORDER BY pos) AS line FROM b) SELECT key, CAST(line AS bigint) AS line, CAST(min(x0) AS double) AS x0, CAST(min(y0) AS double) AS y0, CAST(max(x1) AS double) AS x1, CAST(max(y1) AS double) AS y1 FROM l GROUP BY key, line""")  # D22
def line_boxes(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("pos")).agg(F.min("l_tax").alias("t"))
    row = F.floor(F.col("pos") / 3) * 20.0
    return P.line_boxes(c.select("key", "pos", (F.col("pos") * 10.0).alias("x0"), (row + F.col("t")).alias("y0"), (F.col("pos") * 10.0 + 9).alias("x1"), (row + 10 + F.col("t")).alias("y1")))


@query("source_windows", """, s AS (SELECT doc_id, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY i, j) - length(text) - 1 AS start_offset, length(text) AS n FROM ln), a AS (SELECT doc_id, source_text, length(source_text) AS n, least(length(source_text), doc_id % 900) AS at_pos FROM dc),
w AS (SELECT doc_id, source_text, greatest(0, at_pos - 200) AS ws, least(n, at_pos + 1000 - (at_pos - greatest(0, at_pos - 200))) AS we FROM a)
SELECT doc_id, CAST(ws AS bigint) AS window_start, CAST(we AS bigint) AS window_end, substr(source_text, ws + 1, we - ws) AS text, (SELECT count(*) FROM s WHERE s.doc_id = w.doc_id AND start_offset + s.n > ws AND start_offset < we) AS n_spans FROM w""")  # J12 J13
def source_windows(spark, sf):
    from pyspark.sql.window import Window

    from treeline.sources.corpus import filled

    docs = corpus_docs(spark, sf)
    lines = docs.select("doc_id", F.posexplode(F.filter(F.split("source_text", "\n\n"), filled)).alias("i", "p")).select("doc_id", "i", F.posexplode(F.filter(F.split("p", "\n"), filled)).alias("j", "text"))
    so_far = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("i", "j"))
    spans = lines.select("doc_id", (so_far - F.length("text") - 1).alias("start_offset"), (so_far - 1).alias("end_offset"))
    out = P.source_window(docs, spans, docs.select("doc_id", (F.col("doc_id") % 900).alias("anchor")), 1000)
    return out.withColumns({"window_start": F.col("window_start").cast("long"), "window_end": F.col("window_end").cast("long")})


@query("live_axiom_refs", None)  # C17
def live_axiom_refs(spark, sf):
    """Axiom references with both ends resolved."""
    dele = table(spark, sf, "deletions")
    nodes = live_rows(table(spark, sf, "nodes"), dele, "node", ["node_title"]).select(F.col("id").alias("node_id"), "node_title")
    axioms = live_rows(table(spark, sf, "axioms"), dele, "axiom", ["label"]).select(F.col("id").alias("axiom_id"), "label")
    refs = table(spark, sf, "axiom_refs").select("id", clean_ref(F.col("node_id")).alias("node_id"), clean_ref(F.col("axiom_id")).alias("axiom_id")).distinct()
    return refs.join(nodes, "node_id", "left").join(axioms, "axiom_id", "left")


ORACLE["live_axiom_refs"] = r"""WITH v AS (SELECT 'node' AS kind, id, node_title AS label, updated_at, loaded_at FROM nodes UNION ALL SELECT 'axiom', id, label, updated_at, NULL FROM axioms),
t AS (SELECT kind, id, label, try_cast(replace(replace(trim(updated_at), 'T', ' '), 'Z', '') AS timestamp) AS u, loaded_at AS l FROM v), latest AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY u DESC NULLS LAST, l DESC NULLS LAST, label DESC) = 1),
g AS (SELECT lower(trim(target_type)) AS kind, trim(target_id, E' \t') AS id, max(deleted_at) AS d FROM deletions GROUP BY ALL), live AS (SELECT latest.* FROM latest LEFT JOIN g USING (kind, id) WHERE d IS NULL OR u > d),
r AS (SELECT DISTINCT id, nullif(trim(node_id, E' \t'), '') AS node_id, nullif(trim(axiom_id, E' \t'), '') AS axiom_id FROM axiom_refs)
SELECT r.id, node_id, axiom_id, n.label AS node_title, a.label FROM r LEFT JOIN live n ON n.kind = 'node' AND n.id = node_id LEFT JOIN live a ON a.kind = 'axiom' AND a.id = axiom_id"""


def _ops(spark, sf):
    n = corpus_nodes(spark, sf).where("depth = 2")
    seq = F.col("doc_id") * 100_000 + F.col("sort_order") * 10
    sid = F.col("doc_id").cast("string")
    def entry(kind, when, body, k):
        return n.where(when).select("doc_id", (seq + k).alias("seq"), F.lit(kind).alias("kind"), F.to_json(body).alias("entry"), F.lit("active").alias("status"))

    at = lambda i: F.concat(sid, F.lit(":1-"), i.cast("string"))
    s = F.col("sort_order")
    return (
        entry("node.update", s % 4 == 0, F.struct(F.col("id").alias("node"), F.struct(F.lit("edited").alias("text")).alias("fields")), 0)
        .unionByName(entry("node.delete", s % 5 == 0, F.struct(F.col("id").alias("node")), 1))
        .unionByName(entry("node.insert", s % 7 == 1, F.struct(F.concat("id", F.lit("n")).alias("node"), F.concat(sid, F.lit(":1")).alias("parent"), F.col("id").alias("after"), F.struct(F.lit("new").alias("text")).alias("fields")), 2))
        .unionByName(entry("node.moveBefore", s % 6 == 3, F.struct(F.col("id").alias("node"), at(s - 1).alias("target")), 3))
        .unionByName(entry("node.mergePrevious", s % 9 == 4, F.struct(F.col("id").alias("node")), 4))
        .unionByName(entry("node.reparent", s % 11 == 7, F.struct(F.col("id").alias("node"), at(s - 1).alias("target")), 5))
        .unionByName(entry("node.split", s % 8 == 2, F.struct(F.col("id").alias("node"), F.array(F.lit("one."), F.lit("two.")).alias("sentences"), F.array(F.concat("id", F.lit("s"))).alias("new_ids")), 6))
        .unionByName(entry("node.promote", s % 13 == 5, F.struct(F.concat("id", F.lit("-1")).alias("node")), 7))
    )


@query("branch_fold")  # L1-L10 K23 J14
def branch_fold(spark, sf):
    return oplog.fold(corpus_nodes(spark, sf), _ops(spark, sf))


@query("branch_fold_updates", """, e AS (SELECT *, depth = 2 AND sort_order % 4 = 0 AS hit, depth = 2 AND sort_order % 5 = 0 AS gone FROM n),
k AS (SELECT * FROM e WHERE NOT gone AND NOT (depth = 3 AND coalesce(try_cast(split_part(address, '-', 2) AS int), 1) % 5 = 0)),
p AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order, id) AS ordinal FROM k),
q AS (SELECT c.*, u.ordinal AS up FROM p c LEFT JOIN p u ON u.id = c.parent_id)
SELECT id, CASE WHEN hit THEN 'edited' ELSE text END AS text, CASE depth WHEN 1 THEN '1' WHEN 2 THEN '1-' || ordinal ELSE '1-' || up || '-' || ordinal END AS address FROM q""")  # L1 L3
def branch_fold_updates(spark, sf):
    ops = _ops(spark, sf).where("kind in ('node.update', 'node.delete')")
    return oplog.fold(corpus_nodes(spark, sf), ops).select("id", "text", "address")


_FOLDED = """, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY key, id) AS ord FROM e),
l1 AS (SELECT id, text, CAST(ord AS varchar) AS address FROM o WHERE parent_id IS NULL), l2 AS (SELECT o.id, o.text, l1.address || '-' || ord AS address FROM o JOIN l1 ON l1.id = o.parent_id),
l3 AS (SELECT o.id, o.text, l2.address || '-' || ord AS address FROM o JOIN l2 ON l2.id = o.parent_id), l4 AS (SELECT o.id, o.text, l3.address || '-' || ord AS address FROM o JOIN l3 ON l3.id = o.parent_id)
SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4"""


def _fold_kind(spark, sf, kind: str):
    return oplog.fold(corpus_nodes(spark, sf), _ops(spark, sf).where(F.col("kind") == kind)).select("id", "text", "address")


@query("fold_inserts", f""", e AS (SELECT doc_id, id, parent_id, sort_order AS key, text FROM n UNION ALL SELECT doc_id, id || 'n', doc_id || ':1', sort_order + 0.5, 'new' FROM n WHERE depth = 2 AND sort_order % 7 = 1){_FOLDED}""")  # L2
def fold_inserts(spark, sf):
    return _fold_kind(spark, sf, "node.insert")


@query("fold_moves", f""", e AS (SELECT doc_id, id, parent_id, CASE WHEN depth = 2 AND sort_order % 6 = 3 THEN sort_order - 1.5 ELSE sort_order END AS key, text FROM n){_FOLDED}""")  # L4
def fold_moves(spark, sf):
    return _fold_kind(spark, sf, "node.moveBefore")


@query("fold_reparents", f""", e AS (SELECT doc_id, id, CASE WHEN depth = 2 AND sort_order % 11 = 7 THEN doc_id || ':1-' || (sort_order - 1) ELSE parent_id END AS parent_id, CASE WHEN depth = 2 AND sort_order % 11 = 7 THEN 1000000 ELSE sort_order END AS key, text FROM n){_FOLDED}""")  # L5
def fold_reparents(spark, sf):
    return _fold_kind(spark, sf, "node.reparent")


@query("fold_promotes", f""", e AS (SELECT c.doc_id, c.id, CASE WHEN u.id IS NOT NULL THEN u.parent_id ELSE c.parent_id END AS parent_id, CASE WHEN u.id IS NOT NULL THEN u.sort_order + 0.5 ELSE c.sort_order END AS key, c.text
FROM n c LEFT JOIN n u ON c.depth = 3 AND c.sort_order = 1 AND u.id = c.parent_id AND u.sort_order % 13 = 5){_FOLDED}""")  # L6
def fold_promotes(spark, sf):
    return _fold_kind(spark, sf, "node.promote")


@query("fold_splits", f""", e AS (SELECT doc_id, id, parent_id, CAST(sort_order AS double) AS key, CASE WHEN depth = 2 AND sort_order % 8 = 2 THEN 'one.' ELSE text END AS text FROM n UNION ALL SELECT doc_id, id || 's', id, 0.0, 'two.' FROM n WHERE depth = 2 AND sort_order % 8 = 2){_FOLDED}""")  # L7
def fold_splits(spark, sf):
    return _fold_kind(spark, sf, "node.split")


_STRIP = "nullif(regexp_replace(regexp_replace({}, '^[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{1C}}-\\x{{1F}}]+', ''), '[\\s\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{1C}}-\\x{{1F}}]+$', ''), '')"


@query("fold_merges", f""", g AS (SELECT a.id AS into_id, b.id AS gone, b.text AS t FROM n b JOIN n a ON a.doc_id = b.doc_id AND a.depth = 2 AND a.sort_order = b.sort_order - 1 WHERE b.depth = 2 AND b.sort_order % 9 = 4),
e AS (SELECT n.doc_id, n.id, coalesce(h.into_id, n.parent_id) AS parent_id, CASE WHEN h.into_id IS NOT NULL THEN 1000000 + n.sort_order ELSE n.sort_order END AS key, CASE WHEN g.into_id IS NOT NULL THEN concat_ws(chr(10) || chr(10), {_STRIP.format('n.text')}, {_STRIP.format('g.t')}) ELSE n.text END AS text
FROM n LEFT JOIN g ON g.into_id = n.id LEFT JOIN g h ON h.gone = n.parent_id WHERE n.id NOT IN (SELECT gone FROM g)){_FOLDED}""")  # L8
def fold_merges(spark, sf):
    return _fold_kind(spark, sf, "node.mergePrevious")


@query("axiom_fold", """WITH a AS (SELECT DISTINCT ON (id) doc_id, id, label, content, status FROM axioms ORDER BY id), t AS (SELECT DISTINCT doc_id FROM a WHERE label = 'A1'), k AS (SELECT a.*, CASE WHEN regexp_full_match(coalesce(label, ''), 'A[0-9]+') THEN CAST(label[2:] AS bigint) ELSE 0 END AS num FROM a WHERE doc_id IN (SELECT doc_id FROM t) AND label IS DISTINCT FROM 'A1')
SELECT doc_id, id, 'A' || row_number() OVER (PARTITION BY doc_id ORDER BY num, id) AS label, content, status FROM k UNION ALL SELECT doc_id, id, label, content, status FROM a WHERE doc_id NOT IN (SELECT doc_id FROM t) OR doc_id IS NULL""")  # L11
def axiom_fold(spark, sf):
    a = table(spark, sf, "axioms").dropDuplicates(["id"])
    gone = a.where("label = 'A1'").select("doc_id", F.lit(1).alias("seq"), F.lit("axiom.delete").alias("kind"), F.to_json(F.struct(F.col("id").alias("axiom"))).alias("entry"))
    return oplog.fold_axioms(a, gone)


@query("session_volumes", """WITH g AS (SELECT *, coalesce(CAST(ts >= lag(ts) OVER w + INTERVAL 24 HOURS AS int), 1) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS last_activity, count(*) AS n FROM i GROUP BY user_id, k""")  # M4 D17
def session_volumes(spark, sf):
    return S.session_volumes(table(spark, sf, "events"))


@query("volume_states", """WITH v AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1), m AS (SELECT max(ts) + INTERVAL 30 HOURS AS now FROM events)
SELECT user_id, CASE WHEN now < last + INTERVAL 24 HOURS THEN 'active' WHEN now >= last + INTERVAL 48 HOURS THEN 'distillable' ELSE 'sealed' END AS state FROM v, m""")  # M4 M13 H24
def volume_states(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg((F.max("ts") + F.expr("INTERVAL 30 HOURS")).alias("now"))
    per = e.groupBy("user_id").agg(F.max("ts").alias("last")).crossJoin(F.broadcast(now))  # one row
    return per.select("user_id", S.volume_state(F.col("last"), F.col("now")).alias("state"))


@query("idempotent_pushes", """WITH p AS (SELECT *, user_id || ':' || event_type AS k FROM events), r AS (SELECT *, lag(ts) OVER (PARTITION BY k ORDER BY ts, event_id) AS last FROM p) SELECT event_id FROM r WHERE last IS NULL OR ts > last + INTERVAL 10 SECONDS""")  # M3 M1
def idempotent_pushes(spark, sf):
    p = table(spark, sf, "events").withColumn("k", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return S.deduplicated_batch(p, "k", "ts", "event_id").select("event_id")


@query("push_contiguity", """, p AS (SELECT doc_id AS batch_id, parent_id AS parent_address, CASE WHEN sort_order % 9 = 0 THEN doc_id || ':' || '1-' || (sort_order + 1) ELSE id END AS address FROM n WHERE depth = 2),
o AS (SELECT *, regexp_replace(address, '-?[0-9]+$', '') AS prefix, try_cast(regexp_extract(address, '([0-9]+)$', 1) AS int) AS ord FROM p), x AS (SELECT *, row_number() OVER (PARTITION BY parent_address ORDER BY batch_id, ord, address) AS expected FROM o)
SELECT batch_id, address, CASE WHEN coalesce(address, '') = '' THEN 'missing' WHEN prefix <> parent_address THEN 'prefix' WHEN ord IS NULL OR ord <= 0 THEN 'number' ELSE 'gap' END AS error FROM x WHERE coalesce(address, '') = '' OR prefix <> parent_address OR ord IS NULL OR ord <= 0 OR ord <> expected""")  # M2
def push_contiguity(spark, sf):
    n = corpus_nodes(spark, sf).where("depth = 2")
    address = F.when(F.col("sort_order") % 9 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(":1-"), (F.col("sort_order") + 1).cast("string"))).otherwise(F.col("id"))
    pushed = n.select(F.col("doc_id").alias("batch_id"), F.col("parent_id").alias("parent_address"), address.alias("address"))
    none = spark.createDataFrame([], "parent_address string, last_order int")
    return S.contiguity_errors(pushed, none)


@query("prune_dead_refs", r"""WITH r AS (SELECT DISTINCT id, nullif(trim(node_id, E' \t'), '') AS n, nullif(trim(axiom_id, E' \t'), '') AS a FROM axiom_refs)
SELECT DISTINCT id FROM r WHERE (n IS NOT NULL AND n NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL)) OR (a IS NOT NULL AND a NOT IN (SELECT id FROM axioms WHERE id IS NOT NULL))""")  # P1 C5
def prune_dead_refs(spark, sf):
    r = table(spark, sf, "axiom_refs").select("id", clean_ref(F.col("node_id")).alias("n"), clean_ref(F.col("axiom_id")).alias("a")).distinct()
    no_node = r.where("n is not null").join(table(spark, sf, "nodes").select(F.col("id").alias("n")).distinct(), "n", "left_anti").select("id")
    no_axiom = r.where("a is not null").join(table(spark, sf, "axioms").select(F.col("id").alias("a")).distinct(), "a", "left_anti").select("id")
    return no_node.unionByName(no_axiom).distinct()


@query("orphan_documents", """WITH k AS (SELECT id FROM docs WHERE id IS NOT NULL), s AS (SELECT doc_id FROM source_spans UNION SELECT doc_id || '-gone' FROM source_spans WHERE sentence_index % 40 = 0) SELECT DISTINCT doc_id FROM s WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT id FROM k)""")  # P2 M14 P5
def orphan_documents(spark, sf):
    """Spans of documents that are gone are planted: every fortieth sentence once more under a document that never was."""
    docs = table(spark, sf, "docs").select(F.col("id").alias("doc_id")).distinct()
    if docs.isEmpty():
        raise RuntimeError("no documents known: nothing is called an orphan")
    spans = table(spark, sf, "source_spans")
    planted = spans.where("sentence_index % 40 = 0").select(F.concat("doc_id", F.lit("-gone")).alias("doc_id"))
    return spans.select("doc_id").unionByName(planted).where("doc_id is not null").distinct().join(docs, "doc_id", "left_anti")


@query("branch_undo", """, e AS (SELECT doc_id, doc_id * 100000 + sort_order * 10 AS seq FROM n WHERE depth = 2 AND sort_order % 4 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS back FROM e)
SELECT doc_id, seq, CASE WHEN back <= 2 THEN 'undone' ELSE 'active' END AS status FROM r""")  # K23
def branch_undo(spark, sf):
    ops = _ops(spark, sf).where("kind = 'node.update'")
    return oplog.undone(ops, 2).select("doc_id", "seq", "status")


@query("node_inspect", f"""{_SPANS}, x AS (SELECT DISTINCT id, nullif(trim(node_id, E' \\t'), '') AS node_id, nullif(trim(axiom_id, E' \\t'), '') AS axiom_id FROM axiom_refs), i AS (SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL)
SELECT i.id, count(DISTINCT s.id) AS n_spans, min(s.start_offset) AS first_offset, count(DISTINCT x.axiom_id) AS n_axioms FROM i LEFT JOIN s ON s.node_id = i.id LEFT JOIN x ON x.node_id = i.id GROUP BY 1""")  # J16
def node_inspect(spark, sf):
    ids = table(spark, sf, "nodes").where("id is not null").select("id").distinct()
    spans = _spans(spark, sf).where("node_id is not null").groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("id").alias("n_spans"), F.min("start_offset").alias("first_offset"))
    axioms = table(spark, sf, "axiom_refs").select(clean_ref(F.col("node_id")).alias("id"), clean_ref(F.col("axiom_id")).alias("a")).where("id is not null").groupBy("id").agg(F.count_distinct("a").alias("n_axioms"))
    met = ids.join(spans, "id", "left").join(axioms, "id", "left")
    return met.select("id", F.coalesce("n_spans", F.lit(0)).alias("n_spans"), "first_offset", F.coalesce("n_axioms", F.lit(0)).alias("n_axioms"))


@query("sentence_containers")  # A23
def sentence_containers(spark, sf):
    """Paragraph nodes of several sentences with one child node per sentence."""
    from pyspark.sql.window import Window

    texts = corpus_nodes(spark, sf).where("depth = 2").select("id", "text")
    cut = span_rows(texts, "id", "text", ascii_marks=True)
    many = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return cut.withColumn("n", many).where("n > 1").select(F.concat_ws("-", "id", F.col("sentence_index").cast("string")).alias("id"), F.col("id").alias("parent_id"), "text")
