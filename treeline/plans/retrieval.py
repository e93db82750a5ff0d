"""Queries of literal search, ranking, vectors and entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators import search as S
from treeline.plans.session import materialize, table
from treeline.sources.corpus import CORPUS_SQL, corpus_docs, corpus_nodes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TERMS = ["glossary", "axiom"]
_HAY = "lower(concat_ws(chr(10), coalesce(address, ''), coalesce(node_title, ''), coalesce(text, ''), coalesce(node_note, '')))"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if sql.lstrip().startswith("WITH") else f"WITH {CORPUS_SQL} {sql}"
        return f

    return add


def _count(hay: str, term: str) -> str:
    return f"CAST((length({hay}) - length(replace({hay}, '{term}', ''))) / {len(term)} AS int)"


_C = f", h AS (SELECT doc_id, id, address, {_HAY} AS h FROM n), c AS (SELECT doc_id, id, address, {_count('h', TERMS[0])} AS a, {_count('h', TERMS[1])} AS b FROM h), s AS (SELECT *, a + b AS score, CAST(a > 0 AS int) + CAST(b > 0 AS int) AS row_hits FROM c WHERE a + b > 0)"


@query("keyword_doc", f"{_C} SELECT doc_id, id, address, score, row_hits FROM s WHERE doc_id IN (SELECT doc_id FROM s GROUP BY 1 HAVING max(a) > 0 AND max(b) > 0)")  # I1 D11 H5 H6
def keyword_doc(spark, sf):
    return S.keyword_search(corpus_nodes(spark, sf), TERMS, "doc")


@query("keyword_node", f"{_C} SELECT doc_id, id, address, score, row_hits FROM s WHERE row_hits = 2")
def keyword_node(spark, sf):
    return S.keyword_search(corpus_nodes(spark, sf), TERMS, "node")


@query("keyword_or", f"{_C} SELECT doc_id, id, address, score, row_hits FROM s")  # A2 I3
def keyword_or(spark, sf):
    return S.keyword_search(corpus_nodes(spark, sf), TERMS, "or")


@query("keyword_or_groups", f"{_C}, g AS (SELECT 'glossary' AS term, doc_id, id, a AS score FROM c WHERE a > 0 UNION ALL SELECT 'axiom', doc_id, id, b FROM c WHERE b > 0), r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, id) AS place FROM g) SELECT term, doc_id, id, score, place FROM r WHERE place <= 50")  # G5
def keyword_or_groups(spark, sf):
    return S.or_groups(corpus_nodes(spark, sf), TERMS, 50).select("term", "doc_id", "id", "score", F.col("place").cast("long").alias("place"))


@query("first_wins_union", f"{_C} SELECT id, CASE WHEN a > 0 THEN 'glossary' ELSE 'axiom' END AS term FROM s")  # E14 G5
def first_wins_union(spark, sf):
    return S.first_of_groups(S.or_groups(corpus_nodes(spark, sf), TERMS, 1 << 30), TERMS)


_ASC = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_IN = {c: f"contains({_ASC.format(c)}, 'archive')" for c in ("address", "node_title", "text", "node_note")}
_RANKED = f", r AS (SELECT doc_id, id, address, depth, CASE WHEN address = 'archive' THEN 0 WHEN {_IN['node_title']} THEN 1 WHEN {_IN['text']} THEN 2 ELSE 3 END AS rank FROM n WHERE {' OR '.join(_IN.values())})"


@query("substring_ranked", f"{_RANKED} SELECT * FROM r ORDER BY rank, depth, address, id LIMIT 100")  # F4 I8
def substring_ranked(spark, sf):
    return S.substring_rank(corpus_nodes(spark, sf), "archive", 100)


@query("substring_cross_doc", f"{_RANKED}, t AS (SELECT r.*, title FROM r JOIN dc USING (doc_id) ORDER BY rank, title, depth, address, id LIMIT 101) SELECT id, t.title, rank FROM t JOIN dc USING (doc_id) WHERE NOT starts_with(coalesce(path, ''), 'ward/')")  # F5 I9
def substring_cross_doc(spark, sf):
    docs = corpus_docs(spark, sf).select("doc_id", "title", "path")
    top = S.substring_hits(corpus_nodes(spark, sf), "archive").join(docs, "doc_id").orderBy("rank", F.col("title").asc_nulls_last(), "depth", "address", "id").limit(101)
    return top.where(~F.coalesce("path", F.lit("")).startswith("ward/")).select("id", "title", "rank")


_GRAM = "list_transform(generate_series(1, length(t) - 1), lambda i: substr(t, i, 2))"
_DF = {g: f"len(list_filter(g, lambda x: x = '{g}'))" for g in sorted({"archive"[i : i + 2] for i in range(6)})}
_BM = f""", t AS (SELECT id, regexp_replace(lower(text), '[\\t-\\r ]+', '', 'g') AS t FROM n WHERE length(text) > 0), g AS (SELECT id, CASE WHEN length(t) >= 2 THEN {_GRAM} ELSE [t] END AS g FROM t),
z AS (SELECT id, len(g) AS dl, {', '.join(f"{e} AS t{i}" for i, e in enumerate(_DF.values()))} FROM g),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f"sum(CAST(t{i} > 0 AS int)) AS df{i}" for i in range(len(_DF)))} FROM z)
SELECT id, round(score, 6) AS score FROM (SELECT id, {' + '.join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(_DF)))} AS score FROM z, st) WHERE score > 0"""


@query("bm25", _BM)  # I4
def bm25(spark, sf):
    return S.bm25(corpus_nodes(spark, sf), "archive").select("id", F.round("score", 6).alias("score"))


@query("keyword_ranked", f"""{_C}, {_BM.lstrip(', ').replace('SELECT id, round(score, 6) AS score FROM', ', bm AS (SELECT id, round(score, 6) AS bm FROM', 1)}),
r AS (SELECT s.id, s.score, row_number() OVER (ORDER BY bm DESC NULLS LAST, row_hits DESC, s.score DESC, address, s.id) AS place FROM s LEFT JOIN bm ON bm.id = s.id)
SELECT id, score, place FROM r WHERE place <= 200""")  # F3 I5 C16
def keyword_ranked(spark, sf):
    nodes = corpus_nodes(spark, sf)
    hits = S.keyword_search(nodes, TERMS, "or").join(S.bm25(nodes, "archive").select("id", F.round("score", 6).alias("bm")), "id", "left")
    order = [F.col("bm").desc_nulls_last(), F.desc("row_hits"), F.desc("score"), F.col("address"), F.col("id")]
    top = hits.orderBy(*order).limit(200)  # the page; its places are counted over these rows alone
    return top.select("id", "score", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


_DIST = "list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda z: (CAST(z[1] AS double) - z[2]) * (CAST(z[1] AS double) - z[2])))"


@query("vector_top_k", f"WITH d AS (SELECT vec_id, {_DIST} AS distance FROM embeddings) SELECT vec_id, round(distance, 9) AS distance, round(1 / (1 + greatest(distance, 0)), 9) AS score FROM d ORDER BY distance, vec_id LIMIT 20")  # I10 F6 H26
def vector_top_k(spark, sf):
    v = table(spark, sf, "embeddings")
    q = v.where("vec_id = 0").first().embedding
    return S.vector_top_k(v, list(q), 20).select("vec_id", F.round("distance", 9).alias("distance"), F.round("score", 9).alias("score"))


@query("cosine_to_label", """WITH m AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS double) * x))) AS norm FROM embeddings),
q AS (SELECT list_transform(embedding, lambda x: CAST(x AS double) / norm) AS q FROM m WHERE vec_id = 0)
SELECT label, count(*) AS n, round(avg(list_sum(list_transform(list_zip(embedding, (SELECT q FROM q)), lambda z: CAST(z[1] AS double) / norm * z[2]))), 6) AS mean_cosine FROM m GROUP BY 1""")  # H25
def cosine_to_label(spark, sf):
    v = table(spark, sf, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 0").first().embedding])
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(S.cosine(F.col("embedding"), q)), 6).alias("mean_cosine"))


@query("score_floor", f"WITH d AS (SELECT vec_id, {_DIST} AS distance FROM embeddings), t AS (SELECT vec_id, 1 / (1 + distance) AS score FROM d ORDER BY distance, vec_id LIMIT 50) SELECT vec_id FROM t WHERE score >= 0.51")  # B16
def score_floor(spark, sf):
    v = table(spark, sf, "embeddings")
    return S.vector_top_k(v, list(v.where("vec_id = 0").first().embedding), 50).where("score >= 0.51").select("vec_id")




def _entities(spark, sf):
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    names = p.select(F.explode(words).alias("w")).select(F.lower("w").alias("literal")).union(spark.createDataFrame([("glossary",), ("archive",), ("axiom",), ("aa",), ("1-1",)], "literal string"))
    return names.where("literal <> ''").distinct().select(F.col("literal").alias("entity_id"), "literal")


_ENTITIES = ", e AS (SELECT DISTINCT w AS literal FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS w FROM part UNION ALL SELECT unnest(['glossary', 'archive', 'axiom', 'aa', '1-1'])) WHERE w <> '')"
_EHITS = f"""{_ENTITIES}, h AS (SELECT id, {_HAY} AS h FROM n), eh AS (SELECT literal AS entity_id, id, CAST(len(list_filter(generate_series(1, length(h)), lambda i: starts_with(substr(h, i, length(literal)), literal))) AS int) AS hits FROM h, e WHERE contains(h, literal))"""


@query("entity_hits", f"{_EHITS} SELECT entity_id, id, hits FROM eh")  # D12 C14 H7
def entity_hits(spark, sf):
    return S.entity_hits(corpus_nodes(spark, sf), _entities(spark, sf))


@query("entity_totals", f"{_EHITS} SELECT entity_id, CAST(sum(hits) AS bigint) AS hits, count(*) AS n_nodes FROM eh GROUP BY 1")  # I13 F11
def entity_totals(spark, sf):
    hits = S.entity_hits(corpus_nodes(spark, sf), _entities(spark, sf))
    return hits.groupBy("entity_id").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("n_nodes"))


@query("entity_bindings", f"""{_EHITS}, o AS (SELECT 'glossary' AS entity_id, id, CASE WHEN doc_id % 2 = 0 THEN 'bound' ELSE 'ignored' END AS status FROM n WHERE depth = 1 OR sort_order = 2)
SELECT coalesce(eh.entity_id, o.entity_id) AS entity_id, coalesce(eh.id, o.id) AS id, coalesce(hits, 0) AS hits, CASE status WHEN 'ignored' THEN 'ignored' WHEN 'bound' THEN 'manual' ELSE 'literal' END AS source
FROM eh FULL JOIN o ON o.entity_id = eh.entity_id AND o.id = eh.id""")  # I17 F12
def entity_bindings(spark, sf):
    nodes = corpus_nodes(spark, sf)
    status = F.when(F.col("doc_id") % 2 == 0, "bound").otherwise("ignored")
    manual = nodes.where("depth = 1 or sort_order = 2").select(F.lit("glossary").alias("entity_id"), "id", status.alias("status"))
    return S.bindings(S.entity_hits(nodes, _entities(spark, sf)), manual)


_LINKS = "l AS (SELECT o_custkey AS a, o_custkey // 3 AS b FROM orders WHERE o_orderkey % 7 <> 0)"


@query("synonym_groups", f"""WITH RECURSIVE {_LINKS}, ed AS (SELECT a AS x, b AS y FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r AS (SELECT x AS id, x AS g FROM ed UNION SELECT ed.y, r.g FROM r JOIN ed ON ed.x = r.id WHERE r.g < ed.y)
SELECT id, min(g) AS group_id FROM (SELECT * FROM r UNION ALL SELECT x, x FROM ed) GROUP BY 1""")  # I16
def synonym_groups(spark, sf):
    links = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_custkey").alias("a"), F.floor(F.col("o_custkey") / 3).cast("long").alias("b"))
    return S.closure(links)


@query("entity_related", f"""WITH RECURSIVE {_LINKS}, ed AS (SELECT a AS x, b AS y FROM l WHERE a <> b AND a < 40 UNION SELECT b, a FROM l WHERE a <> b AND a < 40),
g AS (SELECT 5 AS id UNION SELECT y FROM g JOIN ed ON x = id), rel AS (SELECT a AS x, b AS y FROM (SELECT l_partkey % 50 AS a, l_suppkey % 50 AS b FROM lineitem WHERE l_linenumber = 1) UNION SELECT l_suppkey % 50, l_partkey % 50 FROM lineitem WHERE l_linenumber = 1)
SELECT DISTINCT y AS related_id FROM rel WHERE x IN (SELECT id FROM g) AND y NOT IN (SELECT id FROM g)""")  # I14 I15
def entity_related(spark, sf):
    links = table(spark, sf, "orders").where("o_orderkey % 7 <> 0 and o_custkey < 40").select(F.col("o_custkey").alias("a"), F.floor(F.col("o_custkey") / 3).cast("long").alias("b"))
    pairs = table(spark, sf, "lineitem").where("l_linenumber = 1").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y"))
    return _related(links, pairs, 5)


def _related(links, pairs, seed: int):
    """One hop of ``pairs`` from the synonym group of ``seed``, without the group."""
    groups = materialize(S.closure(links), "groups")
    group = groups.join(groups.where(F.col("id") == seed).select("group_id"), "group_id").select("id").unionByName(groups.sparkSession.range(seed, seed + 1)).distinct()
    pairs = pairs.distinct()
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    hop = both.join(group.withColumnRenamed("id", "x"), "x", "left_semi").select(F.col("y").alias("id")).distinct()
    return hop.join(group, "id", "left_anti").select(F.col("id").alias("related_id"))


def _all_links(spark, sf):
    """Links of all orders: a customer and the one with a third of the key."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), F.floor(F.col("o_custkey") / 3).cast("long").alias("b"))


@query("synonym_groups_all")  # I16
def synonym_groups_all(spark, sf):
    return S.closure(_all_links(spark, sf))


@query("entity_related_all")  # I14 I15
def entity_related_all(spark, sf):
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    return _related(_all_links(spark, sf), pairs, 5)


@query("expanded_find", f"""{_C.replace("AS score, CAST", "AS score, CAST")} SELECT doc_id, id FROM c JOIN n USING (doc_id, id) WHERE (a > 0 OR contains({_HAY.replace('address', 'n.address')}, 'archive')) AND b > 0""")  # I18
def expanded_find(spark, sf):
    nodes = corpus_nodes(spark, sf)
    groups = [["glossary", "archive"], ["axiom"]]
    hits = [S.keyword_search(nodes, g, "or").select("doc_id", "id") for g in groups]
    return hits[0].join(hits[1], ["doc_id", "id"])


@query("vector_upsert", """WITH up AS (SELECT vec_id + 100 AS vec_id, label, vec_id AS seq FROM embeddings UNION ALL SELECT vec_id + 100, label + 1, vec_id + 1000000 FROM embeddings WHERE vec_id % 2 = 0),
last AS (SELECT vec_id, label FROM up QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY seq DESC) = 1)
SELECT vec_id, label FROM last UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM last)""")  # A31 A32 A34
def vector_upsert(spark, sf):
    old = table(spark, sf, "embeddings").select("vec_id", "label")
    new = old.select((F.col("vec_id") + 100).alias("vec_id"), "label", F.col("vec_id").alias("seq"))
    fix = old.where("vec_id % 2 = 0").select((F.col("vec_id") + 100).alias("vec_id"), (F.col("label") + 1).alias("label"), (F.col("vec_id") + 1000000).alias("seq"))
    from treeline.operators.index import upsert

    return upsert(old, new.unionByName(fix), "vec_id", "seq")


@query("index_state", """, v AS (SELECT id, doc_id, updated_at FROM n WHERE doc_id % 4 <> 0 UNION ALL SELECT id || 'x', doc_id, updated_at FROM n WHERE depth = 1), w AS (SELECT id, doc_id, CASE WHEN sort_order = 4 THEN 'later' ELSE updated_at END AS updated_at FROM n)
SELECT coalesce(w.id, v.id) AS id, CASE WHEN v.id IS NULL THEN 'pending' WHEN w.id IS NULL THEN 'orphan' ELSE 'stale' END AS state FROM w FULL JOIN v ON v.id = w.id WHERE v.id IS NULL OR w.id IS NULL OR w.updated_at <> v.updated_at""")  # I6 I7 M6 M7 M9 G4
def index_state(spark, sf):
    from treeline.operators.index import reconcile

    nodes = corpus_nodes(spark, sf)
    index = nodes.where("doc_id % 4 <> 0").select("id", "updated_at").unionByName(nodes.where("depth = 1").select(F.concat("id", F.lit("x")).alias("id"), "updated_at"))
    live = nodes.select("id", F.when(F.col("sort_order") == 4, "later").otherwise(F.col("updated_at")).alias("updated_at"))
    return reconcile(live, index, "updated_at")


@query("vector_coverage", """, t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (doc_id % 4 <> 0 OR depth = 1) AS k FROM n WHERE length(text) > 0 OR depth = 1 GROUP BY 1)
SELECT doc_id, n AS n_nodes, k AS n_indexed, CASE WHEN k = n THEN 'ready' ELSE 'missing' END AS status FROM t""")  # D19 I11 A33
def vector_coverage(spark, sf):
    from treeline.operators.index import coverage

    nodes = corpus_nodes(spark, sf).where("length(text) > 0 or depth = 1")
    return coverage(nodes.select("doc_id", "id"), nodes.where("doc_id % 4 <> 0 or depth = 1").select("id"))
