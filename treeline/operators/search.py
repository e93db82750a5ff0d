"""Corpus retrieval: exhaustive literal search, BM25 ordering, vectors and entities.

Literal search scans every row once for all terms (expressions of the JVM, no row of text is shuffled); only hits move. Term
lists come from the caller, so they are small by nature; dictionaries that grow (entities) run through one automaton
per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.columns import ascii_lower
from treeline.plans.session import materialize, release


def terms_of(query: str | list[str]) -> list[str]:
    """Terms of a query: split at white space, order kept, repeats dropped (case-sensitive)."""
    parts = query.split() if isinstance(query, str) else [t.strip() for t in query]
    return list(dict.fromkeys(t for t in parts if t))


def haystack() -> Column:
    return F.lower(F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("address", "node_title", "text", "node_note")]))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def overlapping(text: Column, term: str) -> Column:
    """Overlapping occurrences ('aa' in 'aaaa' is 3)."""
    import re

    return F.regexp_count(text, F.lit("(?=" + re.escape(term) + ")"))


def keyword_search(nodes: DataFrame, terms: list[str], mode: str = "doc") -> DataFrame:
    """All matching rows: doc_id, id, address, score (occurrences), row_hits (distinct terms of the row).

    ``doc``: rows with any term, of documents that hold all; ``node``: rows with all terms; ``or``: rows with any.
    """
    keys = list(dict.fromkeys(t.lower() for t in terms))
    hay = nodes.select("doc_id", "id", "address", haystack().alias("h"))
    counted = hay.select("doc_id", "id", "address", *[occurrences(F.col("h"), k).alias(f"c{i}") for i, k in enumerate(keys)])
    score = sum((F.col(f"c{i}") for i in range(1, len(keys))), F.col("c0"))
    present = [(F.col(f"c{i}") > 0).cast("int") for i in range(len(keys))]
    hits = counted.withColumns({"score": score, "row_hits": sum(present[1:], present[0])}).where("score > 0")
    if mode == "node":
        hits = hits.where(F.col("row_hits") == len(keys))
    elif mode == "doc":
        full = hits.groupBy("doc_id").agg(*[F.max(F.col(f"c{i}") > 0).alias(f"m{i}") for i in range(len(keys))])
        for i in range(len(keys)):
            full = full.where(F.col(f"m{i}"))
        hits = hits.join(full.select("doc_id"), "doc_id", "left_semi")
    return hits.select("doc_id", "id", "address", "score", "row_hits")


def or_groups(nodes: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """One group per term, each ranked and cut to ``limit``: term, doc_id, id, score, place."""
    hay = nodes.select("doc_id", "id", haystack().alias("h"))
    pairs = F.filter(F.array(*[F.struct(F.lit(t).alias("term"), occurrences(F.col("h"), t.lower()).alias("score")) for t in terms]), lambda x: x["score"] > 0)
    hits = hay.select("doc_id", "id", F.explode(pairs).alias("x")).select("x.term", "doc_id", "id", "x.score")
    order = Window.partitionBy("term").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def first_of_groups(groups: DataFrame, terms: list[str]) -> DataFrame:
    """Union of the groups in the order of the terms, each id once (its first group wins): id, term."""
    rank = F.array_position(F.array(*[F.lit(t) for t in terms]), F.col("term"))
    order = Window.partitionBy("id").orderBy(rank)
    return groups.withColumn("r", F.row_number().over(order)).where("r = 1").select("id", "term")


def substring_rank(nodes: DataFrame, needle: str, limit: int) -> DataFrame:
    """``substring_hits`` in order of rank, cut to ``limit``."""
    return substring_hits(nodes, needle).orderBy("rank", "depth", "address", "id").limit(limit)


def substring_hits(nodes: DataFrame, needle: str) -> DataFrame:
    """Rows holding the literal (ASCII case ignored): doc_id, id, address, depth, rank (0 exact address, 1 title, 2 text, 3 other)."""
    low = needle.lower()
    fields = [ascii_lower(F.coalesce(c, F.lit(""))) for c in ("address", "node_title", "text", "node_note")]
    hit = fields[0].contains(low)
    for f in fields[1:]:
        hit = hit | f.contains(low)
    rank = F.when(F.col("address") == needle, 0).when(fields[1].contains(low), 1).when(fields[2].contains(low), 2).otherwise(3)
    return nodes.where(hit).select("doc_id", "id", "address", "depth", rank.alias("rank"))


def bm25(nodes: DataFrame, query: str, n: int = 2, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over character n-grams of the lower-case text without white space: id, score. Statistics are those of all rows.

    Only the query's n-grams are counted (in place, by expressions); a row's length is its number of n-grams.
    """
    bare = query.lower().replace(" ", "")
    wanted = sorted({bare[i : i + n] for i in range(max(1, len(bare) - n + 1))})
    t = F.regexp_replace(F.lower("text"), r"\s+", "")
    docs = nodes.where(F.length("text") > 0).select("id", t.alias("t"))
    counts = [(occurrences if len(set(w)) == len(w) else overlapping)(F.col("t"), w).alias(f"t{i}") for i, w in enumerate(wanted)]
    sized = docs.select("id", F.greatest(F.length("t") - (n - 1), F.lit(1)).alias("dl"), *counts)
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(wanted))])
    hit = F.col("t0") > 0
    for i in range(1, len(wanted)):
        hit = hit | (F.col(f"t{i}") > 0)
    joined = sized.where(hit).crossJoin(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(len(wanted)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"t{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.select("id", score.alias("score"))


def vector_top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """Exact nearest neighbours by squared distance: vec_id, distance, score = 1 / (1 + distance)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dist = F.aggregate(F.zip_with("embedding", q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    ranked = vectors.where(F.size("embedding") == len(query)).select("vec_id", dist.alias("distance"))
    return ranked.withColumn("score", 1 / (1 + F.greatest(F.col("distance"), F.lit(0.0)))).orderBy("distance", "vec_id").limit(k)


def normalised(vec: Column) -> Column:
    """Vector of length one; a zero vector stays zero."""
    d = F.transform(vec, lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n > 0, F.transform(d, lambda x: x / n)).otherwise(d)


def cosine(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(normalised(a), normalised(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def entity_hits(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Overlapping occurrences of every entity's literal (case ignored) in every row: entity_id, id, hits.

    One automaton over all literals per worker; it is built from ``entities`` (entity_id, literal), a curated dictionary whose
    size is checked: beyond a million entries the dictionary is applied in slices of that size.
    """
    total = entities.count()
    slices = max(1, -(-total // 1_000_000))
    out = None
    for s in range(slices):
        part = entities.where(F.pmod(F.xxhash64("entity_id"), F.lit(slices)) == s) if slices > 1 else entities
        words = [(r.entity_id, r.literal.strip().lower()) for r in part.select("entity_id", "literal").where("literal is not null").collect()]
        shared = nodes.sparkSession.sparkContext.broadcast([w for w in words if w[1]])

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            by: dict[str, list] = {}
            for e, w in shared.value:
                by.setdefault(w, []).append(e)
            machine = ahocorasick.Automaton()
            for w in by:
                machine.add_word(w, w)
            if by:
                machine.make_automaton()
            for pdf in batches:
                rows = []
                for i, hay in zip(pdf["id"], pdf["h"]):
                    seen: dict[str, int] = {}
                    for _, w in machine.iter(hay) if by and hay else ():
                        seen[w] = seen.get(w, 0) + 1
                    rows += [(e, i, n) for w, n in seen.items() for e in by[w]]
                yield pd.DataFrame(rows, columns=["entity_id", "id", "hits"])

        kinds = f"entity_id {entities.schema['entity_id'].dataType.simpleString()}, id string, hits int"
        found = nodes.select("id", haystack().alias("h")).mapInPandas(run, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def bindings(hits: DataFrame, overrides: DataFrame) -> DataFrame:
    """Literal hits with manual overrides (entity_id, id, status 'bound' or 'ignored'): entity_id, id, hits, source."""
    both = hits.join(overrides, ["entity_id", "id"], "full")
    source = F.when(F.col("status") == "ignored", "ignored").when(F.col("status") == "bound", "manual").otherwise("literal")
    return both.select("entity_id", "id", F.coalesce("hits", F.lit(0)).alias("hits"), source.alias("source"))


def closure(links: DataFrame) -> DataFrame:
    """Connected groups of undirected links (a, b): id, group_id (the least id of the group).

    Each round every id takes the least label around it, the label of every id (its root) takes the least label around any of its
    ids, and labels are replaced by their own labels (pointer jumping), so chains shrink in whatever order their ids are.
    Labels only fall, so it ends: when nothing moves.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x is not null and y is not null and x <> y")
    edges = materialize(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = materialize(edges.select(F.col("x").alias("id")).distinct().withColumn("g", F.col("id")), "label")
    while True:
        around = edges.join(label.select(F.col("id").alias("y"), F.col("g").alias("near")), "y").join(label.select(F.col("id").alias("x"), "g"), "x")
        told = around.select(F.explode(F.array_distinct(F.array("x", "g"))).alias("id"), "near").groupBy("id").agg(F.min("near").alias("near"))
        low = label.join(told, "id").select("id", F.least("g", "near").alias("g"), F.col("g").alias("old"))
        up = label.select(F.col("id").alias("g"), F.col("g").alias("top"))
        fresh = materialize(low.join(up, "g").select("id", F.least("g", "top").alias("g"), (F.least("g", "top") != F.col("old")).alias("moved")), "label")
        moved = fresh.where("moved").limit(1).count()
        release(label)
        label = fresh.drop("moved")
        label._treeline_path = fresh._treeline_path
        if not moved:
            break
    return label.select("id", F.col("g").alias("group_id"))
