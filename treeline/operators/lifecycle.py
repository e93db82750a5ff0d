"""Life of a document: reads of single nodes, appends, commits, restores, reverts, merges of branches, upkeep of indexes.

All of it works on whole tables of nodes, commits or pushes at once; a single read is the same with a small table of asked rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.operators import versions as V
from treeline.operators.source import next_of
from treeline.operators.tree import ancestor_addresses, child_counts
from treeline.plans.session import materialize


def resolve_addresses(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Nodes of the asked (doc_id, address): doc_id, address, id, child_count; addresses that are none or lead nowhere have no row.

    The stored address decides; where none is stored (null in ``nodes``), the ordinals are walked from the root, by place among
    siblings. Blanks around an asked address do not count.
    """
    good = asked.select("doc_id", F.trim("address").alias("address")).where(F.col("address").rlike("^[1-9][0-9]*(-[1-9][0-9]*)*$")).distinct()
    stored = good.join(nodes.select("doc_id", "address", "id"), ["doc_id", "address"])
    rest = good.join(stored.select("doc_id", "address"), ["doc_id", "address"], "left_anti")
    order = Window.partitionBy("doc_id", "parent_id").orderBy(F.col("sort_order").asc_nulls_last(), "id")
    places = nodes.select("doc_id", F.coalesce("parent_id", F.lit("")).alias("at"), "id", F.row_number().over(order).alias("place"))
    at = materialize(rest.select("doc_id", "address", F.split("address", "-").alias("p"), F.lit("").alias("at")), "walk")
    deepest = at.agg(F.max(F.size("p"))).first()[0] or 0
    for k in range(deepest):  # one join per address step, all asked at once
        here = at.where(F.size("p") > k).withColumn("place", F.col("p")[k].cast("int"))
        stepped = here.join(places, ["doc_id", "at", "place"]).select("doc_id", "address", "p", F.col("id").alias("at"))
        at = at.where(F.size("p") <= k).unionByName(stepped)
    found = stored.unionByName(at.where("at <> ''").select("doc_id", "address", F.col("at").alias("id")))
    return found.join(child_counts(nodes).select("id", "child_count"), "id").select("doc_id", "address", "id", "child_count")


def has_depth(nodes: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """Whether a document has a node at ``depth``: doc_id, present. Documents without nodes have none."""
    deep = nodes.where(F.col("depth") == depth).select("doc_id").distinct().withColumn("present", F.lit(True))
    return docs.select("doc_id").join(deep, "doc_id", "left").select("doc_id", F.coalesce("present", F.lit(False)).alias("present"))


def placed_appends(pushes: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """Ordinals and addresses of pushes (parent_id, seq, text) behind the children stored already (parent_id, sort_order):
    parent_id, seq, sort_order, address, text. Pushes to parents that are not in ``parents`` (id, address) are left out."""
    last = children.where("parent_id is not null").groupBy("parent_id").agg(F.max("sort_order").alias("last"))
    nth = F.row_number().over(Window.partitionBy("parent_id").orderBy("seq"))
    met = pushes.join(parents.select(F.col("id").alias("parent_id"), F.col("address").alias("above")), "parent_id").join(last, "parent_id", "left")
    order = F.coalesce("last", F.lit(0)) + nth
    return met.select("parent_id", "seq", order.alias("sort_order"), F.concat_ws("-", "above", order.cast("string")).alias("address"), "text")


def commit_log(rows: DataFrame) -> DataFrame:
    """Commits of full snapshots (doc_id, step, id, hash): doc_id, commit_id, parent_id, is_head, n_nodes, n_new (objects that no
    earlier commit of the document has: only these are written)."""
    first = rows.groupBy("doc_id", "hash").agg(F.min("step").alias("step")).groupBy("doc_id", "step").agg(F.count(F.lit(1)).alias("n_new"))
    per = rows.groupBy("doc_id", "step").agg(F.count(F.lit(1)).alias("n_nodes")).join(first, ["doc_id", "step"], "left")
    along = Window.partitionBy("doc_id").orderBy("step")

    def name(step: Column) -> Column:
        return F.when(step.isNotNull(), F.concat_ws("@", "doc_id", step.cast("string")))

    return per.select(
        "doc_id", name(F.col("step")).alias("commit_id"), name(F.lag("step").over(along)).alias("parent_id"),
        F.lead("step").over(along).isNull().alias("is_head"), "n_nodes", F.coalesce("n_new", F.lit(0)).alias("n_new"),
    )


def restored(head: DataFrame, target: DataFrame, spans: DataFrame) -> DataFrame:
    """What a reset of each document to ``target`` does (both doc_id, id): doc_id, n_restored, n_removed, n_readded, n_spans
    (links of spans (id, node_id) that survive, as their node does)."""
    both = head.select("doc_id", "id", F.lit(1).alias("h")).join(target.select("doc_id", "id", F.lit(1).alias("t")), ["doc_id", "id"], "full")
    per = spans.groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("span_id").alias("k"))
    return both.join(per, "id", "left").groupBy("doc_id").agg(
        F.count("t").alias("n_restored"), F.sum((F.col("t").isNull()).cast("long")).alias("n_removed"),
        F.sum((F.col("h").isNull()).cast("long")).alias("n_readded"), F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("k"))), F.lit(0)).alias("n_spans"),
    ).where("n_restored > 0")


def reverted(target: DataFrame, head: DataFrame, parent: DataFrame, doc_of: Column) -> DataFrame:
    """Documents after undoing the commit ``target`` (whose parent is ``parent``) on ``head``: merged rows with sort_order, a
    three-way merge with base = target and theirs = parent. A document with any conflict is blocked and has no rows."""
    verdict = materialize(V.three_way(target, head, parent), "verdict")
    blocked = verdict.where("resolution = 'conflict'").select(doc_of.alias("doc")).distinct()
    rows = V.merged_rows(target, head, parent).withColumn("doc", doc_of).join(blocked, "doc", "left_anti")
    b, o, t = (x.select("id", F.col("sort_order").alias(n)) for x, n in ((target, "b"), (head, "o"), (parent, "t")))
    placed = rows.join(b, "id", "left").join(o, "id", "left").join(t, "id", "left")
    # a place that only the undone commit changed goes back; one changed since stays
    order = F.when(F.col("b").isNotNull() & F.col("o").isNotNull() & F.col("t").isNotNull() & (F.col("o") == F.col("b")), F.col("t")).otherwise(F.coalesce("o", "t"))
    return placed.select("id", *V.MERGED, order.alias("sort_order"))


def merge_plans(branches: DataFrame, heads: DataFrame, ancestry: DataFrame) -> DataFrame:
    """How branches (branch, trunk, fork) go back: branch, plan, base, behind. 'fast-forward' where the trunk's head is still the
    fork, 'three-way' with the fork as merge base where the trunk went on by ``behind`` commits; a fork the trunk does not
    know (or null) has no base: the trunk itself stands in for it, 'no-base'."""
    met = branches.join(heads.select("trunk", "head"), "trunk").join(
        ancestry.select("head", F.col("id").alias("fork"), F.col("distance").alias("behind")), ["head", "fork"], "left"
    )
    plan = F.when(F.col("behind").isNull(), "no-base").when(F.col("behind") == 0, "fast-forward").otherwise("three-way")
    return met.select("branch", plan.alias("plan"), F.when(F.col("behind").isNotNull(), F.col("fork")).alias("base"), "behind")


def branch_commit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Effects of committing a branch: id, effect ('added', 'deleted', 'touched' = address or content changed), stale (its
    text changed, so its vector is out of date), refused (a trust level was changed, which no branch may)."""
    mark = F.struct("address", *V.CONTENT)
    both = before.select("id", mark.alias("a")).join(after.select("id", mark.alias("b")), "id", "full")
    effect = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "touched")
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    stale = F.col("b").isNotNull() & ~F.col("a.text").eqNullSafe(F.col("b.text"))
    refused = here & ~F.col("a.trust_level").eqNullSafe(F.col("b.trust_level"))
    return both.select("id", effect.alias("effect"), stale.alias("stale"), refused.alias("refused")).where("effect is not null")


def word_rows(nodes: DataFrame) -> DataFrame:
    """Keyword rows (id, word): the distinct ASCII words of every text."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    return nodes.select("id", F.explode(words).alias("word"))


def maintained(index: DataFrame, touched: DataFrame, deleted: DataFrame) -> DataFrame:
    """Keyword rows after an edit: those of touched nodes (id, text) replaced, those of deleted ids gone, all others kept."""
    gone = touched.select("id").unionByName(deleted.select("id")).distinct()
    return index.join(gone, "id", "left_anti").unionByName(word_rows(touched))


def integrity(live: DataFrame, index: DataFrame) -> DataFrame:
    """Full scan of an index against its source by text: id, state ('missing', 'orphan', 'drift'); equal rows give none."""
    a, b = live.select("id", F.struct("text").alias("a")), index.select("id", F.struct("text").alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").when(~F.col("a.text").eqNullSafe(F.col("b.text")), "drift")
    return a.join(b, "id", "full").select("id", state.alias("state")).where("state is not null")


def within_budget(rows: DataFrame, tokens: Column, most: int) -> DataFrame:
    """Rows with their token count and whether they are skipped for it: n_tokens, skipped. 0 means no budget."""
    counted = rows.withColumn("n_tokens", tokens)
    return counted.withColumn("skipped", (F.col("n_tokens") > most) if most > 0 else F.lit(False))


def search_mode(mode: Column) -> Column:
    """'node', 'or' or, for anything else, 'doc'."""
    m = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return F.when(m.isin("node", "nodeand", "strict"), "node").when(m == "or", "or").otherwise("doc")


def sibling_context(nodes: DataFrame, texts: DataFrame, limit: int) -> DataFrame:
    """Each node's subtree text (id, body) cut to ``limit``, with those of the siblings beside it cut to a quarter:
    id, previous, body, next, n_cut (how many of the three were cut). Null where there is no such sibling."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("sort_order", "id")
    near = max(1, limit // 4)
    own = nodes.join(texts, "id", "left").withColumn("body", F.coalesce("body", F.lit("")))
    placed = own.select("id", "doc_id", "parent_id", "sort_order", F.struct(F.substring("body", 1, limit).alias("t"), F.substring("body", 1, near).alias("q"), F.length("body").alias("n")).alias("s"))
    seen = placed.select("id", "s", F.lag("s").over(order).alias("p"), F.lead("s").over(order).alias("x"))
    cut = (F.col("s.n") > limit).cast("int") + F.coalesce((F.col("p.n") > near).cast("int"), F.lit(0)) + F.coalesce((F.col("x.n") > near).cast("int"), F.lit(0))
    return seen.select("id", F.col("p.q").alias("previous"), F.col("s.t").alias("body"), F.col("x.q").alias("next"), cut.alias("n_cut"))


def node_anchors(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """Where in its source a node begins: id, anchor, found_by. Its own first span; else the first span at or behind its
    ``source_position`` (sentence_index, then id); else the first span below it; else 0 ('none')."""
    own = spans.where("node_id is not null").groupBy("doc_id", F.col("node_id").alias("id")).agg(F.min("start_offset").alias("own"))
    at = nodes.select("doc_id", "id", "address", F.floor("source_position").cast("long").alias("want")).join(own, ["doc_id", "id"], "left")
    ask = at.where("own is null and want is not null").select("doc_id", "id", F.col("want").alias("at"))
    give = spans.where("sentence_index is not null and start_offset is not null").groupBy("doc_id", F.col("sentence_index").cast("long").alias("at")).agg(F.min_by("start_offset", "span_id").alias("value"))
    near = ask.join(next_of(ask.select("doc_id", "at").distinct(), give), ["doc_id", "at"]).select("doc_id", "id", F.col("value").alias("near"))
    up = at.where("own is not null").select("doc_id", "own", F.explode(ancestor_addresses(F.col("address"))).alias("address"))
    below = up.groupBy("doc_id", "address").agg(F.min("own").alias("below"))
    full = at.join(near, ["doc_id", "id"], "left").join(below, ["doc_id", "address"], "left")
    how = F.when(F.col("own").isNotNull(), "span").when(F.col("near").isNotNull(), "sentence").when(F.col("below").isNotNull(), "subtree").otherwise("none")
    return full.select("id", F.coalesce("own", "near", "below", F.lit(0)).alias("anchor"), how.alias("found_by"))
