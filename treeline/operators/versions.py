"""Content hashes, snapshots, diffs, three-way merges and histories as joins.

Identity of content is the five content fields; every comparison pairs rows by id in one full outer join per pair of
versions, and verdicts are column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.plans.session import materialize, release
from treeline.plans.skew import prefix_sums

#: Fields of a node's content, and those a merge decides about.
CONTENT = ("text", "node_title", "node_note", "node_type", "trust_level")
MERGED = (*CONTENT, "parent_id")


def short_hash(value: Column) -> Column:
    """First 32 hex digits of the SHA-256 of a JSON array of strings."""
    return F.substring(F.sha2(F.to_json(value), 256), 1, 32)


def content_hash() -> Column:
    return short_hash(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in CONTENT]))


def subtree_hashes(nodes: DataFrame, with_id: bool = False) -> DataFrame:
    """Merkle hashes: id, content_hash, subtree_hash = H([own, children's subtree hashes in order]); ``with_id``: of tree objects,
    H([own, id, children's ...]), so that nodes of equal content do not collapse into one.

    Levels are folded from the deepest up; each level is one aggregation by parent. Needs materialised ``depth``.
    """
    base = materialize(nodes.select("id", "parent_id", "depth", "sort_order", content_hash().alias("content_hash")), "hashes")
    deepest = base.agg(F.max("depth")).first()[0] or 0
    below, parts = None, []
    for depth in range(deepest, 0, -1):
        level = base.where(F.col("depth") == depth)
        if below is None:
            done = level.withColumn("kids", F.array().cast("array<string>"))
        else:
            kids = below.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", "subtree_hash"))).alias("k"))
            done = level.join(kids, "id", "left").withColumn("kids", F.coalesce(F.transform("k", lambda x: x["subtree_hash"]), F.array().cast("array<string>"))).drop("k")
        hashed = done.withColumn("subtree_hash", short_hash(F.concat(F.array("content_hash", "id") if with_id else F.array("content_hash"), F.col("kids")))).drop("kids")
        below = materialize(hashed, "level")
        parts.append(below.select("id", "content_hash", "subtree_hash"))
    if not parts:
        return base.select("id", "content_hash", F.lit(None).cast("string").alias("subtree_hash"))
    return reduce(DataFrame.unionByName, parts)


def _pair(left: DataFrame, right: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    a = left.select("id", F.struct(*fields).alias("a"))
    b = right.select("id", F.struct(*fields).alias("b"))
    return a.join(b, "id", "full")


def _differs(f: str, a: str = "a", b: str = "b") -> Column:
    return ~F.col(f"{a}.{f}").eqNullSafe(F.col(f"{b}.{f}"))


def field_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries between two snapshots: id, field, old, new. '*' for added and deleted rows (their text), one entry per changed
    content field, and '__moved__' (addresses) when the parent changed, or the order did under an unchanged set of siblings."""
    # sets of siblings are compared by digests that add up, so no parent's children (nor all roots) meet in one place
    digest = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(7))))
    kids_a, kids_b = old.groupBy("parent_id").agg(digest.alias("sa")), new.groupBy("parent_id").agg(digest.alias("sb"))
    key = F.coalesce("parent_id", F.lit("root"))
    same = kids_a.select(key.alias("p"), "sa").join(kids_b.select(key.alias("p"), "sb"), "p").select("p", (F.col("sa") == F.col("sb")).alias("same"))
    both = _pair(old, new, (*MERGED, "sort_order", "address")).withColumn("p", F.coalesce("b.parent_id", F.lit("root"))).join(same, "p", "left")
    gone, came = F.col("b").isNull(), F.col("a").isNull()
    here = ~gone & ~came
    moved = here & (_differs("parent_id") | (_differs("sort_order") & F.coalesce("same", F.lit(False))))

    def entry(when: Column, field: str, a: Column, b: Column) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), a.cast("string").alias("old"), b.cast("string").alias("new")))

    nothing = F.lit(None).cast("string")
    every = F.array(
        entry(came, "*", nothing, F.col("b.text")), entry(gone, "*", F.col("a.text"), nothing),
        *[entry(here & _differs(f), f, F.col(f"a.{f}"), F.col(f"b.{f}")) for f in CONTENT],
        entry(moved, "__moved__", F.col("a.address"), F.col("b.address")),
    )
    return both.select("id", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("e")).select("id", "e.field", "e.old", "e.new")


def _common_rank(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rank among the siblings that the other side has too; very many siblings (as all roots are) are ranked by ranges."""
    common = rows.join(other.select("id"), "id", "left_semi").select("id", F.coalesce("parent_id", F.lit("\0root")).alias("grp"), "sort_order")
    ranked = prefix_sums(common, "grp", [F.col("sort_order").asc(), F.col("id").asc()], {"before": F.lit(1).cast("long")})
    return ranked.select("id", (F.col("before") + 1).alias("rank"))


def tree_diff(base: DataFrame, now: DataFrame) -> DataFrame:
    """Every node of either side: id, status ('unchanged', 'added', 'deleted', 'modified'), changed_fields (a reorder among
    the common siblings counts as 'sort_order')."""
    ranks = _common_rank(base, now).withColumnRenamed("rank", "ra").join(_common_rank(now, base).withColumnRenamed("rank", "rb"), "id")
    both = _pair(base, now, MERGED).join(ranks, "id", "left")
    fields = F.array(*[F.when(_differs(f), F.lit(f)) for f in MERGED])
    reordered = ~_differs("parent_id") & (F.col("ra") != F.col("rb"))
    changed = F.filter(F.concat(fields, F.array(F.when(reordered, F.lit("sort_order")))), lambda x: x.isNotNull())
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    listed = F.when(here, changed).otherwise(F.array().cast("array<string>"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.size(changed) == 0, "unchanged").otherwise("modified")
    return both.select("id", status.alias("status"), F.array_join(listed, ",").alias("changed_fields"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Merge verdict per node: id, resolution ('unchanged', 'ours', 'theirs', 'merged', 'deleted', 'added-ours', 'added-theirs',
    'added-converged', 'conflict'), conflict_fields. A parent that only theirs refers to and ours has deleted is a
    '__parent__' conflict; deleted here and changed there a '__node__' one."""
    joined = _pair(base, ours, MERGED).join(theirs.select("id", F.struct(*MERGED).alias("c")), "id", "full")
    in_base, in_ours, in_theirs = (F.col(x).isNotNull() for x in "abc")
    def any_of(a: str, b: str) -> Column:
        return reduce(lambda x, y: x | y, [_differs(f, a, b) for f in MERGED])

    ours_changed, theirs_changed = any_of("a", "b"), any_of("a", "c")
    clash = F.filter(F.array(*[F.when(_differs(f, "a", "b") & _differs(f, "a", "c") & _differs(f, "b", "c"), F.lit(f)) for f in MERGED]), lambda x: x.isNotNull())
    clash_new = F.filter(F.array(*[F.when(_differs(f, "b", "c"), F.lit(f)) for f in MERGED]), lambda x: x.isNotNull())
    both_new = ~in_base & in_ours & in_theirs
    survivor_changed = F.when(in_ours, ours_changed).otherwise(theirs_changed)
    fields = (
        F.when(both_new, clash_new)
        .when(in_base & (in_ours != in_theirs) & survivor_changed, F.array(F.lit("__node__")))
        .when(in_base & in_ours & in_theirs, clash)
        .otherwise(F.array().cast("array<string>"))
    )
    plain = (
        F.when(both_new, "added-converged").when(~in_base & in_ours, "added-ours").when(~in_base, "added-theirs")
        .when(~in_ours | ~in_theirs, "deleted").when(~ours_changed & ~theirs_changed, "unchanged").when(~ours_changed, "theirs")
        .when(~theirs_changed, "ours").otherwise("merged")
    )
    # parents that the merged result would miss
    parent = F.col("c.parent_id")
    uses_theirs = (~in_base & ~in_ours) | (in_base & in_ours & _differs("parent_id", "a", "c") & ~_differs("parent_id", "a", "b"))
    asked = joined.select("id", "a", "b", "c", F.when(in_theirs & uses_theirs, parent).alias("ref"), fields.alias("fields"), plain.alias("plain"))
    known = ours.select(F.col("id").alias("ref"), F.lit(True).alias("o")).join(theirs.select(F.col("id").alias("ref"), F.lit(True).alias("t")), "ref", "full")
    known = known.join(base.select(F.col("id").alias("ref"), F.lit(True).alias("s")), "ref", "full")
    checked = asked.join(known, "ref", "left")
    missing = F.col("ref").isNotNull() & F.col("o").isNull() & ~(F.col("s").isNull() & F.coalesce("t", F.lit(False)))
    every = F.when(missing, F.concat("fields", F.array(F.lit("__parent__")))).otherwise(F.col("fields"))
    return checked.select("id", F.when(F.size(every) > 0, "conflict").otherwise(F.col("plain")).alias("resolution"), F.array_join(every, ",").alias("conflict_fields"))


def merged_rows(base: DataFrame, ours: DataFrame, theirs: DataFrame, prefer: str = "ours") -> DataFrame:
    """Rows of the merge: id and the merged fields; conflicts are decided for ``prefer``, whole deletions included."""
    verdict = three_way(base, ours, theirs)
    joined = _pair(base, ours, MERGED).join(theirs.select("id", F.struct(*MERGED).alias("c")), "id", "full").join(verdict, "id")
    win = "b" if prefer == "ours" else "c"
    def value(f: str) -> Column:
        a, b, c = (F.col(f"{x}.{f}") for x in "abc")
        return (
            F.when(F.col("c").isNull(), b).when(F.col("b").isNull(), c).when(b.eqNullSafe(c), b)
            .when(F.col("a").isNotNull() & a.eqNullSafe(b), c).when(F.col("a").isNotNull() & a.eqNullSafe(c), b).otherwise(F.col(f"{win}.{f}"))
        )
    gone = (F.col("resolution") == "deleted") | (F.col("conflict_fields").startswith("__node__") & F.col(win).isNull())
    return joined.where(~gone).select("id", *[value(f).alias(f) for f in MERGED])


def chain(links: DataFrame, heads: DataFrame) -> DataFrame:
    """Ancestry of commits: (head, id, distance) for every head, following (id, parent_id); distances double per round.

    A circle of commits is an error."""
    n = links.count()
    jump = materialize(links.select("id", F.col("parent_id").alias("to")).where("to is not null"), "jump")
    reach = materialize(heads.select(F.col("id").alias("head"), "id", F.lit(0).cast("long").alias("distance")), "reach")
    k = 0
    while not jump.isEmpty():
        if 1 << k > n:
            raise RuntimeError("commits form a circle")
        step = reach.join(jump, "id").select("head", F.col("to").alias("id"), (F.col("distance") + (1 << k)).alias("distance"))
        fresh = materialize(reach.unionByName(step), "reach")
        far = jump.select("id", F.col("to").alias("mid")).join(jump.select(F.col("id").alias("mid"), "to"), "mid").select("id", "to")
        further = materialize(far, "jump")
        release(jump, reach)
        jump, reach, k = further, fresh, k + 1
    return reach


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Hashes reachable from ``roots`` (hash) over ``edges`` (parent, child): mark phase of the sweep."""
    seen = materialize(roots.select("hash").distinct(), "seen")
    front = seen
    while True:  # ends: each round finds new hashes or is the last
        found = edges.join(front.select(F.col("hash").alias("parent")), "parent", "left_semi").select(F.col("child").alias("hash")).distinct()
        front = materialize(found.join(seen, "hash", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = materialize(seen.unionByName(front), "seen")
    return seen


def unreachable(objects: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Objects no root reaches."""
    return objects.join(reachable(edges, roots), "hash", "left_anti")


def new_objects(have: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered (hash, kind, data) that are not stored yet, each once (content addressing: equal hash, equal data)."""
    return offered.dropDuplicates(["hash"]).join(have.select("hash"), "hash", "left_anti")


def materialise_tree(objects: DataFrame, root_hash: str) -> DataFrame:
    """Snapshot from tree objects (hash, node_id, children array<hash>): node_id, address, depth, sort_order in preorder levels.
    An object below itself, which no hash of contents can bring about, is an error."""
    most = objects.count()
    level = objects.where(F.col("hash") == root_hash).select("node_id", "hash", F.lit("1").alias("address"), F.lit(1).alias("depth"), F.lit(1).alias("sort_order"), "children")
    parts = []
    while True:
        level = materialize(level, "tree")
        parts.append(level)
        if len(parts) > most + 1:
            raise RuntimeError("the tree has a circle")
        kids = level.select("address", "depth", F.posexplode("children").alias("k", "hash"))
        if kids.isEmpty():
            break
        level = kids.join(objects, "hash").select(
            "node_id", "hash", F.concat_ws("-", "address", (F.col("k") + 1).cast("string")).alias("address"), (F.col("depth") + 1).alias("depth"), (F.col("k") + 1).alias("sort_order"), "children"
        )
    return reduce(DataFrame.unionByName, parts).drop("children", "hash")


def node_log(snapshots: DataFrame) -> DataFrame:
    """Per node, its events along the snapshots (doc_id, step, id, mark): doc_id, id, step, event. ``mark`` is the content
    hash; a node missing in the next snapshot of its document is deleted there."""
    steps = snapshots.select("doc_id", "step").distinct()
    order = Window.partitionBy("doc_id").orderBy("step")
    next_of = steps.select("doc_id", "step", F.lead("step").over(order).alias("next_step"), F.lag("step").over(order).alias("prev_step"))
    rows = snapshots.join(next_of, ["doc_id", "step"])
    along = Window.partitionBy("doc_id", "id").orderBy("step")
    seen = rows.select(
        "doc_id", "id", "step", "mark", "next_step", "prev_step", F.lag("step").over(along).alias("last_step"),
        F.lag("mark").over(along).alias("last_mark"), F.lead("step").over(along).alias("again"),
    )
    event = F.when(F.col("last_step").isNull() | (F.col("last_step") != F.col("prev_step")), "added").when(F.col("last_mark") != F.col("mark"), "changed")
    here = seen.select("doc_id", "id", "step", event.alias("event")).where("event is not null")
    gone = seen.where(F.col("next_step").isNotNull() & ~F.col("again").eqNullSafe(F.col("next_step")))
    return here.unionByName(gone.select("doc_id", "id", F.col("next_step").alias("step"), F.lit("deleted").alias("event")))


def validate_ops(ops: DataFrame, trunk: DataFrame) -> DataFrame:
    """Optimistic check of update entries (seq, id, field, old, new) against trunk rows (id + content fields): per (id, field)
    the first old and last new value, and verdict 'ok', 'blocked:node-deleted' or 'conflict:content-drift'."""
    per = ops.groupBy("id", "field").agg(F.min_by("old", "seq").alias("old"), F.max_by("new", "seq").alias("new"))
    wide = per.join(trunk.select("id", F.struct(*CONTENT).alias("t")), "id", "left")
    now = F.coalesce(*[F.when(F.col("field") == f, F.coalesce(F.col(f"t.{f}"), F.lit(""))) for f in CONTENT])
    verdict = (
        F.when(F.col("t").isNull(), "blocked:node-deleted")
        .when(now != F.coalesce("old", F.lit("")), F.when(now == F.coalesce("new", F.lit("")), "ok").otherwise("conflict:content-drift"))
        .otherwise("ok")
    )
    return wide.select("id", "field", "old", "new", verdict.alias("verdict"))


def diff_view(diff: DataFrame, places: DataFrame) -> DataFrame:
    """Rows to show of a tree diff (id, status): changed rows and their ancestors one by one, runs of others folded.

    ``places`` (doc_id, id, address, key) holds both sides' rows in document order. Result: doc_id, place, kind ('row' or 'fold'),
    id (null for folds), status, n (rows in the fold, else 1).
    """
    rows = places.join(diff, "id")
    changed = rows.where("status <> 'unchanged'")
    parts = F.split("address", "-")
    up = changed.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))).alias("address"))
    shown = rows.join(up.distinct().withColumn("show", F.lit(True)), ["doc_id", "address"], "left")
    order = Window.partitionBy("doc_id").orderBy("key", "id")
    placed = shown.select("doc_id", "id", "status", F.coalesce("show", F.lit(False)).alias("show"), F.row_number().over(order).alias("place"))
    run = F.sum(F.col("show").cast("int")).over(Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    marked = placed.withColumn("run", run)
    folds = marked.where("not show").groupBy("doc_id", "run").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    return marked.where("show").select("doc_id", "place", F.lit("row").alias("kind"), "id", "status", F.lit(1).cast("long").alias("n")).unionByName(
        folds.select("doc_id", "place", F.lit("fold").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit("unchanged").alias("status"), "n")
    )
