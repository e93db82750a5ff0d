"""Parent-child links to full hierarchies (problem 1).

Method: subtree sizes are computed upward, sibling preorder ranges are allocated by prefix sums downward, and ancestors
and descendants are read off the nested-set ranges ``[lft, rgt]``. Both passes double the distance they cover in each
round, so a tree of depth D takes about log2(D) rounds and not D: after round k a node knows its ancestor at distance
2^k and the sum over everything nearer. Nodes that never reach the end of their chain stay unprocessed: they are the
nodes on a circle or below one. The upward pass has ended when a round leaves the set of nodes with a farther ancestor
as large as it was: depths have no gaps, so what is left then is exactly the cyclic part.

A round moves only the rows that still have somewhere to go; finished rows stay where they were written.
State per round is a table in the shared scratch folder; nothing but counters and hot-key lists (at most 1000 keys)
reaches the driver. Join targets are internal nodes only. A parent with very many children is hot: its children get
their prefix sums by ranges and meet its row by broadcast (see ``plans.skew``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.columns import clean_ref
from treeline.operators.live import live_rows
from treeline.plans.session import materialize, release
from treeline.plans.skew import hot_limit, lookup, prefix_sums

STATES = ("ok", "detached", "cycle")
BLOCK = 1 << 16


def node_links(nodes: DataFrame, deletions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Live nodes with cleaned parent: (id, parent_id, sort_order, *columns)."""
    keep = ["parent_id", "sort_order", *(columns or [])]
    return live_rows(nodes, deletions, "node", keep).withColumn("parent_id", clean_ref(F.col("parent_id")))


def subtree_sizes(links: DataFrame) -> tuple[DataFrame, DataFrame, list[list[str]]]:
    """Upward pass over (id, anc): (id, size) of all, the ids of the cyclic part, and the hot targets of each round.

    ``links`` holds each id once; ``anc`` is the parent where that is a known id, else null. A round moves only rows that
    still have a farther ancestor; what internal nodes gain is kept per round and summed up once at the end.
    """
    total = links.count()
    limit, hot_rounds, counts, gains = hot_limit(total), [], [], []
    one = F.lit(1).cast("long").alias("size")
    active = materialize(links.where(F.col("anc").isNotNull()).select("id", "anc", one), "up")
    while True:
        now = active.count()
        if now == 0 or counts[-1:] == [now]:
            break
        counts.append(now)
        gained = materialize(active.groupBy("anc").agg(F.sum("size").alias("gain"), F.count(F.lit(1)).alias("n")), "gain")
        hot = [r[0] for r in gained.where(F.col("n") > limit).select("anc").collect()] if now > limit else []
        hot_rounds.append(hot)
        gain = gained.select(F.col("anc").alias("id"), "gain")
        gains.append(gain)
        # targets with a farther ancestor; a row whose target has none is done
        targets = active.select("id", F.col("anc").alias("next")).join(gain.select("id"), "id", "left_semi").withColumnRenamed("id", "anc")
        moved = lookup(active.join(gain, "id", "left"), targets, "anc", how="inner", hot=hot)
        fresh = materialize(moved.select("id", F.col("next").alias("anc"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), "up")
        release(active)
        active = fresh
    every = links.select("id", one)
    for gain in gains:
        every = every.unionAll(gain)
    sizes = every.groupBy("id").agg(F.sum("size").alias("size"))
    return sizes, active.select("id"), [hot for hot, n in zip(hot_rounds, counts) if n > now]


def hierarchy(links: DataFrame, with_path: bool = True, hot_rows: int | None = None) -> DataFrame:
    """Derive the hierarchy of (id, parent_id, sort_order): one row per id.

    Result: id, state ('ok', 'detached' = the chain ends at a parent that is no row, 'cycle' = it never ends), root_id,
    address ('1' for a root; parent's address, '-', 1-based place among siblings by sort_order (null last), id),
    depth, lft, rgt (global nested-set range; descendants of x are the rows with x.lft < lft <= x.rgt), n_descendants,
    and with ``with_path`` path (ids from the root to the node, joined by '/'). For cycle rows all of these are null.
    Detached rows are addressed within their fragment, whose top counts as its root. Null parent = root; a null
    sort_order comes last among siblings; equal ones are ordered by id. An empty table gives an empty result.
    """
    base = links.select("id", "parent_id", "sort_order")
    base = base if hasattr(links, "_treeline_path") else materialize(base, "links")
    known = base.select(F.col("id").alias("anc"), F.lit(True).alias("known"))
    own = lookup(base.withColumn("anc", F.col("parent_id")), known, "anc")
    linked = materialize(
        own.select(
            "id", "sort_order", F.when(F.col("known"), F.col("anc")).alias("anc"),
            (F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("loose"),
        ),
        "links",
    )
    sizes, cyclic, hot_rounds = subtree_sizes(linked.select("id", "anc"))
    placed = linked.join(sizes, "id").join(cyclic, "id", "left_anti")
    group = F.coalesce("anc", F.lit("\0roots"))
    order = [F.col("sort_order").asc_nulls_last(), F.col("id").asc()]
    # roots of all trees are one row of siblings: their ranges follow one another, ordered by id
    placed = placed.withColumns({"grp": group, "sort_order": F.when(F.col("anc").isNotNull(), F.col("sort_order"))})
    placed = prefix_sums(placed, "grp", order, {"off": F.col("size"), "before": F.lit(1).cast("long")}, hot_rows)
    is_root = F.col("anc").isNull()
    state = materialize(
        placed.select(
            "id", F.col("anc").alias("ptr"), F.col("id").alias("root_id"), "size", "loose",
            (F.col("off") + F.lit(1)).alias("lft"),
            F.when(is_root, F.lit("1")).otherwise((F.col("before") + 1).cast("string")).alias("address"),
            F.lit(1).alias("depth"),
            *([F.col("id").alias("path")] if with_path else []),
        ),
        "down",
    )
    finished, active = [state.where(F.col("ptr").isNull())], state.where(F.col("ptr").isNotNull())
    for hot in hot_rounds:
        inner = active
        for part in finished:
            inner = inner.unionByName(part)
        targets = inner.where("size > 1").select(  # only internal nodes are pointed at
            F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("root_id").alias("r2"), F.col("lft").alias("l2"),
            F.col("address").alias("a2"), F.col("depth").alias("d2"), F.col("loose").alias("o2"),
            *([F.col("path").alias("h2")] if with_path else []),
        )
        met = lookup(active, targets, "ptr", how="inner", hot=hot)
        fresh = materialize(
            met.select(
                "id", F.col("p2").alias("ptr"), F.col("r2").alias("root_id"), "size", F.col("o2").alias("loose"),
                (F.col("lft") + F.col("l2")).alias("lft"), F.concat_ws("-", "a2", "address").alias("address"),
                (F.col("depth") + F.col("d2")).alias("depth"),
                *([F.concat_ws("/", "h2", "path").alias("path")] if with_path else []),
            ),
            "down",
        )
        finished.append(fresh.where(F.col("ptr").isNull()))
        active = fresh.where(F.col("ptr").isNotNull())
    state = active  # empty by now
    for part in finished:
        state = state.unionByName(part)
    done = state.select(
        "id", F.when(F.col("loose"), "detached").otherwise("ok").alias("state"), "root_id", "address", "depth",
        "lft", (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"),
        *(["path"] if with_path else []),
    )
    never = cyclic.select("id", F.lit("cycle").alias("state"))
    return done.unionByName(never, allowMissingColumns=True)


def descendants(tree: DataFrame, fan: int = 16) -> DataFrame:
    """All (ancestor_id, descendant_id, distance) pairs, read off the nested-set ranges.

    A range is cut into aligned blocks of ``fan``^j positions (at most 2*fan blocks a level, and of at most ``BLOCK`` positions, so
    that no block is more than a small part of a task, however large the tree); a position looks up the
    block it lies in at each level that occurs. That makes the range condition an equi-join whose groups are single
    blocks: no comparison of all pairs. The output has one row per true pair.
    """
    inner = tree.where(F.col("n_descendants") > 0).select(
        F.col("id").alias("ancestor_id"), F.col("depth").alias("_top"), (F.col("lft") + 1).alias("lo"), F.col("rgt").alias("hi")
    )
    widest = inner.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 1
    top = 0
    while fan ** (top + 1) <= min(widest, BLOCK):
        top += 1
    parts = []

    def at_level(j: int):
        return lambda b: F.struct(F.lit(j).alias("lvl"), b.alias("blk"))

    for j in range(top + 1):
        size, above = fan**j, fan ** (j + 1)
        first = F.ceil(F.col("lo") / F.lit(size)).cast("long")
        last = F.floor((F.col("hi") + 1) / F.lit(size)).cast("long") - 1
        blocks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        if j < top:  # leave out what the next level covers
            up_first = F.ceil(F.col("lo") / F.lit(above)).cast("long")
            up_last = F.floor((F.col("hi") + 1) / F.lit(above)).cast("long") - 1
            left = F.when(up_first * fan - 1 >= first, F.sequence(first, F.least(up_first * fan - 1, last)))
            right = F.when(
                (last >= (up_last + 1) * fan), F.sequence(F.greatest((up_last + 1) * fan, first), last)
            )
            empty = F.array().cast("array<bigint>")
            split = F.concat(F.coalesce(left, empty), F.coalesce(right, empty))
            blocks = F.when(last < first, empty).when(up_last < up_first, blocks).otherwise(split)
        parts.append(F.transform(blocks, at_level(j)))
    cover = inner.select("ancestor_id", "_top", F.explode(F.concat(*parts)).alias("b")).select(
        "ancestor_id", "_top", "b.lvl", "b.blk"
    )
    points = tree.where(F.col("lft").isNotNull() & (F.col("depth") > 1)).select(
        F.col("id").alias("descendant_id"), "depth",
        F.explode(F.array(*[F.struct(F.lit(j).alias("lvl"), F.floor(F.col("lft") / F.lit(fan**j)).cast("long").alias("blk")) for j in range(top + 1)])).alias("b"),
    ).select("descendant_id", "depth", "b.lvl", "b.blk")
    return cover.join(points, ["lvl", "blk"]).select(
        "ancestor_id", "descendant_id", (F.col("depth") - F.col("_top")).alias("distance")
    )


def misplaced(nodes: DataFrame, deletions: DataFrame) -> DataFrame:
    """Live nodes not in order: (node_id, tree_state) with 'cycle', 'detached' or 'stale' (stored address or depth
    differs from the derived one, null and blank included)."""
    links = materialize(node_links(nodes, deletions, ["address", "depth"]), "live")
    tree = hierarchy(links, with_path=False).select(
        "id", "state", F.col("address").alias("derived"), F.col("depth").alias("derived_depth")
    )
    both = links.select("id", "address", "depth").join(tree, "id")
    fresh = F.col("address").eqNullSafe(F.col("derived")) & F.col("depth").eqNullSafe(F.col("derived_depth"))
    return both.select(
        F.col("id").alias("node_id"),
        F.when(F.col("state") != "ok", F.col("state")).when(~fresh, "stale").alias("tree_state"),
    ).where(F.col("tree_state").isNotNull())
