"""Reads over ordered, addressed trees: columns doc_id, id, parent_id, sort_order, address, depth, text, ...

Addresses are materialised paths ('1-2-3'), so subtrees are prefix filters, ancestors are prefixes, and rollups explode
the prefixes of each row and aggregate once; nothing recurses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.functions.columns import address_key, body_chars


def in_subtree(address: Column, root: str) -> Column:
    """The root itself or anything below it."""
    return (address == root) | address.startswith(root + "-")


def subtree(nodes: DataFrame, root: str, levels: int | None = None) -> DataFrame:
    """Rows of the subtree at ``root`` (with ``levels``: only so many levels, the root's included)."""
    rows = nodes.where(in_subtree(F.col("address"), root))
    if levels is not None:
        rows = rows.where(F.col("depth") - F.lit(root.count("-") + 1) < levels)
    return rows


def depth_range(nodes: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """Rows between two depths; reversed bounds are swapped, a missing one equals the other."""
    high = low if high is None else high
    return nodes.where(F.col("depth").between(min(low, high), max(low, high)))


def child_counts(nodes: DataFrame) -> DataFrame:
    """Every row with ``child_count`` (0 for leaves)."""
    counts = nodes.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("child_count"))
    return nodes.join(counts, "id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def ancestor_addresses(address: Column) -> Column:
    """All prefixes of an address, the address itself last."""
    parts = F.split(address, "-")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "-"))


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """Ancestor rows of the asked (doc_id, address), nearest first: asked, rank (0 is the row itself), id, address."""
    asked = of.select("doc_id", F.col("address").alias("asked"), F.explode(ancestor_addresses(F.col("address"))).alias("address"))
    return asked.join(nodes, ["doc_id", "address"]).select(
        "doc_id", "asked", (F.size(F.split("asked", "-")) - F.col("depth")).alias("rank"), "id", "address"
    )


def subtree_rollup(nodes: DataFrame, value: Column) -> DataFrame:
    """Sum of ``value`` over each row's whole subtree, itself included: id, total."""
    up = nodes.select("doc_id", value.alias("v"), F.explode(ancestor_addresses(F.col("address"))).alias("address"))
    sums = up.groupBy("doc_id", "address").agg(F.sum("v").alias("total"))
    return nodes.select("doc_id", "address", "id").join(sums, ["doc_id", "address"]).select("id", "total")


def group_meta(nodes: DataFrame) -> DataFrame:
    """Per document: rows, least and greatest depth, span, most children of one parent, body characters."""
    width = nodes.groupBy("doc_id", "parent_id").agg(F.count(F.lit(1)).alias("w")).groupBy("doc_id").agg(F.max(F.when(F.col("parent_id").isNotNull(), F.col("w"))).alias("max_width"))
    per = nodes.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"),
        (F.max("depth") - F.min("depth") + 1).alias("depth_span"), F.sum(body_chars(F.col("text"))).alias("body_chars"),
    )
    return per.join(width, "doc_id").withColumn("max_width", F.coalesce("max_width", F.lit(0)))


def layer_counts(nodes: DataFrame) -> DataFrame:
    """Per document and depth: rows and body characters (those of the root don't count)."""
    chars = F.when(F.col("depth") > 1, body_chars(F.col("text"))).otherwise(0)
    return nodes.groupBy("doc_id", "depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(chars).alias("body_chars"))


def renumber(nodes: DataFrame) -> DataFrame:
    """Dense sibling order 1..n by (sort_order, null last; id): id, ordinal."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy(F.col("sort_order").asc_nulls_last(), "id")
    return nodes.select("id", F.row_number().over(order).alias("ordinal"))


def neighbours(nodes: DataFrame) -> DataFrame:
    """Previous and next sibling of every row."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("sort_order", "id")
    return nodes.select("id", F.lag("id").over(order).alias("previous_id"), F.lead("id").over(order).alias("next_id"))


def dfs_neighbours(nodes: DataFrame) -> DataFrame:
    """Row before and after in document order."""
    order = Window.partitionBy("doc_id").orderBy("key")
    keyed = nodes.withColumn("key", address_key(F.col("address")))
    return keyed.select("id", F.lag("id").over(order).alias("before_id"), F.lead("id").over(order).alias("after_id"))


def children_page(nodes: DataFrame, offset: int, limit: int) -> DataFrame:
    """Children ``offset`` .. ``offset + limit`` of every parent, with their 0-based place."""
    order = Window.partitionBy("parent_id").orderBy("sort_order", "id")
    placed = nodes.where(F.col("parent_id").isNotNull()).select("parent_id", "id", (F.row_number().over(order) - 1).alias("place"))
    return placed.where((F.col("place") >= offset) & (F.col("place") < offset + limit))


def budget_page(nodes: DataFrame, budget: int) -> DataFrame:
    """Document order, cut where the running characters reach the budget (at least one row): doc_id, id, used_before."""
    before = Window.partitionBy("doc_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    keyed = nodes.where(F.col("depth") > 1).select("doc_id", "id", address_key(F.col("address")).alias("key"), F.length("text").alias("n"))
    run = keyed.withColumn("used_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return run.where(F.col("used_before") < budget).select("doc_id", "id", "used_before")


def clipped_text(nodes: DataFrame, budget: int) -> DataFrame:
    """As ``budget_page``, the last row cut to the rest of the budget: doc_id, id, piece."""
    page = budget_page(nodes, budget).join(nodes.select("id", "text"), "id")
    return page.select("doc_id", "id", F.substring("text", F.lit(1), (F.lit(budget) - F.col("used_before")).cast("int")).alias("piece"))


def layer_stop(nodes: DataFrame, limit: int) -> DataFrame:
    """Deepest depth whose cumulative body characters stay within the limit, but always through the first layer with text."""
    layers = layer_counts(nodes)
    run = Window.partitionBy("doc_id").orderBy("depth")
    cum = layers.select("doc_id", "depth", F.sum("body_chars").over(run).alias("used"), "body_chars")
    first = F.min(F.when(F.col("body_chars") > 0, F.col("depth"))).over(Window.partitionBy("doc_id"))
    kept = cum.withColumn("first", first).where((F.col("used") <= limit) | (F.col("depth") <= F.col("first")))
    return kept.groupBy("doc_id").agg(F.max("depth").alias("stop_depth"))


def subtree_text(nodes: DataFrame) -> DataFrame:
    """Text of each document: all rows but the root with text, in document order, one line each."""
    rows = nodes.where((F.col("depth") > 1) & (body_chars(F.col("text")) > 0))
    lines = F.collect_list(F.struct(address_key(F.col("address")).alias("k"), F.col("text").alias("t")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(lines), lambda x: x["t"]), "\n").alias("body"))


def keyset_page(nodes: DataFrame, after: str, limit: int) -> DataFrame:
    """Rows after an id in id order."""
    return nodes.where(F.col("id") > after).orderBy("id").limit(max(100, min(limit, 10_000)))


def markdown_export(nodes: DataFrame) -> DataFrame:
    """One Markdown text per document: titles as headings of depth 2..6, texts as paragraphs."""
    level = F.least(F.greatest(F.col("depth"), F.lit(2)), F.lit(6))
    head = F.when(F.col("node_title") != "", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("node_title")))
    body = F.when(F.col("text") != "", F.col("text"))
    block = F.concat_ws("\n\n", head, body)
    lines = F.collect_list(F.when(block != "", F.struct(address_key(F.col("address")).alias("k"), block.alias("t"))))
    return nodes.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(lines), lambda x: x["t"]), "\n\n").alias("markdown"))


def ascii_tree(nodes: DataFrame, width: int = 60) -> DataFrame:
    """Indented listing per document: '- address label [children=n]', labels clipped with an ellipsis."""
    flat = F.regexp_replace(F.coalesce(F.when(F.col("node_title") != "", F.col("node_title")), F.col("text")), r"\s+", " ")
    label = F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), F.lit("- "), F.col("address"), F.lit(" "), label, F.lit(" [children="), F.col("child_count").cast("string"), F.lit("]"))
    lines = F.collect_list(F.struct(address_key(F.col("address")).alias("k"), line.alias("t")))
    return child_counts(nodes).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(lines), lambda x: x["t"]), "\n").alias("listing"))


def single_child_chains(nodes: DataFrame) -> DataFrame:
    """Nodes whose only child is a text leaf: (id, child_id), to be shown as one."""
    counted = child_counts(nodes)
    kids = counted.where((F.col("child_count") == 0) & (F.col("node_type") == "TEXT")).select(F.col("parent_id").alias("id"), F.col("id").alias("child_id"))
    return counted.where("child_count = 1").select("id").join(kids, "id")
