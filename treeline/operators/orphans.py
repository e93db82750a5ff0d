"""References to records that do not exist (problem 4).

Fixpoint cascade: a reference whose target is not live is a *direct* orphan. The records hanging on an orphaned record
are *inherited* orphans: nodes below a node whose parent is missing (semi-joined level by level until no new node
turns up), then the spans and axiom references that point at any such node. Each round joins only the nodes found in
the round before with the remaining links. Target keys are made distinct before they meet the record tables, so one
missing key holding a third of all references is looked up once; it comes back by broadcast when hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.functions.columns import clean_ref
from treeline.operators.hierarchy import node_links
from treeline.operators.live import live_rows
from treeline.plans.session import materialize
from treeline.plans.skew import hot_keys, lookup

#: Table, reference column, kind of the target, time of the reference.
REFERENCES = (
    ("source_spans", "node_id", "node", "created_at"),
    ("axiom_refs", "node_id", "node", "requested_at"),
    ("axiom_refs", "axiom_id", "axiom", "requested_at"),
)


def references(source_spans: DataFrame, axiom_refs: DataFrame) -> DataFrame:
    """All non-blank references, one row per record and field: ref_table, ref_id, ref_field, target_kind, target_id,
    at. Copies are one record; of copies that differ in time the earliest counts. Null ids are no records."""
    tables = {"source_spans": source_spans, "axiom_refs": axiom_refs}
    parts = [
        tables[name].select(
            F.lit(name).alias("ref_table"), F.col("id").cast("string").alias("ref_id"), F.lit(field).alias("ref_field"),
            F.lit(kind).alias("target_kind"), clean_ref(F.col(field)).alias("target_id"),
            F.col(at).cast("timestamp_ntz").alias("at"),
        )
        for name, field, kind, at in REFERENCES
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return (
        every.where(F.col("target_id").isNotNull() & F.col("ref_id").isNotNull())
        .groupBy("ref_table", "ref_id", "ref_field", "target_kind", "target_id")
        .agg(F.min("at").alias("at"))
    )


def orphan_nodes(links: DataFrame) -> DataFrame:
    """Fixpoint over (id, parent_id): (id, orphan_kind, hops). Direct: the parent is no live row; inherited: an ancestor is
    such a node, ``hops`` links above. Nodes on circles have all their parents and are no orphans."""
    ids = links.select(F.col("id").alias("parent_id"), F.lit(True).alias("here"))
    asked = links.where(F.col("parent_id").isNotNull()).select("id", "parent_id")
    met = materialize(lookup(asked, ids, "parent_id"), "met")
    edges = met.where("here").select("id", "parent_id")
    # the found rows are few against the links they were filtered from: rebalance, else every scan task writes a file
    first = met.where(F.col("here").isNull()).select("id", F.lit("direct").alias("orphan_kind"), F.lit(0).alias("hops"))
    rounds = [materialize(first.hint("rebalance"), "direct")]
    found = rounds[0].count()
    hop = 0
    while found:  # ends: what hangs on a missing parent has no circles
        hop += 1
        last = rounds[-1].select(F.col("id").alias("parent_id"))
        below = edges.join(last, "parent_id", "left_semi")
        below = below.select("id", F.lit("inherited").alias("orphan_kind"), F.lit(hop).alias("hops"))
        fresh = materialize(below.hint("rebalance"), "below")
        found = fresh.count()
        rounds.append(fresh)
    out = rounds[0]
    for part in rounds[1:]:
        out = out.unionByName(part)
    return out


def orphan_references(
    nodes: DataFrame, axioms: DataFrame, source_spans: DataFrame, axiom_refs: DataFrame, deletions: DataFrame
) -> DataFrame:
    """Orphaned references of every table: ref_table, ref_id, ref_field, target_id, month, orphan_kind, hops.

    ``nodes.parent_id`` is a reference too (ref_table 'nodes', month null). 'direct': the target is not live as of the
    complete data, in whatever document; 'inherited': the target is live but hangs on an orphan. Null and blank
    references are none; blanks and tabs around an id do not count. Empty tables give an empty result.
    """
    links = materialize(node_links(nodes, deletions), "live").select("id", "parent_id")
    hung = materialize(orphan_nodes(links).hint("rebalance"), "orphans")
    live_axioms = live_rows(axioms, deletions, "axiom", [])
    state = (
        links.select("id", F.lit("node").alias("target_kind"))
        .join(hung.select("id", "orphan_kind", "hops"), "id", "left")
        .select("id", "target_kind", F.coalesce("orphan_kind", F.lit("fine")).alias("state"), "hops")
        .unionByName(live_axioms.select("id", F.lit("axiom").alias("target_kind"), F.lit("fine").alias("state"), F.lit(None).cast("int").alias("hops")))
    )
    refs = materialize(references(source_spans, axiom_refs), "refs")
    keyed = refs.withColumn("key", F.concat_ws("\t", "target_kind", "target_id"))
    targets = state.select(F.concat_ws("\t", "target_kind", "id").alias("key"), "state", F.col("hops").alias("above"))
    met = lookup(keyed, targets, "key", hot=hot_keys(keyed, "key"))
    bad = met.where(F.col("state").isNull() | (F.col("state") != "fine"))
    of_refs = bad.select(
        "ref_table", "ref_id", "ref_field", "target_id", F.date_format("at", "yyyy-MM").alias("month"),
        F.when(F.col("state").isNull(), "direct").otherwise("inherited").alias("orphan_kind"),
        F.when(F.col("state").isNull(), F.lit(0)).otherwise(F.col("above") + 1).alias("hops"),
    )
    of_nodes = hung.join(links, "id").select(
        F.lit("nodes").alias("ref_table"), F.col("id").alias("ref_id"), F.lit("parent_id").alias("ref_field"),
        F.col("parent_id").alias("target_id"), F.lit(None).cast("string").alias("month"), "orphan_kind", "hops",
    )
    return of_refs.unionByName(of_nodes)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per table, field, month and kind."""
    return orphans.groupBy("ref_table", "ref_field", "month", "orphan_kind").agg(F.count(F.lit(1)).alias("n"))
