"""Hierarchies, snapshot changes and orphan references on small tables with every awkward case."""

from datetime import datetime

import pytest

from treeline.operators import snapshots
from treeline.operators.hierarchy import descendants, hierarchy, misplaced
from treeline.operators.orphans import orphan_references
from treeline.operators.snapshots import changed_keys, digests, elements, field_values, peel, snapshot_changes
from treeline.plans.session import materialize
from treeline.plans.skew import lookup, prefix_sums
from pyspark.sql import functions as F

NODES = "id string, doc_id string, parent_id string, sort_order int, depth int, address string, text string, created_at string, updated_at string, loaded_at timestamp_ntz, known string, anc string, state string"
GONE = "target_type string, target_id string, doc_id string, deleted_at timestamp_ntz, id string"
T0, T1, T2 = "2024-01-01 00:00:00", "2024-01-02T00:00:00.500Z", datetime(2024, 1, 3)


def node(i, parent, order=1, depth=1, address="1", updated=T0, loaded=None, doc="d"):
    return (i, doc, parent, order, depth, address, "t", T0, updated, loaded, "x", "x", "x")


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, NODES)


def gone_of(spark, rows=()):
    return spark.createDataFrame(list(rows), GONE)


def test_misplaced_states(spark):
    rows = [
        node("r", None), node("a", " r\t", 2, 2, "1-2"), node("b", "r", 1, 2, "1-1"), node("c", "r", None, 2, "1-3"), node("d", "r", None, 2, None),
        node("x", "y", 1, 2, "1-1"), node("y", "x", 1, 2, "1-1"), node("z", "y", 1, 3, "1-1-1"), node("s", "s"), node("o", "missing", 1, 2, "1-1"),
        node("p", "o", 1, 3, "1-1-1"), node("q", "killed", 1, 2, "1-1"), node("killed", None), node("blank", "  "), node("a", "zz", updated="2023-01-01 00:00:00", loaded=T2),
        node("again", None, updated=T1), node(None, "r"), node("r", None),
    ]
    gone = gone_of(spark, [("node", "killed ", None, datetime(2024, 1, 1), "e"), ("node", "again", None, datetime(2024, 1, 2), "e"), ("axiom", "r", None, T2, "e"), ("node", None, None, T2, "e")])
    got = {r.node_id: r.tree_state for r in misplaced(nodes_of(spark, rows), gone).collect()}
    assert got == {"x": "cycle", "y": "cycle", "z": "cycle", "s": "cycle", "o": "detached", "p": "detached", "q": "detached", "d": "stale"}


def test_empty_tables(spark):
    none = nodes_of(spark, [])
    assert misplaced(none, gone_of(spark)).count() == 0
    assert descendants(hierarchy(none.select("id", "parent_id", "sort_order"))).count() == 0


@pytest.mark.parametrize("fan", [2, 16])
def test_deep_and_wide_trees(spark, fan):
    links = [("r", None, 1)] + [(f"c{i}", f"c{i - 1}" if i else "r", 1) for i in range(90)] + [(f"w{i:03d}", "r", i % 7) for i in range(150)]
    df = spark.createDataFrame(links, "id string, parent_id string, sort_order int")
    tree = materialize(hierarchy(df, hot_rows=40))
    rows = {r.id: r for r in tree.collect()}
    kids = sorted((x for x in links if x[1] == "r"), key=lambda x: (x[2], x[0]))
    assert [rows[k].address for k, *_ in kids] == [f"1-{i}" for i in range(1, len(kids) + 1)]
    assert rows["c89"].depth == 91 and rows["c89"].path.count("/") == 90 and rows["r"].n_descendants == 240
    assert sorted(r.lft for r in rows.values()) == list(range(1, 242))
    pairs = descendants(tree, fan).collect()
    assert len(pairs) == len(set(pairs)) == sum(r.depth - 1 for r in rows.values())
    assert {(p.ancestor_id, p.distance) for p in pairs if p.descendant_id == "c2"} == {("r", 3), ("c0", 2), ("c1", 1)}


def test_hot_groups_sum_like_windows(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), "id").where("g <> '2' or id < 300")
    order = [F.col("id").desc()]
    a = prefix_sums(df, "g", order, {"s": F.col("id")}, hot_rows=100).orderBy("g", "id").collect()
    b = prefix_sums(df, "g", order, {"s": F.col("id")}).orderBy("g", "id").collect()
    assert a == b and len(a) == df.count()
    right = df.select("g").distinct().withColumn("v", F.upper("g"))
    assert lookup(df, right, "g", hot=["1"]).count() == df.count()


SNAPS = "doc_id string, snapshot_no int, taken_at timestamp_ntz, id string, parent_id string, sort_order int, node_type string, text string, node_title string, node_note string, trust_level string, loaded_at timestamp_ntz, k1 string, bucket string"


def snap(doc, no, i, text="t", trust=None, note=None, parent=None, loaded=T2):
    return (doc, no, T2, i, parent, 1, "TEXT", text, "", note, trust, loaded, "x", "y")


def changes(spark, rows):
    df = snapshot_changes(spark.createDataFrame(rows, SNAPS))
    return sorted(tuple(r) for r in df.collect())


def test_snapshot_cases(spark):
    later = datetime(2024, 2, 1)
    rows = [
        snap("d", 1, "a"), snap("d", 1, "b"), snap("d", 1, "c", trust=""), snap("d", 3, "a", "u" * 5000), snap("d", 3, "a", "old"), snap("d", 3, "c", trust=None, note=""),
        snap("d", 3, "n"), snap("d", 3, "n"), snap("d", 4, "a", "u" * 5000), snap("d", 4, "c", note="", parent="p"), snap("d", 4, "n", loaded=later, text="z"), snap("d", 4, "n", text="first"),
        snap("e", 2, "a"), snap(None, 1, "a"), snap("e", None, "a"), snap("e", 2, None),
    ]
    rows[4] = snap("d", 3, "a", "old", loaded=datetime(2023, 1, 1))
    assert changes(spark, rows) == [
        ("d", 3, "a", "text"), ("d", 3, "b", "removed"), ("d", 3, "c", "node_note"), ("d", 3, "n", "added"), ("d", 4, "c", "parent_id"), ("d", 4, "n", "text"),
    ]
    df = spark.createDataFrame(rows, SNAPS)
    values = {(r.node_id, r.snapshot_no, r.diff_kind): (r.base, r.value) for r in field_values(df, snapshot_changes(df)).collect()}
    assert values["n", 4, "text"] == ("t", "z") and values["c", 3, "node_note"] == (None, "") and values["b", 3, "removed"] == (None, None)
    assert changes(spark, []) == []


def test_failed_buckets_are_enlarged(spark, monkeypatch):
    rows = [snap("d", 1, f"n{i}") for i in range(700)] + [snap("d", 2, f"n{i}", "new" if i % 2 else "t") for i in range(50, 760)]
    base = spark.createDataFrame(rows, SNAPS)
    built = []
    original = snapshots.build_tables
    monkeypatch.setattr(snapshots, "build_tables", lambda r, m, s: built.append(m) or original(r, m, s))
    keys = changed_keys(elements(materialize(digests(base))), cells=4)
    flags = sorted((r.in_old, r.in_new) for r in keys.collect())
    assert len(built) > 1 and built[1] == 16
    assert flags.count((True, False)) == 50 and flags.count((False, True)) == 60 and flags.count((True, True)) == 325


def test_wrong_digest_is_no_success():
    assert peel([{"cell": -1, "n": 1, "k1": 5, "k2": 5, "v": 5, "c": 5}], 4, 0) == (False, [])


SPANS = "id long, doc_id string, node_id string, sentence_index int, start_offset int, end_offset int, text string, created_at timestamp_ntz, state string"
REFS = "id string, doc_id string, node_id string, axiom_id string, note string, requested_at timestamp_ntz, key string"


def test_orphans(spark):
    nodes = nodes_of(spark, [node("r", None), node("o", "missing"), node("p", "o"), node("dead", None)])
    axioms = spark.createDataFrame([("A", "d", "A1", "c", None, T0, T0)], "id string, doc_id string, label string, content string, status string, created_at string, updated_at string")
    spans = spark.createDataFrame([(1, "d", " r ", 1, 0, 1, "t", T2, "x"), (2, "d", "R", 1, 0, 1, "t", T2, "x"), (2, "d", "R", 1, 0, 1, "t", T2, "x"), (3, "d", None, 1, 0, 1, "t", T2, "x"), (4, "d", "\t", 1, 0, 1, "t", None, "x"), (5, "d", "p", 1, 0, 1, "t", T2, "x")], SPANS)
    refs = spark.createDataFrame([("k", "d", "dead", "A", None, T2, "x"), ("l", "d", "r", "nope", None, None, "x")], REFS)
    gone = gone_of(spark, [("node", "dead", None, T2, "e")])
    got = {(r.ref_table, r.ref_id, r.ref_field, r.orphan_kind, r.hops) for r in orphan_references(nodes, axioms, spans, refs, gone).collect()}
    assert got == {
        ("source_spans", "2", "node_id", "direct", 0), ("source_spans", "5", "node_id", "inherited", 2), ("axiom_refs", "k", "node_id", "direct", 0),
        ("axiom_refs", "l", "axiom_id", "direct", 0), ("nodes", "o", "parent_id", "direct", 0), ("nodes", "p", "parent_id", "inherited", 1),
    }
    empty = orphan_references(nodes.limit(0), axioms.limit(0), spans.limit(0), refs.limit(0), gone.limit(0))
    assert empty.count() == 0
