"""Queries of the general training-data problems (1, 2, 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.operators.hierarchy import descendants, hierarchy, misplaced, node_links
from treeline.operators.orphans import orphan_references, orphan_report
from treeline.operators.snapshots import field_values, snapshot_changes
from treeline.plans.session import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return misplaced(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "deletions"))


def p1_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = node_links(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "deletions"))
    return hierarchy(links).select(F.col("id").alias("node_id"), "state", "root_id", "address", "depth", "path", "n_descendants")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = node_links(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "deletions"))
    return descendants(materialize(hierarchy(links, with_path=False), "tree"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "node_snapshots"))


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = table(spark, sf_dir, "node_snapshots")
    return field_values(snaps, materialize(snapshot_changes(snaps), "changes"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("nodes", "axioms", "source_spans", "axiom_refs", "deletions")
    return orphan_references(*[table(spark, sf_dir, n) for n in names])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    direct = _orphans(spark, sf_dir).where((F.col("orphan_kind") == "direct") & (F.col("ref_table") != "nodes"))
    return direct.select("ref_table", "ref_id", "ref_field").distinct()


def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_id", "ref_field", "target_id", "orphan_kind", "hops")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p2_found, p2_values, p4_found, p4_cascade, p4_report)}

_TIME = "try_cast(replace(replace(trim({}), 'T', ' '), 'Z', '') AS timestamp)"
_REF = r"nullif(trim({}, E' \t'), '')"
_LIVE = f"""
versions AS (
  SELECT 'node' AS kind, id, doc_id, parent_id, sort_order, address, depth, {_TIME.format("updated_at")} AS u, loaded_at AS l FROM nodes
  UNION ALL
  SELECT 'axiom', id, doc_id, NULL, NULL, NULL, NULL, {_TIME.format("updated_at")}, NULL FROM axioms),
latest AS (
  SELECT * FROM versions WHERE id IS NOT NULL AND trim(id) <> ''
  QUALIFY row_number() OVER (PARTITION BY kind, id ORDER BY u DESC NULLS LAST, l DESC NULLS LAST) = 1),
gone AS (SELECT lower(trim(target_type)) AS kind, {_REF.format("target_id")} AS id, max(deleted_at) AS d FROM deletions GROUP BY ALL),
live AS (
  SELECT latest.kind, latest.id, doc_id, {_REF.format("parent_id")} AS parent_id, sort_order, address, depth
  FROM latest LEFT JOIN gone ON gone.kind = latest.kind AND gone.id = latest.id WHERE d IS NULL OR u > d),
ln AS (SELECT * FROM live WHERE kind = 'node')"""
_TREE = f"""
WITH RECURSIVE {_LIVE},
placed AS (
  SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY sort_order NULLS LAST, id) AS pos,
         parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM ln) AS loose FROM ln),
tree AS (
  SELECT id, CASE WHEN loose THEN 'detached' ELSE 'ok' END AS state, id AS root_id, '1' AS address, 1 AS depth, id AS path
  FROM placed WHERE parent_id IS NULL OR loose
  UNION ALL
  SELECT p.id, t.state, t.root_id, t.address || '-' || p.pos, t.depth + 1, t.path || '/' || p.id
  FROM placed p JOIN tree t ON p.parent_id = t.id WHERE NOT p.loose)"""
_CLOSURE = "closure AS (SELECT unnest(string_split(path, '/')) AS ancestor_id, id AS descendant_id, unnest(generate_series(depth - 1, 0, -1)) AS distance FROM tree)"
_FIELDS = ("text", "node_title", "node_note", "node_type", "trust_level", "parent_id")
_DIFF = """
WITH last AS (
  SELECT doc_id, snapshot_no, id, text, node_title, node_note, node_type, coalesce(trust_level, '') AS trust_level, parent_id
  FROM node_snapshots WHERE doc_id IS NOT NULL AND snapshot_no IS NOT NULL AND id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, snapshot_no, id ORDER BY loaded_at DESC) = 1),
steps AS (
  SELECT doc_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY doc_id ORDER BY snapshot_no) AS prev_no
  FROM (SELECT DISTINCT doc_id, snapshot_no FROM last)),
new AS (SELECT last.* FROM last JOIN steps USING (doc_id, snapshot_no) WHERE prev_no IS NOT NULL),
old AS (SELECT last.* REPLACE (steps.snapshot_no AS snapshot_no) FROM last JOIN steps ON steps.doc_id = last.doc_id AND steps.prev_no = last.snapshot_no),
cases AS (
  SELECT new.doc_id, new.snapshot_no, new.id AS node_id, 'added' AS diff_kind, NULL AS base, NULL AS value
  FROM new ANTI JOIN old USING (doc_id, snapshot_no, id)
  UNION ALL SELECT old.doc_id, old.snapshot_no, old.id, 'removed', NULL, NULL FROM old ANTI JOIN new USING (doc_id, snapshot_no, id)
""" + "".join(
    f"  UNION ALL SELECT new.doc_id, new.snapshot_no, new.id, '{f}', old.{f}, new.{f} FROM new JOIN old USING (doc_id, snapshot_no, id)"
    f" WHERE new.{f} IS DISTINCT FROM old.{f}\n"
    for f in _FIELDS
) + ")"
_REFS = f"""
WITH RECURSIVE {_LIVE},
refs AS (
  SELECT 'source_spans' AS ref_table, CAST(id AS varchar) AS ref_id, 'node_id' AS ref_field, 'node' AS kind, {_REF.format("node_id")} AS target_id, created_at AS seen FROM source_spans
  UNION ALL SELECT 'axiom_refs', id, 'node_id', 'node', {_REF.format("node_id")}, requested_at FROM axiom_refs
  UNION ALL SELECT 'axiom_refs', id, 'axiom_id', 'axiom', {_REF.format("axiom_id")}, requested_at FROM axiom_refs),
one AS (SELECT ref_table, ref_id, ref_field, kind, target_id, min(seen) AS seen FROM refs WHERE target_id IS NOT NULL AND ref_id IS NOT NULL GROUP BY ALL),
hung AS (
  SELECT id, parent_id, 0 AS hops FROM ln WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM ln)
  UNION ALL SELECT ln.id, ln.parent_id, hops + 1 FROM ln JOIN hung ON ln.parent_id = hung.id),
cascade AS (
  SELECT ref_table, ref_id, ref_field, target_id, strftime(seen, '%Y-%m') AS month,
         CASE WHEN live.id IS NULL THEN 'direct' ELSE 'inherited' END AS orphan_kind,
         CASE WHEN live.id IS NULL THEN 0 ELSE hops + 1 END AS hops
  FROM one LEFT JOIN live ON live.kind = one.kind AND live.id = target_id LEFT JOIN hung ON one.kind = 'node' AND hung.id = live.id
  WHERE live.id IS NULL OR hung.id IS NOT NULL
  UNION ALL SELECT 'nodes', id, 'parent_id', parent_id, NULL, CASE WHEN hops = 0 THEN 'direct' ELSE 'inherited' END, hops FROM hung)"""

ORACLE = {
    "p1_found": f"""{_TREE}
SELECT ln.id AS node_id, CASE WHEN tree.id IS NULL THEN 'cycle' WHEN state = 'detached' THEN 'detached' ELSE 'stale' END AS tree_state
FROM ln LEFT JOIN tree ON tree.id = ln.id
WHERE tree.id IS NULL OR state = 'detached' OR ln.address IS DISTINCT FROM tree.address OR ln.depth IS DISTINCT FROM tree.depth""",
    "p1_hierarchy": f"""{_TREE}, {_CLOSURE}
SELECT ln.id AS node_id, coalesce(state, 'cycle') AS state, root_id, tree.address, tree.depth, path, n - 1 AS n_descendants
FROM ln LEFT JOIN tree ON tree.id = ln.id
LEFT JOIN (SELECT ancestor_id, count(*) AS n FROM closure GROUP BY 1) c ON c.ancestor_id = ln.id""",
    "p1_descendants": f"{_TREE}, {_CLOSURE} SELECT ancestor_id, descendant_id, CAST(distance AS int) AS distance FROM closure WHERE distance > 0",
    "p2_found": f"{_DIFF} SELECT doc_id, snapshot_no, node_id, diff_kind FROM cases",
    "p2_values": f"{_DIFF} SELECT doc_id, snapshot_no, node_id, diff_kind, base, value FROM cases",
    "p4_found": f"{_REFS} SELECT DISTINCT ref_table, ref_id, ref_field FROM cascade WHERE orphan_kind = 'direct' AND ref_table <> 'nodes'",
    "p4_cascade": f"{_REFS} SELECT ref_table, ref_id, ref_field, target_id, orphan_kind, hops FROM cascade",
    "p4_report": f"{_REFS} SELECT ref_table, ref_field, month, orphan_kind, count(*) AS n FROM cascade GROUP BY ALL",
}
