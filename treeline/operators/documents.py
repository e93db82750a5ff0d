"""Documents, references, entities and certification: lookups with guards and entry folds without per-row state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.operators.tree import in_subtree

#: Names of node types and the codes they stand for.
NODE_TYPES = {"text": "TEXT", "section": "SECTION", "if": "IF", "else": "ELSE", "loop": "LOOP", "foreach": "FOREACH", "error": "ERROR", "function": "FUNCTION", "class": "CLASS", "try": "TRY", "with": "WITH"}


def one_document(docs: DataFrame, ref: str):
    """The document an id, 'doc:' + id or a unique exact title means; none or several is an error."""
    asked = ref.removeprefix("doc:")
    hits = docs.where((F.col("doc_id").cast("string") == asked) | (F.col("title") == ref)).limit(3).collect()
    by_id = [r for r in hits if str(r.doc_id) == asked]
    if len(by_id) == 1 or len(hits) == 1:
        return (by_id or hits)[0]
    raise LookupError(f"{ref}: {'no' if not hits else 'several'} documents")


def one_commit(commits: DataFrame, ref: str):
    """The commit an id, a time prefix or a part of the summary means (commit_id, created_at, summary); ambiguity is an error."""
    exact = commits.where(F.col("commit_id").cast("string") == ref).limit(1).collect()
    if exact:
        return exact[0]
    hits = commits.where(F.col("created_at").startswith(ref) | F.col("summary").contains(ref)).limit(2).collect()
    if len(hits) != 1:
        raise LookupError(f"{ref}: {'no' if not hits else 'several'} commits")
    return hits[0]


def visible(docs: DataFrame, shadows: DataFrame) -> DataFrame:
    """Documents without the shadow copies of others."""
    return docs.join(shadows.select("doc_id").distinct(), "doc_id", "left_anti")


def node_type(x: Column) -> Column:
    """Code of a node type by alias or code; unknown ones are an error, null is TEXT."""
    table = F.create_map(*[F.lit(v) for pair in NODE_TYPES.items() for v in pair])
    code = table[F.lower(F.trim(F.coalesce(x, F.lit("text"))))]
    return F.coalesce(code, F.raise_error(F.concat(F.lit("unknown node type "), x)).cast("string"))


def stable_id(x: Column) -> Column:
    """Ids that are valid (positive integers or UUIDs of version 7), else null; blanks around them don't count."""
    t = F.trim(x.cast("string"))
    good = t.rlike(r"^[1-9][0-9]*$") | t.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return F.when(good, t)


def certified(nodes: DataFrame, doc_id, root: str, level: str) -> DataFrame:
    """Rows with the trust level of a subtree set; ``changed`` tells the rows that had another one."""
    hit = (F.col("doc_id") == doc_id) & in_subtree(F.col("address"), root)
    other = ~F.col("trust_level").eqNullSafe(F.lit(level))
    return nodes.withColumns({"changed": hit & other, "trust_level": F.when(hit, F.lit(level)).otherwise(F.col("trust_level"))})


def snapshot_find(snapshot: DataFrame, terms: list[str]) -> DataFrame:
    """Rows of a snapshot whose text holds all terms, letter case counting."""
    hit = F.lit(True)
    for t in terms:
        hit = hit & F.col("text").contains(t)
    return snapshot.where(hit)


def grouped_hits(hits: DataFrame) -> DataFrame:
    """Hits per document: rows and summed score."""
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("score").alias("score"))


def moved_paths(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Documents below a path carried to another one; ``moved`` tells which."""
    hit = F.coalesce((F.col("path") == old) | F.col("path").startswith(old.rstrip("/") + "/"), F.lit(False))
    return docs.withColumns({"moved": hit, "path": F.when(hit, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))).otherwise(F.col("path"))})


def without_documents(docs: DataFrame, nodes: DataFrame, spans: DataFrame, gone: DataFrame, anchored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables after documents are deleted with all they own; anchored ones stay."""
    real = gone.select("doc_id").distinct().join(anchored.select("doc_id"), "doc_id", "left_anti")
    return tuple(t.join(real, "doc_id", "left_anti") for t in (docs, nodes, spans))


def fold_refs(refs: DataFrame, ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """References (id, source_id, target_id) after 'ref.add' and 'ref.delete' entries (seq, kind, id, source_id, target_id): of each id
    the last entry counts; an added one needs both ends in one document."""
    last = ops.groupBy("id").agg(F.max_by(F.struct("kind", "source_id", "target_id"), "seq").alias("e")).select("id", "e.*")
    at = nodes.select("id", "doc_id")
    added = (
        last.where("kind = 'ref.add'")
        .join(at.select(F.col("id").alias("source_id"), F.col("doc_id").alias("a")), "source_id")
        .join(at.select(F.col("id").alias("target_id"), F.col("doc_id").alias("b")), "target_id")
        .where("a = b")
    )
    return refs.select("id", "source_id", "target_id").join(last.select("id"), "id", "left_anti").unionByName(added.select("id", "source_id", "target_id"))


def fold_entities(ops: DataFrame) -> DataFrame:
    """Entities after create, update, delete, link, unlink, bind, ignore and clear entries (doc_id, seq, kind, entry JSON, status):
    doc_id, kind ('entity', 'link', 'binding'), a, b, value. Undone entries are left out; creating a known literal (blanks and case
    aside) renames it, a link is an unordered pair."""
    active = ops.where(F.coalesce("status", F.lit("active")) == "active")
    logs = active.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "entry"))).alias("log"))

    def one(log) -> list[tuple[str, str, str | None, str]]:
        names: dict[str, str] = {}
        links: dict[tuple[str, str], str] = {}
        bound: dict[tuple[str, str], str] = {}
        for r in log:
            e = json.loads(r["entry"])
            kind, who = r["kind"].partition(".")[2], e.get("entity")
            literal = (e.get("literal") or "").strip()
            pair = tuple(sorted(filter(None, (e.get("source"), e.get("target")))))
            if kind == "create" and literal:
                known = next((k for k, v in names.items() if v.lower() == literal.lower()), None)
                names[known or who] = literal
            elif kind == "update" and literal and who in names:
                names[who] = literal
            elif kind == "delete" and who in names:
                del names[who]
                links = {p: v for p, v in links.items() if who not in p}
                bound = {p: v for p, v in bound.items() if p[0] != who}
            elif kind == "link" and len(set(pair)) == 2:
                links[pair] = e.get("link_kind", "related")
            elif kind == "unlink" and links.get(pair) is not None and e.get("link_kind") in (None, links[pair]):
                del links[pair]
            elif kind in ("bindNode", "ignoreNode") and who in names and e.get("node"):
                bound[who, e["node"]] = "bound" if kind == "bindNode" else "ignored"
            elif kind == "clearNodeBinding":
                bound.pop((who, e.get("node")), None)
        return [("entity", k, None, v) for k, v in names.items()] + [("link", *p, v) for p, v in links.items()] + [("binding", *p, v) for p, v in bound.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *x) for d, log in zip(pdf["doc_id"], pdf["log"]) for x in one(log)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "a", "b", "value"])

    return logs.mapInPandas(run, f"doc_id {ops.schema['doc_id'].dataType.simpleString()}, kind string, a string, b string, value string")
