"""Branches as op-logs: entries folded over a base tree, one document at a time.

State is a map of children lists, so every structural entry is a list operation; addresses, depths and orders are read off at
the end. Entries that cannot apply are skipped. Entries of an undone status are left out. Documents without entries
never reach Python. The fold of one document is sequential by nature: its rows are the unit of work.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OUT = "doc_id {id}, id string, parent_id string, sort_order int, address string, depth int, node_type string, text string, node_title string, node_note string, trust_level string"
_FIELDS = ("node_type", "text", "node_title", "node_note", "trust_level")


def join_notes(a: str | None, b: str | None) -> str:
    return "\n\n".join(x.strip() for x in (a, b) if x and x.strip())


class Tree:
    """Nodes of one document with ordered children."""

    def __init__(self, rows: list[dict]) -> None:
        self.data = {r["id"]: {f: r.get(f) for f in _FIELDS} for r in rows}
        self.up = {r["id"]: r["parent_id"] for r in rows}
        self.kids: dict[str | None, list[str]] = {}
        for r in sorted(rows, key=lambda r: (r["sort_order"] is None, r["sort_order"] or 0, r["id"])):
            self.kids.setdefault(r["parent_id"], []).append(r["id"])

    def below(self, node: str) -> set[str]:
        seen, todo = {node}, [node]
        while todo:
            for k in self.kids.get(todo.pop(), []):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return seen

    def place(self, node: str, parent: str | None, at: int | None = None) -> None:
        """Take a node out of its place and put it under ``parent`` (at the end or an index)."""
        self.kids.get(self.up.get(node), []).count(node) and self.kids[self.up[node]].remove(node)
        own = self.kids.setdefault(parent, [])
        own.insert(len(own) if at is None else at, node)
        self.up[node] = parent

    def movable(self, node: str | None) -> bool:
        return node in self.data and self.up[node] is not None

    def apply(self, kind: str, e: dict) -> None:
        node, target = e.get("node"), e.get("target")
        if kind == "node.insert" and node and node not in self.data:
            parent, after = e.get("parent"), e.get("after")
            if parent is not None and parent not in self.data:
                return
            own = self.kids.get(parent, [])
            self.data[node] = {"node_type": "TEXT", "text": "", "node_title": "", "node_note": "", "trust_level": None} | {k: v for k, v in (e.get("fields") or {}).items() if k in _FIELDS}
            self.place(node, parent, own.index(after) + 1 if after in own else None)
        elif kind == "node.update" and node in self.data:
            self.data[node].update({k: v for k, v in (e.get("fields") or {}).items() if k in _FIELDS})
        elif kind == "node.delete" and self.movable(node):
            for x in self.below(node):
                if x == node:
                    self.kids[self.up[x]].remove(x)
                self.kids.pop(x, None)
                del self.data[x], self.up[x]
        elif kind == "node.move" and self.movable(node):
            own = self.kids[self.up[node]]
            i = own.index(node)
            j = i - 1 if e.get("direction") == "up" else i + 1
            if 0 <= j < len(own):
                own[i], own[j] = own[j], own[i]
        elif kind == "node.promote" and self.movable(node) and self.movable(self.up[node]):
            parent = self.up[node]
            self.place(node, self.up[parent], self.kids[self.up[parent]].index(parent) + 1)
        elif kind == "node.reparent" and self.movable(node) and target in self.data and target not in self.below(node):
            self.place(node, target)
        elif kind in ("node.moveBefore", "node.moveAfter") and self.movable(node) and self.movable(target) and target not in self.below(node):
            own = [x for x in self.kids[self.up[target]] if x != node]
            self.place(node, self.up[target], own.index(target) + (kind == "node.moveAfter"))
        elif kind == "node.split" and node in self.data:
            parts = [s for s in e.get("sentences") or [] if s and s.strip()]
            ids = e.get("new_ids") or []
            if len(parts) >= 2 and len(ids) == len(parts) - 1:
                self.data[node]["text"] = parts[0]
                for i, (x, text) in enumerate(zip(ids, parts[1:])):
                    self.data[x] = {"node_type": "TEXT", "text": text, "node_title": "", "node_note": "", "trust_level": None}
                    self.place(x, node, i)
        elif kind == "node.splitParagraph" and node in self.data:
            self.data[node]["text"] = ""
            for x, text in zip(e.get("new_ids") or [], e.get("sentences") or []):
                self.data[x] = {"node_type": "TEXT", "text": text, "node_title": "", "node_note": "", "trust_level": None}
                self.place(x, node)
        elif kind == "node.mergePrevious" and self.movable(node):
            own = self.kids[self.up[node]]
            i = own.index(node)
            if i:
                self.apply("node.mergeInto", {"node": node, "target": own[i - 1]})
        elif kind == "node.mergeInto" and self.movable(node) and self.movable(target) and node != target and target not in self.below(node):
            a, b = self.data[target], self.data[node]
            for f in ("text", "node_title", "node_note"):
                a[f] = join_notes(a[f], b[f])
            for k in list(self.kids.get(node, [])):
                self.place(k, target)
            self.kids[self.up[node]].remove(node)
            self.kids.pop(node, None)
            del self.data[node], self.up[node]

    def rows(self) -> list[dict]:
        out: list[dict] = []
        todo = [(x, str(i), 1, i) for i, x in reversed(list(enumerate(self.kids.get(None, []), 1)))]
        while todo:
            x, address, depth, place = todo.pop()
            out.append({"id": x, "parent_id": self.up[x], "sort_order": place, "address": address, "depth": depth, **self.data[x]})
            todo += [(k, f"{address}-{i}", depth + 1, i) for i, k in reversed(list(enumerate(self.kids.get(x, []), 1)))]
        return out


def fold(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Trees after the entries (doc_id, seq, kind, entry JSON, status); rows of documents without entries come through as they are."""
    kind = nodes.schema["doc_id"].dataType.simpleString()
    schema = _OUT.format(id=kind)
    names = [c.split()[0] for c in schema.split(", ")]
    active = ops.where(F.coalesce("status", F.lit("active")) == "active").select("doc_id", "seq", "kind", "entry")
    touched = active.select("doc_id").distinct()
    rows = nodes.select(*[c for c in names])

    def run(base: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        rows_of: dict = {}
        for row in base.drop(columns="_bucket").astype(object).where(base.drop(columns="_bucket").notna(), None).to_dict("records"):
            rows_of.setdefault(row.pop("doc_id"), []).append(row)
        out: list[dict] = []
        for doc, own in log.sort_values("seq").groupby("doc_id", sort=False):
            tree = Tree(rows_of.get(doc, []))
            for kind_, text in zip(own["kind"], own["entry"]):
                try:
                    entry = json.loads(text)
                except (TypeError, ValueError):
                    continue
                if isinstance(entry, dict):
                    tree.apply(kind_, entry)
            out += [{"doc_id": doc, **r} for r in tree.rows()]
        return pd.DataFrame(out, columns=names)

    # a document is folded whole; a group holds a bucket of documents, a fraction of a shuffle partition
    buckets = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 8
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("_bucket")
    asked = rows.join(touched, "doc_id", "left_semi").select("*", bucket).groupBy("_bucket")
    folded = asked.cogroup(active.select("*", bucket).groupBy("_bucket")).applyInPandas(run, schema)
    return rows.join(touched, "doc_id", "left_anti").unionByName(folded)


def fold_axioms(axioms: DataFrame, ops: DataFrame) -> DataFrame:
    """Axioms (doc_id, id, label, content, status) after add, update, delete and move entries; labels are renumbered on deletion."""
    kind = axioms.schema["doc_id"].dataType.simpleString()
    ops = ops.select(*[F.col(c).alias(c) for c in ops.columns])
    touched = ops.select(F.col("doc_id").alias("doc_id")).distinct()
    rows = axioms.select("doc_id", "id", "label", "content", "status")

    def number(label: str | None) -> int:
        return int(label[1:]) if label and label[:1] == "A" and label[1:].isdigit() else 0

    def run(base: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        doc = (base if len(base) else log)["doc_id"].iat[0]
        have = sorted(base.astype(object).where(base.notna(), None).to_dict("records"), key=lambda a: (number(a["label"]), a["id"]))
        for r in log.sort_values("seq").itertuples(index=False):
            e = json.loads(r.entry)
            at = next((i for i, a in enumerate(have) if a["id"] == e.get("axiom")), None)
            if r.kind == "axiom.add":
                label = f"A{max((number(a['label']) for a in have), default=0) + 1}"
                have.append({"doc_id": doc, "id": e["axiom"], "label": label, "content": e.get("content", ""), "status": e.get("status", "pending")})
            elif at is None:
                continue
            elif r.kind == "axiom.update":
                have[at].update({k: e[k] for k in ("content", "status") if k in e})
            elif r.kind == "axiom.delete":
                del have[at]
                for i, a in enumerate(have, 1):
                    a["label"] = f"A{i}"
            elif r.kind == "axiom.move":
                to = at - 1 if e.get("direction") == "up" else at + 1
                if 0 <= to < len(have):
                    have[at]["label"], have[to]["label"] = have[to]["label"], have[at]["label"]
                    have[at], have[to] = have[to], have[at]
        return pd.DataFrame(have, columns=["doc_id", "id", "label", "content", "status"])

    schema = f"doc_id {kind}, id string, label string, content string, status string"
    done = rows.join(touched, "doc_id", "left_semi").groupBy("doc_id").cogroup(ops.groupBy("doc_id")).applyInPandas(run, schema)
    return rows.join(touched, "doc_id", "left_anti").unionByName(done)


def undone(ops: DataFrame, steps: int) -> DataFrame:
    """The last ``steps`` active entries of every document marked 'undone'."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("rank_seq"))
    active = F.coalesce("status", F.lit("active")) == "active"
    ranked = ops.withColumn("rank_seq", F.when(active, F.col("seq"))).withColumn("back", F.row_number().over(order))
    return ranked.withColumn("status", F.when(active & (F.col("back") <= steps), "undone").otherwise(F.coalesce("status", F.lit("active")))).drop("rank_seq", "back")


def appended(ops: DataFrame, more: DataFrame) -> DataFrame:
    """New entries behind a log: they come after all others, and undone entries of their documents are gone for good."""
    last = ops.groupBy("doc_id").agg(F.max("seq").alias("last"))
    order = Window.partitionBy("doc_id").orderBy("seq")
    placed = more.join(last, "doc_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + F.row_number().over(order)).drop("last")
    touched = more.select("doc_id").distinct().withColumn("touched", F.lit(True))
    kept = ops.join(touched, "doc_id", "left").where(F.col("touched").isNull() | (F.coalesce("status", F.lit("active")) == "active")).drop("touched")
    return kept.unionByName(placed, allowMissingColumns=True)


def picked(ops: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entries of another branch (doc_id, seq) to carry over, in their order."""
    return ops.join(wanted.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_semi")
