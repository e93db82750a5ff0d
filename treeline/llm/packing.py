"""Filling fixed-capacity containers with items (problem 6).

Method: swap-based local search. Items are dealt into groups of about ``GROUP_ITEMS`` by hash (so groups are even whatever the
data) and filled in the order they come (next fit). Then documents are exchanged between underfull containers: one takes a document
of another one, or exchanges one for one, or two of its own for one, always the exchange that fills it most; each raises the
sum of squared fills, so containers get full and the emptiest run empty and vanish. Passes go on until one finds no
exchange; only then two documents are taken for one or none, as they use up the small ones. Every size that occurs outside is looked at for every document and every pair inside; nothing is capped.
Containers that are still not full are pooled over groups, dealt anew and searched again, until a round frees none.
An item larger than the capacity is divided: its full parts fill containers of their own, its rest is an item.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.plans.session import materialize

GROUP_ITEMS = 4_000
_OUT = "pack_name string, capacity long, container_id string, doc_id {id}, piece_no int, token_start long, n_tokens long, fill long"


def next_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers filled in the order of the items: lists of item positions. None gets full by chance: a full one is out of
    the search, whatever small items it has used up."""
    bins: list[list[int]] = []
    room = -1
    for i, s in enumerate(sizes.tolist()):
        if s >= room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= s
    return bins


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search: moves and exchanges that increase the sum of squared fills, until a pass finds none."""
    size = sizes.tolist()
    held = [set(items) for items in bins]
    fill = [sum(size[i] for i in items) for items in bins]
    home = {i: b for b, items in enumerate(bins) for i in items}
    free: dict[int, set[int]] = defaultdict(set)  # items by size in containers that may give
    mask = 0  # bit s: an item of size s may be taken

    def offer(i: int) -> None:
        nonlocal mask
        free[size[i]].add(i)
        mask |= 1 << size[i]

    def withdraw(i: int) -> None:
        nonlocal mask
        free[size[i]].discard(i)
        if not free[size[i]]:
            mask &= ~(1 << size[i])

    def largest(upto: int) -> int:
        """Greatest size on offer that is at most ``upto``; -1 if there is none."""
        return (mask & ((2 << upto) - 1)).bit_length() - 1 if upto > 0 else -1

    def best(b: int, room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
        """Greatest gain of one exchange, the sizes that b gives and those it takes."""
        x = largest(room)
        gain, out, into = (x, (), (x,)) if x > 0 else (0, (), ())
        if gain == room or not mask:
            return gain, out, into
        own = sorted((size[i] for i in held[b]), reverse=True)
        gives = [(x,) for x in dict.fromkeys(own)]
        gives += dict.fromkeys((x, y) for k, x in enumerate(own) for y in own[k + 1 :])
        for give in gives:
            t = sum(give)
            x = largest(t + room)
            if x - t > gain:
                gain, out, into = x - t, give, (x,)
                if gain == room:
                    return gain, out, into
        offered = [s for s in free if free[s]] if late else []
        for give in [(), *gives[: len(dict.fromkeys(own))]]:
            t = sum(give) + room
            for x in offered:
                y = largest(min(t - x, x))
                if y > 0 and x + y - t + room > gain and (x != y or len(free[x]) > 1):
                    gain, out, into = x + y - t + room, give, (x, y)
                    if gain == room:
                        return gain, out, into
        return gain, out, into

    changed, late = True, False
    while changed or not late:
        late = late or not changed
        changed = False
        # those with the largest documents first, as they have the fewest partners; once that ends, the fullest first
        front = [fill[b] if late else max((size[i] for i in held[b]), default=0) for b in range(len(bins))]
        open_bins = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (-front[b], -fill[b], b))
        free.clear()
        mask = 0
        for b in open_bins:
            for i in held[b]:
                offer(i)
        for b in open_bins:  # from the fullest on; those behind it give
            for i in held[b]:
                withdraw(i)
            while fill[b] and fill[b] < capacity:
                gain, out, into = best(b, capacity - fill[b])
                if gain <= 0:
                    break
                taken: list[int] = []
                for x in into:  # of the documents of that size the one in the emptiest container
                    taken.append(min((i for i in free[x] if i not in taken), key=lambda j: (fill[home[j]], j)))
                moved = [(i, home[i], b) for i in taken]
                for x in out:  # what is given goes where the largest document came from
                    moved.append((next(j for j in held[b] if size[j] == x and all(j != m[0] for m in moved)), b, home[taken[0]]))
                touched = {m[1] for m in moved} | {b}
                before = sum(fill[k] ** 2 for k in touched)
                for i, old, new in moved:
                    held[old].discard(i)
                    held[new].add(i)
                    fill[old] -= size[i]
                    fill[new] += size[i]
                    home[i] = new
                if sum(fill[k] ** 2 for k in touched) <= before or any(fill[k] > capacity for k in touched):
                    for i, old, new in moved:
                        held[new].discard(i)
                        held[old].add(i)
                        fill[new] -= size[i]
                        fill[old] += size[i]
                        home[i] = old
                    break
                for i, _, new in moved:
                    withdraw(i) if new == b else offer(i)
                changed = True
    return [sorted(items) for items in held if items]


def _search(tag: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["deal", "doc_id", "piece_no"]).reset_index(drop=True)
        sizes, capacity = pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iat[0])
        bins = improve(sizes, next_fit(sizes, capacity), capacity)
        where, full = np.zeros(len(pdf), int), np.zeros(len(pdf), int)
        for b, items in enumerate(bins):
            where[items], full[items] = b, int(sizes[items].sum())
        group = int(pdf["grp"].iat[0])
        names = [f"{tag}-{group}-{b}" for b in where]
        return pdf.assign(container_id=names, fill=full)[
            ["pack_name", "capacity", "container_id", "doc_id", "piece_no", "token_start", "n_tokens", "fill"]
        ]

    return run


def _open(packed: DataFrame) -> tuple[int, int]:
    """Containers that are not full, and the most items of one capacity in them."""
    per = packed.where("fill < capacity").groupBy("pack_name").agg(F.count_distinct("container_id").alias("c"), F.count(F.lit(1)).alias("n"))
    c, n = per.agg(F.sum("c"), F.max("n")).first()
    return c or 0, n or 0


def pack(items: DataFrame, limits: DataFrame, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Fill containers of every capacity with (doc_id, n_tokens): pack_name, capacity, container_id, doc_id, piece_no,
    token_start, n_tokens, fill (tokens in the container).

    A text above the capacity has several pieces (piece_no from 1), any other exactly one. Texts without tokens take no
    room: their container_id and fill are null. Null or non-positive capacities and null ids are left out.
    """
    id_type = items.schema["doc_id"].dataType.simpleString()
    # a small table that never grows: each text once for each capacity
    caps = limits.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).distinct().collect()
    packs = F.array(*[F.struct(F.lit(r.pack_name).alias("pack_name"), F.lit(r.capacity).cast("long").alias("capacity")) for r in caps])
    if not caps:
        packs = F.array().cast("array<struct<pack_name:string,capacity:bigint>>")
    sized = materialize(items.select("doc_id", "n_tokens").where("doc_id is not null"), "sized")
    every = sized.select("doc_id", "n_tokens", F.explode(packs).alias("p")).select("doc_id", "n_tokens", "p.pack_name", "p.capacity")
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.col("capacity"))
    parts = every.where("n_tokens > 0").select("*", F.posexplode(starts).alias("k", "token_start"))
    parts = parts.select(
        "pack_name", "capacity", "doc_id", (F.col("k") + 1).cast("int").alias("piece_no"), "token_start",
        F.least(F.col("capacity"), F.col("n_tokens") - F.col("token_start")).alias("n_tokens"),
    )
    own = F.col("n_tokens") == F.col("capacity")
    full = parts.where(own).withColumns({
        "container_id": F.concat_ws("-", "pack_name", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")),
        "fill": F.col("capacity"),
    })
    nothing = every.where("n_tokens = 0").select(
        "pack_name", "capacity", "doc_id", F.lit(1).alias("piece_no"), F.lit(0).cast("long").alias("token_start"), "n_tokens",
        F.lit(None).cast("string").alias("container_id"), F.lit(None).cast("long").alias("fill"),
    )
    rest, settled = parts.where(~own), [full, nothing]
    n, last, r = sized.where("n_tokens > 0").count(), None, 0
    while n:
        groups = max(1, -(-n // group_items))
        deal = F.xxhash64("doc_id", "piece_no", F.lit(r))
        grouped = rest.withColumns({"deal": deal, "grp": F.pmod(deal, F.lit(groups)).cast("int")})
        schema = _OUT.format(id=id_type)
        done = materialize(grouped.groupBy("pack_name", "grp").applyInPandas(_search(f"r{r}"), schema), "packed")
        slack = F.col("fill") < F.col("capacity")
        n_open, n = _open(done)
        if groups == 1 or not n or (last is not None and n_open >= last):  # everything met, or dealing anew frees nothing more
            settled.append(done)
            break
        settled.append(done.where(~slack))
        rest, last, r = done.where(slack).drop("container_id", "fill"), n_open, r + 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    names = F.when(F.col("container_id").rlike("^r[0-9]+-"), F.concat_ws("-", "pack_name", "container_id"))
    return out.withColumn("container_id", F.coalesce(names, "container_id")).select(
        "pack_name", "capacity", "container_id", "doc_id", "piece_no", "token_start", "n_tokens", "fill"
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, the least possible number, tokens and fill rate."""
    used = packed.where("container_id is not null")
    per = used.groupBy("pack_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("fill"))
    return per.groupBy("pack_name", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("fill") / F.first("capacity")).alias("least_containers"),
        F.sum("fill").alias("n_tokens"), (F.sum("fill") / (F.count(F.lit(1)) * F.first("capacity"))).alias("fill_rate"),
    )
