"""Mixing sources to target weights (problem 7).

Method: entropy balancing. Of all rates in [0, ``max_repeats``] that give each source its tokens, those nearest in relative entropy to
one copy of every text are exponentially tilted: r = min(max_repeats, exp(lambda * x)), x the text's tokens over its source's
mean. One lambda per source solves the convex dual; distributed Newton iterations (one job each, all sources at once)
aggregate the constraint and its derivative over the (pre-aggregated) token sizes. Rates are rounded into copies by
systematic rounding over the texts in order of size. As rounding a text misses up to half of it, large texts (``LARGE``, shares
of the source's tokens) are rounded first and the rates of the smaller ones solved again for what is left; what is still
missed is made up by texts of that size, one more or one copy less, until no text brings it nearer (``repair``).

The total is the largest that all constraints allow (or ``total_tokens``). Equal texts are one text, whatever document
or source they are in: it belongs to the document with the least id, so no text is used more than max_repeats times.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.abuse import source_name
from treeline.llm.tokens import TOKENIZER, token_counts
from treeline.plans.session import materialize
from treeline.plans.skew import prefix_sums

MOST_ROUNDS = 400
NEAR = 1e-5
LARGE = (0.05, 0.005, 0.0)


def distinct_texts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per distinct non-empty text: doc_id (least), source (cleaned), n_tokens."""
    keyed = docs.where("doc_id is not null and text is not null and text <> ''").select(
        "doc_id", "text", source_name(F.col("source")).alias("source"), F.md5("text").alias("digest")
    )
    counted = token_counts(keyed, "source", "digest", tokenizer=tokenizer)
    one = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("r"))
    return one.select("r.doc_id", "r.source", "r.n_tokens").where("source is not null and n_tokens > 0")


def solve(sizes: DataFrame, goals: dict[str, tuple[int, float, float, float]]) -> dict[str, float]:
    """Newton on the dual, all sources at once. ``sizes``: (source, n_tokens, n texts); ``goals``: source -> (max_repeats, tokens
    wanted, mean tokens, least tokens). Steps (in the logarithm of the constraint) that leave the bracket halve it."""
    high = {s: math.log(m) * mean / least + 1.0 for s, (m, _, mean, least) in goals.items()}
    low = {s: -700.0 * mean / least for s, (_, _, mean, least) in goals.items()}
    lam = dict.fromkeys(goals, 0.0)
    open_ = {s for s, g in goals.items() if g[1] > 0}
    spark = sizes.sparkSession
    for _ in range(MOST_ROUNDS):
        if not open_:
            return lam
        rows = [(s, float(goals[s][0]), goals[s][2], lam[s]) for s in sorted(open_)]
        table = F.broadcast(spark.createDataFrame(rows, "source string, m double, mean double, lam double"))
        x = F.col("n_tokens") / F.col("mean")
        rate = F.exp(F.least(F.col("lam") * x, F.log("m")))
        tokens = F.col("n") * F.col("n_tokens") * rate
        got = (
            sizes.join(table, "source")
            .select("source", tokens.alias("f"), F.when(F.col("lam") * x <= F.log("m"), tokens * x).otherwise(0.0).alias("d"))
            .groupBy("source")
            .agg(F.sum("f").alias("f"), F.sum("d").alias("d"))
            .collect()
        )
        open_ &= {r[0] for r in got}  # a source may have no texts of these sizes
        for s, f, d in got:
            want = goals[s][1]
            if abs(want - f) <= NEAR * want or (want > f and lam[s] == high[s]) or high[s] - low[s] < 1e-12 * max(1.0, abs(low[s])):
                open_.discard(s)  # met, or all texts at most copies
                continue
            if want > f:
                low[s] = lam[s]
            else:
                high[s] = lam[s]
            step = lam[s] + f * math.log(want / f) / d if d > 0 and f > 0 else math.inf
            edge = want > f and step >= high[s]  # would need more than all copies of all: see whether that is enough
            lam[s] = step if low[s] < step < high[s] else high[s] if edge else (low[s] + high[s]) / 2
    raise RuntimeError(f"no rates found for {sorted(open_)}")


def chosen_copies(texts: DataFrame, sizes: DataFrame, goals: dict[str, tuple[int, float, float, float]]) -> DataFrame:
    """Rates and their rounding: (doc_id, source, n_tokens, copies >= 1)."""
    spark = texts.sparkSession
    wanted = {s: g[1] for s, g in goals.items()}
    upto = dict.fromkeys(goals, math.inf)
    parts = []
    for share in LARGE:
        left = {s: (m, max(wanted[s], 0.0), mean, least) for s, (m, _, mean, least) in goals.items()}
        limit = F.broadcast(spark.createDataFrame([(s, upto[s]) for s in goals], "source string, upto double"))
        lam = solve(sizes.join(limit, "source").where("n_tokens <= upto").drop("upto"), left)
        over = {s: share * g[1] for s, g in goals.items()}
        rows = [(s, float(m), mean, lam[s], want > 0, over[s], upto[s]) for s, (m, want, mean, _) in left.items()]
        table = spark.createDataFrame(rows, "source string, m double, mean double, lam double, open boolean, over double, upto double")
        rate = F.when(F.col("open"), F.exp(F.least(F.col("lam") * F.col("n_tokens") / F.col("mean"), F.log("m")))).otherwise(0.0)
        rated = texts.join(F.broadcast(table), "source").where("n_tokens > over and n_tokens <= upto").withColumn("rate", rate)
        whole = F.floor(F.col("rate") + 1e-9)
        part = rated.select(
            "doc_id", "source", "n_tokens", F.col("m").cast("int").alias("m"), whole.alias("whole"),
            F.greatest(F.round((F.col("rate") - whole) * (1 << 30)), F.lit(0)).cast("long").alias("frac"),
        )
        order = [F.col("n_tokens").desc(), F.xxhash64("doc_id"), F.col("doc_id")]
        summed = prefix_sums(part, "source", order, {"before": F.col("frac")})
        half, one = F.lit(1 << 29), F.lit(1 << 30)
        extra = F.floor((F.col("before") + F.col("frac") + half) / one) - F.floor((F.col("before") + half) / one)
        copies = summed.withColumn("copies", F.least((F.col("whole") + extra).cast("int"), F.col("m")))
        parts.append(materialize(copies.select("doc_id", "source", "n_tokens", "copies", "m"), "copies"))
        for r in parts[-1].groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect():
            wanted[r.source] -= r.t
        upto = over
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return repair(every, {s: g[1] for s, g in goals.items()}).where("copies > 0").drop("m")


def repair(copies: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """One copy more or less of single texts, the one of each source that brings it nearest, until none does.

    A pass finds those texts in one job over the counts per size; a source's miss shrinks to below half of what it was or the
    source is done, so there are few passes and at most as many changed texts as passes and sources."""
    spark = copies.sparkSession
    counts = materialize(copies.groupBy("source", "n_tokens", "copies", "m").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")), "counts")
    got = {r[0]: float(r[1]) for r in counts.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens") * F.col("copies"))).collect()}
    miss = {s: t - got.get(s, 0.0) for s, t in wanted.items()}
    changed: dict[tuple, int] = {}
    open_ = set(miss)
    schema = "source string, miss double"
    while open_:
        table = F.broadcast(spark.createDataFrame([(s, miss[s]) for s in sorted(open_)], schema))
        able = F.when(F.col("miss") > 0, F.col("copies") < F.col("m")).otherwise(F.col("copies") > 0)
        taken = [d for _, d in changed]
        free = ~F.col("doc_id").isin(taken) if taken else F.lit(True)  # a size whose first text is changed already is left out
        near = (
            counts.join(table, "source").where(able & free)
            .withColumn("left", F.abs(F.abs("miss") - F.col("n_tokens")))
            .where(F.col("left") < F.abs("miss") / 2)
            .groupBy("source").agg(F.min(F.struct("left", "doc_id", "n_tokens")).alias("r")).select("source", "r.doc_id", "r.n_tokens").collect()
        )
        open_ = {r.source for r in near}
        for r in near:
            step = 1 if miss[r.source] > 0 else -1
            changed[r.source, r.doc_id] = step
            miss[r.source] -= step * r.n_tokens
    if not changed:
        return copies
    id_type = copies.schema["doc_id"].dataType.simpleString()
    steps = F.broadcast(spark.createDataFrame([(d, k) for (_, d), k in changed.items()], f"doc_id {id_type}, step int"))
    fixed = copies.join(steps, "doc_id", "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0)))
    return materialize(fixed.drop("step"), "copies")


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> tuple[list[dict], dict]:
    """Targets of every listed source and the goals of those that take part and have texts. ``targets`` is a small fixed table."""
    have = {r.source: (r.tokens, r.texts, r.least) for r in sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.sum("n").alias("texts"), F.min("n_tokens").alias("least")).join(F.broadcast(targets.select(source_name(F.col("source")).alias("source")).distinct()), "source").collect()}
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_weight", "max_repeats").collect()
    weight = {r.source: r.target_weight if r.target_weight and r.target_weight > 0 else 0.0 for r in rows}
    scale = sum(weight.values()) or 1.0
    live = {r.source for r in rows if weight[r.source] and r.source in have and (r.max_repeats or 0) > 0}
    reach = sum(weight[s] for s in live) or 1.0
    cap = {r.source: r.max_repeats or 0 for r in rows}
    most = min((cap[s] * have[s][0] / (weight[s] / reach) for s in live), default=0.0)
    total = min(most, total_tokens) if total_tokens else most
    goals = {s: (cap[s], total * weight[s] / reach, have[s][0] / have[s][1], float(have[s][2])) for s in sorted(live)}
    listed = [
        {"source": r.source, "target_share": weight[r.source] / scale, "reachable_share": weight[r.source] / reach if r.source in live else 0.0, "max_repeats": cap[r.source]}
        for r in rows
    ]
    return listed, goals


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Selection (doc_id, source, n_tokens, copies >= 1) and report per source of ``targets`` (target_share, reachable_share =
    target scaled to the sources that have texts, actual_share, n_tokens, n_texts, most_copies).

    Null weights and sources outside ``targets`` take no part; sources without texts are reported with 0. Null sources and
    null or empty texts are never selected.
    """
    texts = materialize(distinct_texts(docs, tokenizer), "texts")
    sizes = materialize(texts.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")), "sizes")
    listed, goals = plan(sizes, targets, total_tokens)
    chosen = chosen_copies(texts, sizes, goals)
    per = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"), F.max("copies").alias("most_copies")
    )
    total = per.agg(F.sum("n_tokens")).first()[0] or 0
    goal = docs.sparkSession.createDataFrame(listed, "source string, target_share double, reachable_share double, max_repeats int")
    report = goal.join(per, "source", "left").select(
        "source", "target_share", "reachable_share", (F.coalesce("n_tokens", F.lit(0)) / F.lit(float(max(total, 1)))).alias("actual_share"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
    )
    return chosen, report
