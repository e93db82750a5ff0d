"""Sentence boundaries across languages and scripts (problem 3).

Method: a hidden-event n-gram language model. Between the words of a text a hidden boundary token may stand; the model has
the probability of a boundary after the last two words with their mark (backing off to one word, then to its shape),
of a word after a boundary, and of a word after the mark without one. A space between Thai words is a mark of its own kind. It is
trained on the corpus itself without labels: ends and starts of units (paragraphs, turns, list lines; see ``boundaries``)
are boundaries that are sure, all gaps in between are hidden, and expectation maximisation over the counted n-grams of
*all* documents gives the rest. In decoding, forward-backward over the gaps of a unit gives each gap's posterior; whether
a word is the first of its sentence (``嗯……``, ``Well ...``) depends on the gap before, so neighbouring gaps are chained.
0.5 decides.

A unit without any punctuation has no marks to go by. There every place between words (characters, where words are not
spaced) is a gap: P(boundary | word) is then summed over all marks the corpus has after that word, against all its
occurrences, the right word is weighed as first word against any other occurrence, and forward-backward runs over the words since the
last boundary (a sentence rarely has one or two). As a long sentence can lack marks too, the posteriors count by the odds that a single
sentence of the corpus would be that long (``UNMARKED``).

Counting and decoding are one Arrow pass each over the documents; what is shuffled are n-gram counts (pre-aggregated
per batch). Up to ``MAX_TYPES`` n-gram types the driver fits; beyond, the same rounds run as aggregations over all types
(``fit_types``), so no count is left out. The model that is broadcast holds the ``MAX_KEYS`` most frequent entries of a kind;
n-grams beyond these are decided by the back-off, whose tables hold the counts of all.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeline.llm.boundaries import SPACE, THAI, _EMOJI, count_words, first_word, gaps, units, word_gaps, word_key
from treeline.plans.session import materialize, release, settled, spread

MAX_TYPES = 400_000
MAX_KEYS = 100_000
KAPPA = 3.0
SLACK = 2.0
UNMARKED = 0.01  # prior odds that a unit without punctuation leaves boundaries unmarked
HAZARD = ((0.05, 0.4, 1.0), (0.02, 0.05, 0.1, 0.3, 0.6, 1.0))  # by words (characters) since the last boundary
CLASS = 5.0  # pseudo-counts of each kind of right word
_WORD = 9  # value of ``first`` in the count rows of words
_COUNTS = "l0 string, l1 string, l2 string, r1 string, r2 string, first int, n long"


def is_chat(kind: object) -> bool:
    """Whether a source_type means turns."""
    return isinstance(kind, str) and kind.strip().lower() == "chat"


def _count(text: str, chat: bool, into: Counter) -> None:
    thai, emoji = THAI.search(text) is not None, _EMOJI.search(text) is not None
    for a, b, body in units(text, chat):
        if body >= b:
            continue
        found, _, final = gaps(text, a, b, body, thai=thai, emoji=emoji)
        for g in found:
            into[(*g.keys, g.first)] += 1
        if final:
            into[(*final[:3], "", "", final[3])] += 1
        into[("", "", "", *first_word(text[a:b], body - a), 0)] += 1


def ngram_counts(docs: DataFrame) -> DataFrame:
    """n-gram counts of all texts: types of gaps, of unit ends (empty right side), of unit starts (empty left side) and of
    words wherever they stand (only r1, ``first`` is _WORD)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            words: Counter = Counter()
            for text, kind in zip(pdf["text"], pdf["source_type"]):
                if text:
                    _count(text, is_chat(kind), c)
                    count_words(text, words)
            for w, n in words.items():
                if key := word_key(w):
                    c[("", "", "", key, "", _WORD)] += n
            yield pd.DataFrame([(*k, n) for k, n in c.items()], columns=["l0", "l1", "l2", "r1", "r2", "first", "n"])

    counted = docs.select("text", "source_type").mapInPandas(run, _COUNTS)
    return counted.groupBy("l0", "l1", "l2", "r1", "r2", "first").agg(F.sum("n").alias("n"))


class Model:
    """Hidden-event model: boundary after left context, word after boundary, word without one; for units without punctuation
    ``words``: (P(boundary | word), P(word | boundary) / P(word | none)), and ``length``, the mean sentence in words."""

    def __init__(self, end: list[dict], start: list[dict], inner: list[dict], words: dict | None = None, length: float = 20.0) -> None:
        self.end, self.start, self.inner, self.words, self.length = end, start, inner, words or {}, length

    def parts(self, keys: tuple, first: int) -> tuple[float, float, float]:
        """P(boundary | left), P(right word | boundary), P(right word | no boundary)."""
        l0, l1, l2, r1, r2 = keys
        p = self.closing(l0, l1, l2, r2, first)
        s = self.start[0].get(r1)
        q = self.inner[0].get(r1)
        if s is None and q is None:
            s, q = self.start[1].get(r2, 0.02), self.inner[1].get(r2, 0.02)
        else:
            floor = 1e-7
            s, q = s or floor, q or floor
        return p, s, q

    def closing(self, l0: str, l1: str, l2: str, r2: str, first: int) -> float:
        """P(boundary | left)."""
        tag = "^" if first else ""
        e = self.end
        p = e[0].get(tag + l0)
        if p is None:
            p = e[1].get(tag + l1)
            if p is None:
                p = e[2].get(tag + l2)
                if p is None:
                    p = e[3].get(l2[l2.find("|") :], _prior(l2, r2))
        return min(max(p, 1e-5), 1 - 1e-5)

    def posteriors(self, found: list, final: tuple | None = None) -> list[float]:
        """Forward-backward over the gaps of one unit; state: is the gap a boundary. ``final``: keys of the unit's sure end."""
        chained = final is not None and final[3] == 2 or any(g.first == 2 for g in found)
        if not chained:  # no gap depends on another: forward times backward is each gap's own odds
            out = []
            for g in found:
                p, s, q = self.parts(g.keys, g.first)
                out.append(p * s / (p * s + (1 - p) * q))
            return out
        steps = []  # P(boundary | none before), P(boundary | one before), the right word's likelihoods
        for g in found:
            p0, s, q = self.parts(g.keys, int(g.first == 1))
            steps.append((p0, self.closing(*g.keys[:3], g.keys[4], 1) if g.first == 2 else p0, s, q))
        yes, no, forward = 0.0, 1.0, []
        for p0, p1, s, q in steps:
            yes, no = (yes * p1 + no * p0) * s, (yes * (1 - p1) + no * (1 - p0)) * q
            yes, no = yes / (yes + no), no / (yes + no)
            forward.append((yes, no))
        yes = no = 1.0  # P(what follows | boundary here or not)
        if final and final[3] == 2:
            yes, no = self.closing(*final[:3], "", 1), self.closing(*final[:3], "", 0)
        out = []
        for (f1, f0), (p0, p1, s, q) in zip(reversed(forward), reversed(steps)):
            out.append(f1 * yes / (f1 * yes + f0 * no))
            yes, no = p1 * s * yes + (1 - p1) * q * no, p0 * s * yes + (1 - p0) * q * no
            yes, no = yes / (yes + no), no / (yes + no)
        return out[::-1]

    def unmarked(self, between: list[tuple], unspaced: bool) -> list[float]:
        """Posteriors of the places between the words of a unit without punctuation; state: words since the last boundary."""
        n = len(between)
        weight = 1 / (1 + math.exp(min(-math.log(UNMARKED) - n / self.length, 50.0)))
        if weight <= 0.5:
            return []
        hazard = HAZARD[unspaced]
        if not any(k != k.lower() for x in between for k in x[2:]):
            between = [(a, b, LOWER + x, LOWER + y) for a, b, x, y in between]
        top = len(hazard) - 1
        usual = 1 / self.length
        steps = []
        for _, _, left, right in between:
            p, ratio = self.words.get(left, (usual, 1.0))[0], self.words.get(right, (usual, 1.0))[1]
            steps.append(([min(p * h, 0.999) for h in hazard], ratio))
        alpha, forward = [1.0] + [0.0] * top, []
        for p, r in steps:
            forward.append(alpha)
            fresh = [sum(x * y for x, y in zip(alpha, p)) * r] + [0.0] * top
            for d, x in enumerate(alpha):
                fresh[min(d + 1, top)] += x * (1 - p[d])
            total = sum(fresh)
            alpha = [x / total for x in fresh]
        beta, out = [1.0] * (top + 1), []
        for (p, r), alpha in zip(reversed(steps), reversed(forward)):
            cut = sum(x * y for x, y in zip(alpha, p)) * r * beta[0]
            kept = sum(x * (1 - y) * beta[min(d + 1, top)] for d, (x, y) in enumerate(zip(alpha, p)))
            out.append(weight * cut / (cut + kept))
            beta = [y * r * beta[0] + (1 - y) * beta[min(d + 1, top)] for d, y in enumerate(p)]
            total = sum(beta)
            beta = [x / total for x in beta]
        return out[::-1]


def _prior(l2: str, r2: str) -> float:
    shape, tail = l2.split("|", 1)
    kind = tail[:1]
    if kind == SPACE:
        return 0.97
    if kind in "。！？؟۔।॥｡．။።։།":
        base = 0.97
    elif kind in "!?;;":
        base = 0.9
    elif kind == "…":
        base = 0.6
    else:
        base = {"1": 0.1, "Ab": 0.35, "ab": 0.6, "d": 0.4, "0": 0.6}.get(shape, 0.9)
    if tail[1:2] == "q":
        base *= 0.15
    if r2.endswith("l"):
        base *= 0.1
    return base


def fit(counts: pd.DataFrame, rounds: int = 12) -> Model:
    """Expectation maximisation over n-gram types (one row per type with its count)."""
    is_word = counts["first"] == _WORD
    words, counts = counts[is_word], counts[~is_word]
    is_end, is_start = (counts.r1 == "") & (counts.l2 != ""), counts.l2 == ""
    ends, starts, mid = counts[is_end], counts[is_start], counts[~is_end & ~is_start].reset_index(drop=True)
    if mid.empty:
        return Model([{}, {}, {}, {}], [{}, {}], [{}, {}])
    tag = np.where(mid["first"] == 1, "^", "")
    levels = ["l0", "l1", "l2"]
    n = mid.n.to_numpy(float)
    groups, f_counts, names = [], [], []
    end_tag = np.where(ends["first"] == 1, "^", "")
    for level in [*levels, "l3"]:
        if level == "l3":
            left, right = [x.l2.astype(str).str.replace("^[^|]*", "", regex=True) for x in (mid, ends)]
        else:
            left, right = pd.Series(tag, mid.index) + mid[level], pd.Series(end_tag, ends.index) + ends[level]
        codes, uniq = pd.factorize(pd.concat([left, right], ignore_index=True))
        groups.append(codes[: len(mid)])
        names.append(uniq)
        f_counts.append(np.bincount(codes[len(mid) :], weights=ends.n.to_numpy(float), minlength=len(uniq)))
    r_codes, r_names, s_counts = [], [], []
    for level in ("r1", "r2"):
        codes, uniq = pd.factorize(pd.concat([mid[level], starts[level]], ignore_index=True))
        r_codes.append(codes[: len(mid)])
        r_names.append(uniq)
        s_counts.append(np.bincount(codes[len(mid) :], weights=starts.n.to_numpy(float), minlength=len(uniq)))
    right = pd.concat([mid[["r1", "r2"]], starts[["r1", "r2"]]])  # a word's class: the greatest it was seen with
    cls = pd.Index(r_names[1]).get_indexer(right.groupby("r1").r2.max().reindex(r_names[0]))
    prior = np.array([_prior(a, b) for a, b in zip(mid.l2, mid.r2)])
    # start: a context that ends units about as often as boundaries do is one; so for words that start units
    n_units = max(float(ends.n.sum()), 1.0)
    rho = n_units / (n_units + float((prior * n).sum()))
    z = prior
    seen = np.bincount(groups[0], weights=n, minlength=len(names[0]))
    f0 = f_counts[0]
    share = (f0 + 2.0 * rho * 0.5) / (f0 + seen + 2.0) / rho
    zl = np.clip(share, 0.01, 0.99)[groups[0]]
    seen_r = np.bincount(r_codes[0], weights=n, minlength=len(r_names[0]))
    s0 = s_counts[0]
    zr = np.clip((s0 + rho) / (s0 + seen_r + 2.0) / rho, 0.01, 0.99)[r_codes[0]]
    odds = np.log(prior / (1 - prior)) * 0.5 + np.log(zl / (1 - zl)) + np.log(zr / (1 - zr))
    z = 1 / (1 + np.exp(-np.clip(odds, -8, 8)))
    for _ in range(rounds):
        p = None
        tables = [None] * 4
        for k in (3, 2, 1, 0):
            yes = np.bincount(groups[k], weights=z * n, minlength=len(names[k])) + f_counts[k]
            all_ = np.bincount(groups[k], weights=n, minlength=len(names[k])) + f_counts[k]
            w = np.bincount(groups[k], weights=n, minlength=len(names[k]))
            if p is None:  # the mark alone: what is expected of it, until there is evidence
                up = np.where(w > 0, np.bincount(groups[k], weights=prior * n, minlength=len(names[k])) / np.maximum(w, 1e-9), 0.9)
            else:  # parent probability of each key, averaged over its rows
                up = np.where(w > 0, np.bincount(groups[k], weights=p * n, minlength=len(names[k])) / np.maximum(w, 1e-9), 0.9)
            kappa = KAPPA if k < 3 else KAPPA * 10
            tables[k] = (yes + kappa * up) / (all_ + kappa)
            if k < 2:  # boundaries end units at the rate rho: a frequent context that never does is none
                tables[k] = np.minimum(tables[k], np.clip((f_counts[k] + 1.0) / (all_ * rho) * SLACK, 1e-4, 1.0))
            p = tables[k][groups[k]]
        a2 = np.bincount(r_codes[1], weights=z * n, minlength=len(r_names[1])) + s_counts[1]
        b2 = np.bincount(r_codes[1], weights=(1 - z) * n, minlength=len(r_names[1]))
        a2, b2 = (a2 + CLASS) / (a2.sum() + CLASS * len(a2)), (b2 + CLASS) / (b2.sum() + CLASS * len(b2))
        a1 = a1_raw = np.bincount(r_codes[0], weights=z * n, minlength=len(r_names[0])) + s_counts[0]
        b1 = np.bincount(r_codes[0], weights=(1 - z) * n, minlength=len(r_names[0]))
        sa, sb = a1.sum(), b1.sum()
        members = np.maximum(np.bincount(cls, minlength=len(r_names[1])), 1)
        a1 = (a1 + KAPPA * a2[cls] / members[cls] * 5) / (sa + KAPPA * 5)
        b1 = (b1 + KAPPA * b2[cls] / members[cls] * 5) / (sb + KAPPA * 5)
        odds = np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1)) + np.log(a1[r_codes[0]] / b1[r_codes[0]])
        z = 1 / (1 + np.exp(-np.clip(odds, -12, 12)))

    def kept(keys: np.ndarray, values: np.ndarray, weight: np.ndarray) -> dict:
        order = np.argsort(-weight, kind="stable")[:MAX_KEYS]
        return {keys[i]: float(values[i]) for i in order}

    end = [
        kept(names[k], tables[k], np.bincount(groups[k], weights=n, minlength=len(names[k])) + f_counts[k]) for k in range(4)
    ]
    weight = seen_r + s0
    start = [kept(r_names[0], a1, weight), kept(r_names[1], a2, np.ones(len(a2)))]
    inner = [kept(r_names[0], b1, weight), kept(r_names[1], b2, np.ones(len(b2)))]
    closed = pd.concat([pd.Series(z * n, mid.l1), pd.Series(ends.n.to_numpy(float), ends.l1)])
    closed.index = closed.index.str.replace(r"\|[^|]*$", "", regex=True)
    table = pd.DataFrame({
        "n": words.groupby("r1").n.sum(), "e": closed.groupby(level=0).sum(), "s": pd.Series(a1_raw, r_names[0]).groupby(level=0).sum(),
    }).fillna(0.0)
    total, e, st = table.n.sum(), table.e.sum(), table.s.sum()
    lower = table.groupby(LOWER + table.index.str.lower()).sum()
    parts = [x.rename_axis("w").reset_index().sort_values(["n", "w"], ascending=[False, True]).head(MAX_KEYS) for x in (table, lower)]
    return Model(end, start, inner, *word_tables(pd.concat(parts), total, e, st))


LOWER = "\x01"  # marks the keys without case, for units that have no capitals


def word_tables(table: pd.DataFrame, total: float, ends: float, starts: float) -> tuple[dict, float]:
    """``Model.words`` and ``Model.length`` from per-word occurrences n, boundaries after e and before s."""
    length = max(total / max(ends, 1.0), 2.0)
    n = table[["n", "e", "s"]].max(axis=1)
    p = (table.e + KAPPA / length) / (n + KAPPA)
    ratio = ((table.s + KAPPA * starts / max(total, 1.0)) / (starts + KAPPA)) / ((n - table.s + KAPPA) / (max(total - starts, 1.0) + KAPPA))
    out = dict(zip(table.w, zip(p.astype(float), ratio.astype(float))))
    return out, float(length)


def _logistic(odds: Column, bound: float) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(bound)), F.lit(-bound))))


def fit_types(types: DataFrame, rounds: int = 12) -> Model:
    """``fit`` over a table of types of any size: every round is one aggregation per kind of key, joined back to all types.

    Only tables of classes (shapes with marks, kinds of right words) reach the driver, besides the model.
    """
    spark = types.sparkSession
    tag = F.when(F.col("first") == 1, "^").otherwise("")
    tail = F.expr("substr(l2, instr(l2, '|'))")
    keys = [F.concat(tag, "l0").alias("k0"), F.concat(tag, "l1").alias("k1"), F.concat(tag, "l2").alias("k2"), tail.alias("k3")]

    @F.pandas_udf("double")
    def prior_of(l2: pd.Series, r2: pd.Series) -> pd.Series:
        return pd.Series([_prior(a, b) for a, b in zip(l2, r2)], dtype=float)

    keys.append(F.regexp_replace("l1", r"\|[^|]*$", "").alias("w"))
    seen = types.where(F.col("first") == _WORD).select(F.col("r1").alias("w"), F.col("n").cast("double").alias("n"))
    types = types.where(F.col("first") != _WORD)
    ends = materialize(types.where("r1 = '' and l2 <> ''").select(*keys, F.col("n").cast("double").alias("f")), "ends")
    starts = materialize(types.where("l2 = ''").select("r1", "r2", F.col("n").cast("double").alias("s")), "starts")
    is_mid = types.where("r1 <> '' and l2 <> ''")
    mid = materialize(is_mid.select(*keys, "r1", "r2", F.col("n").cast("double").alias("n"), prior_of("l2", "r2").alias("z")), "mid")
    weight, total = mid.agg(F.sum(F.col("z") * F.col("n")), F.count(F.lit(1))).first()
    if not total:
        return Model([{}, {}, {}, {}], [{}, {}], [{}, {}])
    n_units = max(ends.agg(F.sum("f")).first()[0] or 0.0, 1.0)
    rho = n_units / (n_units + weight)
    zero = F.lit(0.0)

    def left(rows: DataFrame, k: str, up: str | None) -> DataFrame:
        """Per key: yes (boundaries), w (rows), f (unit ends), pn (what the next level says, over its rows)."""
        pn = F.col(up) * F.col("n") if up else zero
        both = rows.select(k, (F.col("z") * F.col("n")).alias("yes"), F.col("n").alias("w"), zero.alias("f"), pn.alias("pn"))
        both = both.unionAll(ends.select(k, zero, zero, "f", zero))
        return both.groupBy(k).agg(*[F.sum(c).alias(c) for c in ("yes", "w", "f", "pn")])

    def right(rows: DataFrame) -> DataFrame:
        both = rows.select("r1", "r2", (F.col("z") * F.col("n")).alias("a"), ((1 - F.col("z")) * F.col("n")).alias("b"), zero.alias("s"))
        both = both.unionAll(starts.select("r1", "r2", zero, zero, "s"))
        return both.groupBy("r1").agg(F.max("r2").alias("cls"), *[F.sum(c).alias(c) for c in ("a", "b", "s")])

    def level(sums: DataFrame, k: str) -> DataFrame:
        up = F.when(F.col("w") > 0, F.col("pn") / F.greatest(F.col("w"), F.lit(1e-9))).otherwise(0.9)
        p = (F.col("yes") + F.col("f") + KAPPA * up) / (F.col("w") + F.col("f") + KAPPA)
        cap = F.greatest(F.least((F.col("f") + 1.0) / ((F.col("w") + F.col("f")) * rho) * SLACK, F.lit(1.0)), F.lit(1e-4))
        return sums.select(k, F.least(p, cap).alias("p"), (F.col("w") + F.col("f")).alias("weight"))

    share = F.greatest(F.least((F.col("f") + rho) / (F.col("f") + F.col("w") + 2.0) / rho, F.lit(0.99)), F.lit(0.01))
    word = F.greatest(F.least((F.col("s") + rho) / (F.col("s") + F.col("a") + F.col("b") + 2.0) / rho, F.lit(0.99)), F.lit(0.01))
    odds = F.log(F.col("z") / (1 - F.col("z"))) * 0.5 + F.log(F.col("zl") / (1 - F.col("zl"))) + F.log(F.col("zr") / (1 - F.col("zr")))
    first = mid.join(left(mid, "k0", None).select("k0", share.alias("zl")), "k0").join(right(mid).select("r1", word.alias("zr")), "r1")
    names = ["k0", "k1", "k2", "k3", "w", "r1", "r2", "n"]
    expected = mid.groupBy("k3").agg((F.sum(F.col("z") * F.col("n")) / F.sum("n")).alias("p")).toPandas()  # one row a mark
    expected = dict(zip(expected.k3, expected.p))
    rows = materialize(first.select(*names, _logistic(odds, 8.0).alias("z")), "mid")
    release(mid)
    words = right(rows).groupBy("cls").agg(F.count(F.lit(1)).alias("members")).toPandas()
    members = dict(zip(words.cls, words.members))
    for turn in range(rounds):
        low = left(rows, "k2", None).toPandas()
        low["k3"] = [k[k.index("|") :] for k in low.k2]
        top = low.groupby("k3")[["yes", "w", "f"]].sum()
        p3 = (top.yes + top.f + 10 * KAPPA * np.array([expected.get(k, 0.9) for k in top.index])) / (top.w + top.f + 10 * KAPPA)
        up = np.where(low.w > 0, p3.reindex(low.k3).to_numpy(), 0.9)
        low["p2"] = (low.yes + low.f + KAPPA * up) / (low.w + low.f + KAPPA)
        by_class = rows.select("r2", (F.col("z") * F.col("n")).alias("a"), ((1 - F.col("z")) * F.col("n")).alias("b"), zero.alias("s")).unionAll(starts.select("r2", zero, zero, "s"))
        two = by_class.groupBy("r2").agg(*[F.sum(c).alias(c) for c in ("a", "b", "s")]).toPandas()
        n_classes = len(two)
        two["a"] += two.s
        sa, sb = float(two.a.sum()), float(two.b.sum())
        two["a2"] = (two.a + CLASS) / (sa + CLASS * n_classes)
        two["b2"] = (two.b + CLASS) / (sb + CLASS * n_classes)
        share_of = [members.get(c, 1) for c in two.r2]
        two["a5"], two["b5"] = two.a2 / share_of * 5 * KAPPA, two.b2 / share_of * 5 * KAPPA
        shapes = F.broadcast(spark.createDataFrame(low[["k2", "p2"]]))  # one row a shape with its mark
        kinds = F.broadcast(spark.createDataFrame(two[["r2", "a5", "b5"]].rename(columns={"r2": "cls"})))  # one row a kind of right word
        with2 = rows.join(shapes, "k2")
        one = level(left(with2, "k1", "p2"), "k1")
        zeroth = level(left(rows.join(one.select("k1", F.col("p").alias("p1")), "k1"), "k0", "p1"), "k0")
        ratio = right(rows).join(kinds, "cls").select(
            "r1", ((F.col("a") + F.col("s") + F.col("a5")) / (sa + KAPPA * 5)).alias("a1"), ((F.col("b") + F.col("b5")) / (sb + KAPPA * 5)).alias("b1"),
            (F.col("a") + F.col("b") + F.col("s")).alias("weight"), (F.col("a") + F.col("s")).alias("starts"),
        )
        if turn == rounds - 1:
            break
        p = F.col("p")
        odds = F.log(F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6))) + F.log(F.col("a1") / F.col("b1"))
        found = rows.join(zeroth.select("k0", "p"), "k0").join(ratio.select("r1", "a1", "b1"), "r1")
        fresh = materialize(found.select(*names, _logistic(odds, 12.0).alias("z")), "mid")
        release(rows)
        rows = fresh

    # occurrences of every word, boundaries after it and before it; the last round's z as in ``fit``
    p = F.col("p")
    odds = F.log(F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6))) + F.log(F.col("a1") / F.col("b1"))
    last = rows.join(zeroth.select("k0", "p"), "k0").join(ratio.select("r1", "a1", "b1"), "r1")
    closed = last.select("w", (_logistic(odds, 12.0) * F.col("n")).alias("e")).unionAll(ends.select("w", "f"))
    of_words = (
        seen.select("w", "n", zero.alias("e"), zero.alias("s"))
        .unionAll(closed.select("w", zero, "e", zero))
        .unionAll(ratio.select(F.col("r1").alias("w"), zero, zero, "starts"))
        .groupBy("w")
        .agg(*[F.sum(c).alias(c) for c in "nes"])
    )
    of_words = materialize(of_words, "words")
    whole, n_ends, n_starts = of_words.agg(*[F.sum(c) for c in "nes"]).first()
    lower = of_words.groupBy(F.concat(F.lit(LOWER), F.lower("w")).alias("w")).agg(*[F.sum(c).alias(c) for c in "nes"])

    def kept(table: DataFrame, k: str, by: str = "weight") -> pd.DataFrame:
        return table.orderBy(F.desc(by), k).limit(MAX_KEYS).toPandas()

    k0, k1, r1 = kept(zeroth, "k0"), kept(one, "k1"), kept(ratio, "r1")
    table = pd.concat([kept(of_words, "w", "n"), kept(lower, "w", "n")])
    release(rows, ends, starts, of_words)
    end = [dict(zip(k0.k0, k0.p)), dict(zip(k1.k1, k1.p)), dict(zip(low.k2, low.p2)), p3.to_dict()]
    start, inner = [dict(zip(r1.r1, r1.a1)), dict(zip(two.r2, two.a2))], [dict(zip(r1.r1, r1.b1)), dict(zip(two.r2, two.b2))]
    return Model(end, start, inner, *word_tables(table, whole, n_ends, n_starts))


def train(docs: DataFrame) -> Model:
    """Model from the n-gram counts of all ``docs`` (text, source_type)."""
    types = materialize(ngram_counts(docs), "types")
    try:
        return fit(types.orderBy("l0", "l1", "l2", "r1", "r2", "first").toPandas()) if types.count() <= MAX_TYPES else fit_types(types)
    finally:
        release(types)


def share_model(spark, model: Model):
    """Broadcast of a model; its size is bounded by ``MAX_KEYS`` entries a table."""
    return spark.sparkContext.broadcast(zlib.compress(pickle.dumps((model.end, model.start, model.inner, model.words, model.length))))


def load_model(shared) -> Model:
    return Model(*pickle.loads(zlib.decompress(shared.value)))


def split(text: str, chat: bool, model: Model, ascii_marks: bool = True, lines: bool = False) -> list[tuple[int, int]]:
    """Sentences of one text as (start, end) code points, in order, without white space around them."""
    out: list[tuple[int, int]] = []
    thai, emoji = THAI.search(text) is not None, _EMOJI.search(text) is not None
    for a, b, body in units(text, chat, lines):
        begin = a
        if body < b:
            found, bare, final = gaps(text, a, b, body, ascii_marks, thai, emoji)
            cuts = [(g.end, g.start) for g, p in zip(found, model.posteriors(found, final)) if p > 0.5] if found else []
            if bare and b - body > 40:
                between, unspaced = word_gaps(text, body, b)
                cuts = [(x[0], x[1]) for x, p in zip(between, model.unmarked(between, unspaced)) if p > 0.5]
            for end, start in cuts:
                if end <= begin:
                    continue
                e = end
                while e > begin and text[e - 1].isspace():
                    e -= 1
                if e > begin:
                    out.append((begin, e))
                begin = start
        if begin < b:
            out.append((begin, b))
    return out


def sentences(docs: DataFrame, model: Model | None = None, ascii_marks: bool = True, with_text: bool = True) -> DataFrame:
    """Sentences of every row of (doc_id, text, source_type): doc_id, sentence_index (1-based), start_offset,
    end_offset, text. Null, empty and blank texts have none; a null source_type counts as plain text. Repeated rows
    give repeated results; other columns are ignored."""
    docs = docs.select("doc_id", "text", "source_type")
    docs = settled(docs, "doc_id") if model is None else spread(docs, "doc_id", per_core=1)
    model = train(docs) if model is None else model
    shared = share_model(docs.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load_model(shared)
        for pdf in batches:
            rows: list[tuple] = []
            for doc, text, kind in zip(pdf["doc_id"], pdf["text"], pdf["source_type"]):
                if text:
                    for i, (s, e) in enumerate(split(text, is_chat(kind), m, ascii_marks), 1):
                        rows.append((doc, i, s, e, text[s:e] if with_text else None))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["doc_id", "sentence_index", "start_offset", "end_offset", "text"])
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "sentence_index", "start_offset", "end_offset", "text"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"doc_id {id_type}, sentence_index int, start_offset long, end_offset long, text string")
