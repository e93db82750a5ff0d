"""Packing and mixing: validity on awkward tables, gain of the local search, shares reached."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeline.llm.catalog import QUERIES
from treeline.llm.mixing import mix
from treeline.llm.packing import fill_report, improve, next_fit, pack

SMALL = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_local_search_keeps_items_and_never_gets_worse(sizes):
    s = np.array(sizes)
    before = next_fit(s, 100)
    after = improve(s, before, 100)
    assert sorted(i for b in after for i in b) == list(range(len(s)))
    assert all(s[b].sum() <= 100 for b in after) and len(after) <= len(before)
    assert sum(int(s[b].sum()) ** 2 for b in after) >= sum(int(s[b].sum()) ** 2 for b in before)


def test_swaps_empty_containers():
    """From the unsorted fill the exchanges free containers, down to about the least possible number."""
    rng = np.random.default_rng(5)
    for low, capacity in ((1, 512), (1, 4096), (200, 512)):
        s = np.minimum(rng.gamma(1.2, 200, 3_000).astype(int) + low, capacity - 1)
        before = next_fit(s, capacity)
        after = improve(s, before, capacity)
        large = int((s > capacity / 2).sum())  # no two of these share a container
        assert len(after) <= max(-(-int(s.sum()) // capacity), large) * (1.001 if low == 1 else 1.06) + 1
        assert len(before) - len(after) > 0.03 * len(before)
    same = np.array([130] * 600 + [252, 122] * 100)  # a crowd of equal sizes hides no exchange
    assert len(improve(same, next_fit(same, 512), 512)) == 234  # three of 130 with each 122, two with each 252
    assert len(improve(np.full(50, 300), next_fit(np.full(50, 300), 512), 512)) == 50


def test_local_search_finds_the_exchange():
    s = np.array([60, 50, 50, 40])
    assert sorted(map(sorted, improve(s, [[0, 1 - 1]] and [[0], [1, 3], [2]], 100))) in ([[0, 3], [1, 2]],)


def test_pack_awkward(spark):
    rows = [(1, 0), (2, 25), (3, 10), (4, 10), (5, 5), (6, 7), (7, 30), (None, 5)] + [(i, 1 + i % 9) for i in range(10, 400)]
    items = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n_tokens long, fill string")
    limits = spark.createDataFrame([("ten", 10), ("bad", None), ("zero", 0), ("big", 4096)], "pack_name string, capacity_tokens int")
    got = pack(items, limits, group_items=50).toPandas()
    used = got[got.container_id.notna()]
    assert (used.groupby(["pack_name", "container_id"]).n_tokens.sum() <= used.groupby(["pack_name", "container_id"]).capacity.first()).all()
    total = sum(n for d, n in rows if d and n)
    assert used.groupby("pack_name").n_tokens.sum().to_dict() == {"ten": total, "big": total}
    assert sorted(used[(used.pack_name == "ten") & (used.doc_id == 2)].n_tokens) == [5, 10, 10]
    assert len(used[(used.pack_name == "big") & (used.doc_id == 2)]) == 1
    assert (used.groupby(["pack_name", "container_id"]).n_tokens.sum().values == used.groupby(["pack_name", "container_id"]).fill.first().values).all()
    assert len(got[got.container_id.isna()]) == 2
    tight = used[used.pack_name == "ten"]
    assert tight.container_id.nunique() <= 1.02 * total / 10 + 1
    assert pack(items.limit(0), limits).count() == 0


def test_packing_query(spark):
    report = fill_report(QUERIES["p6_packing"](spark, SMALL)).collect()
    assert len(report) == 4 and all(r.n_containers <= r.least_containers + 1 for r in report)


DOCS = "doc_id long, text string, source string, n_tokens string"


def test_mix_awkward(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 60))), rng.choice(["one", " ONE", "two", "two-x", "out", None]), "x") for i in range(900)]
    rows += [(9000 + i, rows[0][1], rows[0][2], "x") for i in range(5)] + [(9100, None, "one", "x"), (9101, "", "one", "x"), (None, "text", "one", "x")]
    targets = spark.createDataFrame([("one", 3.0, 2), ("two", 1.0, 1), ("two_x", 1.0, 3), ("gone", 2.0, 1), ("null", None, 4), ("none", 1.0, None)], "source string, target_weight double, max_repeats int")
    chosen, report = mix(spark.createDataFrame(rows, DOCS), targets)
    rep = {r.source: r for r in report.collect()}
    for s, share in {"one": 0.6, "two": 0.2, "two_x": 0.2}.items():
        assert abs(rep[s].actual_share - share) < 0.02 and abs(rep[s].reachable_share - share) < 1e-9 and rep[s].most_copies <= rep[s].max_repeats
    assert rep["gone"].actual_share == rep["null"].target_share == 0 and abs(rep["gone"].target_share - 2 / 8) < 1e-9
    got = chosen.collect()
    texts = {r[0]: r[1] for r in rows}
    assert len({texts[r.doc_id] for r in got}) == len(got) and {r.source for r in got} == {"one", "two", "two_x"}
    chosen, report = mix(spark.createDataFrame([], DOCS), targets)
    assert chosen.count() == 0 and report.count() == 6


def test_mix_query(spark):
    report = QUERIES["p7_report"](spark, SMALL)
    assert report.count() == 43 and abs(report.agg(F.sum("actual_share")).first()[0] - 1) < 1e-6
