"""Abuse scorer: disguises, trees, calibration, held-out accuracy, awkward rows."""

import numpy as np
import pandas as pd

from treeline.llm import abuse
from treeline.llm.boost import Trees, isotonic
from treeline.llm.catalog import QUERIES
from treeline.llm.lexicon import inner_marks, plain

SF = "/root/testdata/sf0.01"


def test_disguises_are_undone():
    for raw, want in {
        "you id­i​ot": "you idiot", "m o r o n here": "moron here", "a m·o·r·o·n": "a moron", "a h a l f w i t": "a halfwit", "fuсking": "fucking", "1d10t": "idiot", "moooooron": "moron", "what a b*****d": "what a  maskedword ",
    }.items():
        got, n = plain(raw)
        assert got == want and n > 0, raw
    assert inner_marks("白-痴 dumb-ass")[0] == "白痴 dumbass"
    assert plain("index.v2.json A7 3.14 plain words")[1] == 0


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-3 * ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)) + 1.5))
    y = (rng.random(3000) < p).astype(float)
    t = Trees().fit(x[:2000], y[:2000], np.ones(2000))
    s = t.predict(x[2000:])
    hit = (s > 0) == (p[2000:] > 0.5)
    assert hit.mean() > 0.95
    xs, ys = isotonic(s, y[2000:], np.ones(1000))
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= -1e-12).all() and 0 <= ys.min() and ys.max() <= 1


def test_held_out_accuracy(spark):
    """Trained on two thirds of the labelled documents, at least 90 % of the agreed labels of the rest are met."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/review_labels.parquet")
    votes = abuse.votes(labels).toPandas()
    held = votes[(votes.doc_id % 3 == 0) & (votes.raters >= 2) & votes.share.isin([0.0, 1.0])]
    known = labels.where("doc_id % 3 <> 0")
    rated = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = abuse.score_documents(rated, known).toPandas().merge(held, on="doc_id")
    assert len(scored) > 60
    assert (scored.flagged == (scored.share == 1.0)).mean() >= 0.9


def test_awkward_rows(spark):
    rows = [(1, None, "txt", "a", "x"), (2, "", None, None, "x"), (3, "You are an idiot! " * 3000, "txt", " A", "x"), (4, "The archive is open. 🙂", "chat", "a-b", "x"), (4, "The archive is open. 🙂", "chat", "a-b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source_type string, source string, score string")
    none = spark.createDataFrame([(3, "r", None, None), (None, "r", "ok", None)], "doc_id long, rater string, label string, labelled_at timestamp_ntz")
    got = {r.doc_id: r for r in abuse.score_documents(docs, none).collect()}
    assert got[1].score == got[2].score == 0 and not got[1].flagged and got[3].score > got[4].score
    scored = abuse.score_documents(docs, none)
    assert {r.source for r in abuse.source_rates(docs, scored).collect()} == {"a", "a_b", None}
    assert abuse.score_documents(docs.limit(0), none).count() == 0


def test_votes(spark):
    rows = [(1, "r", "OK ", "2024-01-01"), (1, "r", "abusive", "2024-01-02"), (1, "r", "abusive", "2024-01-02"), (1, "s", "ok", None), (2, "r", None, None)]
    got = abuse.votes(spark.createDataFrame(rows, "doc_id long, rater string, label string, labelled_at string")).toPandas()
    assert got.values.tolist() == [[1, 0.5, 2]]
    assert isinstance(got, pd.DataFrame)


def test_queries_run(spark):
    assert QUERIES["p8_found"](spark, "/root/testdata/sf0.001").columns == ["doc_id"]
    assert QUERIES["p8_rates"](spark, "/root/testdata/sf0.001").count() > 0
