"""Sentence segmentation: rules that always hold, the trained model, awkward texts."""

import pandas as pd
import pytest
from collections import Counter
from pyspark.sql import functions as F

from treeline.llm.boundaries import count_words, gaps, units, word_key
from treeline.llm.catalog import QUERIES
from treeline.llm.sentences import Model, _count, fit, sentences, split, train

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["l0", "l1", "l2", "r1", "r2", "first", "n"]


@pytest.fixture(scope="module")
def model():
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    c, words = Counter(), Counter()
    for text, kind in zip(docs.text, docs.source_type):
        if text:
            _count(text, kind == "chat", c)
            count_words(text, words)
    for w, n in words.items():
        if word_key(w):
            c[("", "", "", word_key(w), "", 9)] += n
    return fit(pd.DataFrame([(*k, n) for k, n in c.items()], columns=COLUMNS))


def cut(text, model, kind="txt", **kw):
    return [text[a:b] for a, b in split(text, kind == "chat", model, **kw)]


CASES = [
    ("txt", "Dr. Orrel read 3.14 pages. He left the U.S. The job ran until 4:14 p.m. It is in Vol. II of the deed box.", ["Dr. Orrel read 3.14 pages.", "He left the U.S.", "The job ran until 4:14 p.m.", "It is in Vol. II of the deed box."]),
    ("txt", "“Wait!” Tamsin shouted; nobody did. Lowick asked, “Why? Who moved it? And when?” and got no reply.", ["“Wait!” Tamsin shouted; nobody did.", "Lowick asked, “Why? Who moved it? And when?” and got no reply."]),
    ("txt", "他说：“别改名！”然后离开了。嗯……记忆卷大概正在复核。（词汇表是空的。）停！", ["他说：“别改名！”然后离开了。", "嗯……记忆卷大概正在复核。", "（词汇表是空的。）", "停！"]),
    ("md", "# Title. Part\ntext goes\non here. Next one\n\n- a. b\n- c\n1. one. Two it is.\n", None),
    ("chat", "Ann: Stop! 🎉 Why?\nBen: no mark\n", ["Ann: Stop! 🎉", "Why?", "Ben: no mark"]),
    ("txt", "$$ f(x) = 1. y! $$", ["$$ f(x) = 1. y! $$"]),
    ("txt", "รายงานนำเข้าถูกสร้างใหม่แล้ว คู่มือปั๊มมี 36 หน้า กรุณาส่ง", ["รายงานนำเข้าถูกสร้างใหม่แล้ว", "คู่มือปั๊มมี 36 หน้า", "กรุณาส่ง"]),
    ("txt", "Use `a.b! C` or $x. y$ now! Stop!", ["Use `a.b! C` or $x. y$ now!", "Stop!"]),
    ("txt", "Ποιος το μετακίνησε; Σταμάτα!", ["Ποιος το μετακίνησε;", "Σταμάτα!"]),
    ("txt", "", []), ("txt", " \r\n\t\n", []), ("txt", "no mark at all", ["no mark at all"]),
]


@pytest.mark.parametrize("kind,text,want", CASES)
def test_cases(model, kind, text, want):
    got = cut(text, model, kind)
    if want is not None:
        assert got == want
    for s in got:
        assert s == s.strip() and s in text


def test_lines_and_marks():
    text = "# Head\nwrapped\nline. \r\n\r\n* item\nplain"
    assert [text[a:b] for a, b, _ in units(text, False)] == ["# Head", "wrapped\nline.", "* item", "plain"]
    assert [text[a:b] for a, b, _ in units(text, False, lines=True)] == ["# Head", "wrapped", "line.", "* item", "plain"]


def test_without_ascii_marks(model):
    text = "One. Two! 三。四！"
    assert cut(text, model, ascii_marks=False) == ["One. Two! 三。", "四！"]


UNMARKED = {
    "en": "the pump manual was loaded twice nobody signed the node list the harvest record is empty this needs another reading the lease file was rebuilt " * 5,
    "ja": "目次は再構築されたノード一覧の節を見よ目次は原文と一致しない" * 6,
    "zh": "词汇表放错了文件夹请在之前把值班表交给林若川值班表增加了三分之一种子登记册没有人签字" * 6,
}


def test_text_without_punctuation_is_split_by_the_model(model):
    """No mark anywhere: boundaries stand between words (characters), and a short line stays whole."""
    for name, text in UNMARKED.items():
        got = cut(text, model)
        assert len(got) > 5 and "".join(got).replace(" ", "") == text.replace(" ", ""), name
    assert "目次は再構築された" in cut(UNMARKED["ja"], model)
    assert cut("the pump manual was loaded twice nobody signed", model) == ["the pump manual was loaded twice nobody signed"]
    assert cut("One, " + UNMARKED["en"], model) == [("One, " + UNMARKED["en"]).strip()]  # a mark shows that marks are set


def test_unmarked_follows_the_sum_over_whole_paths():
    from itertools import product

    from treeline.llm.sentences import HAZARD

    m = Model([{}] * 4, [{}, {}], [{}, {}], {"A": (0.2, 2.0), "B": (0.6, 0.5), "C": (0.1, 3.0)}, 1.0)
    words = "A B C A C B A B C A B".split()
    between = [(i, i + 1, x, y) for i, (x, y) in enumerate(zip(words, words[1:]))]
    for unspaced in (False, True):
        hazard, total, want = HAZARD[unspaced], 0.0, [0.0] * len(between)
        for path in product((0, 1), repeat=len(between)):
            p, d = 1.0, 0
            for (_, _, x, y), cut_here in zip(between, path):
                e = m.words[x][0] * hazard[d]
                p *= e * m.words[y][1] if cut_here else 1 - e
                d = 0 if cut_here else min(d + 1, len(hazard) - 1)
            total += p
            want = [w + p * x for w, x in zip(want, path)]
        weight = 1 / (1 + 100 * 2.718281828459045 ** -len(between))
        assert m.unmarked(between, unspaced) == pytest.approx([weight * w / total for w in want], abs=1e-9)


def test_thai_spaces_are_decided_by_the_model():
    text = "รายงานนำเข้าถูกสร้างใหม่แล้ว คู่มือปั๊มมีหน้า กรุณาส่ง"
    (a, b, body), = units(text, False)
    found, bare, final = gaps(text, a, b, body)
    assert len(found) == 2 and not bare and final and all("␣" in g.keys[2] for g in found)
    never = Model([{}, {}, {}, {"|␣": 0.01}], [{}, {}], [{}, {}])
    assert cut(text, never) == [text] and len(cut(text, Model([{}] * 4, [{}, {}], [{}, {}]))) == 3


def test_odd_right_contexts():
    from treeline.llm.boundaries import first_word

    assert first_word("((•" + " " * 40 + "x", 0) == ("((•", "(o") and first_word("3 days.", 0) == ("0 days", "0")
    assert first_word("!", 0) == ("!", "sym") and first_word("“Ab12, x", 0) == ("“Ab0", "“U")


def test_sentence_marks_of_further_scripts():
    m = Model([{}] * 4, [{}, {}], [{}, {}])
    for mark in "။។።։།":
        assert len(cut(f"ကခဂ{mark} ငစဆ{mark}", m)) == 2, mark


def test_operator_on_awkward_rows(spark, model):
    long = "A sentence of some words. " * 20_000
    rows = [(1, None, "txt", "x"), (2, "", "md", "x"), (3, "One here. Two here.", None, "x"), (3, "One here. Two here.", None, "x"), (4, long, "CHAT", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source_type string, sentence_index string")
    got = {r.doc_id: r["count"] for r in sentences(df, model).groupBy("doc_id").count().collect()}
    assert got == {3: 4, 4: 20_000}
    empty = df.limit(0)
    assert sentences(empty, train(empty)).count() == 0
    assert fit(pd.DataFrame(columns=COLUMNS)).end == [{}, {}, {}, {}]
    assert cut("One here. Two here!", Model([{}] * 4, [{}, {}], [{}, {}])) == ["One here.", "Two here!"]


def test_queries_run(spark):
    found = QUERIES["p3_found"](spark, SMALL)
    assert found.columns == ["doc_id", "start_offset", "end_offset"] and found.count() == found.distinct().count() > 500
    both = QUERIES["p3_sentences"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.col("text").alias("whole"))
    wrong = both.join(docs, "doc_id").where(F.substring("whole", F.col("start_offset").cast("int") + 1, (F.col("end_offset") - F.col("start_offset")).cast("int")) != F.col("text"))
    assert wrong.count() == 0


def test_every_type_counts_beyond_the_driver_bound(spark, monkeypatch):
    from treeline.llm import sentences as module

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    types = module.ngram_counts(docs).toPandas()
    want = fit(types)
    monkeypatch.setattr(module, "MAX_TYPES", 1000)
    assert len(types) > 1000
    got = train(docs)
    for a, b in zip([*got.end, *got.start, *got.inner], [*want.end, *want.start, *want.inner]):
        assert a == pytest.approx(b, rel=1e-6)
    assert got.length == pytest.approx(want.length, rel=1e-6) and set(got.words) == set(want.words)
    assert all(got.words[w] == pytest.approx(want.words[w], rel=1e-5) for w in want.words)


def test_smoothing_follows_the_sum_over_whole_paths(model):
    from itertools import product

    text = "Well ... the branch came back empty. OK? Well ... no. Stop! Ah... Yes. Hm."
    (a, b, body), = units(text, False)
    found, _, final = gaps(text, a, b, body)
    total, want = 0.0, [0.0] * len(found)
    for path in product((0, 1), repeat=len(found)):
        p = 1.0
        for i, g in enumerate(found):
            e, s, q = model.parts(g.keys, int(g.first == 1 or (g.first == 2 and path[i - 1])))
            p *= e * s if path[i] else (1 - e) * q
        p *= model.closing(*final[:3], "", int(final[3] == 1 or (final[3] == 2 and path[-1])))
        total += p
        want = [w + p * x for w, x in zip(want, path)]
    assert any(g.first == 2 for g in found) and final[3] == 2
    assert model.posteriors(found, final) == pytest.approx([w / total for w in want], abs=1e-9)


def test_a_gap_is_decided_by_the_word_after_the_next_one():
    from treeline.llm.boundaries import Gap

    end = {"a|.": 0.3, "b|…": 0.2, "^b|…": 0.9}
    m = Model([end, {}, {}, {}], [{"w": 0.1, "x": 0.1}, {}], [{"w": 0.1, "x": 0.01}, {}])
    chained = [Gap(2, 3, ("a|.", "", "w|.", "w", "l"), 0), Gap(5, 6, ("b|…", "", "w|…", "x", "l"), 2)]
    assert m.posteriors(chained)[0] == pytest.approx(2.73 / 4.69)  # 0.3 without what follows
