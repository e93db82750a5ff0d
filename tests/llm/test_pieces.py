"""Splitting: limits, overlaps, coverage; ranges and files give what one pass gives."""

import pandas as pd
import pytest

from treeline.llm.catalog import QUERIES
from treeline.llm.pieces import file_ranges, pieces, range_ends, split_items, text_of, text_ranges
from treeline.llm.sentences import train

LIMITS = [("vector", 60, 10), ("relay", 40, 0)]


@pytest.fixture(scope="module")
def text():
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    return "\n\n".join(t for t in docs.text if t).strip()


def rows_of(df):
    return [(r.start, r.end, r.text) for r in df.orderBy("piece_no").collect()]


def test_ranges_and_files_cover_the_text(spark, text, tmp_path):
    sample = spark.createDataFrame([(1, text, "txt")], "doc_id long, text string, source_type string")
    model = train(sample)
    items = spark.createDataFrame([("i", text, 400, 40)], "item string, text string, max_chars int, overlap_chars int")
    whole = rows_of(pieces(text_ranges(items), model))
    small = rows_of(pieces(text_ranges(items, 5_000, 2_000), model, 2_000))
    for got in (whole, small):
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(b - a <= 400 and text[a:b] == t for a, b, t in got)
        assert all(nxt[0] == prev[1] - 40 for prev, nxt in zip(got, got[1:]))
    path = tmp_path / "giant.txt"
    path.write_bytes(text.encode())
    by_file = rows_of(pieces(file_ranges(spark, [(str(path), path.stat().st_size)], 400, 40, 6_000, 4_000), model, 2_000))
    assert by_file[0][0] == 0 and by_file[-1][1] == len(text)
    assert all(b - a <= 400 and text[a:b] == t for a, b, t in by_file)
    assert all(nxt[0] == prev[1] - 40 for prev, nxt in zip(by_file, by_file[1:]))


def test_multibyte_file_with_the_tightest_limit(spark, tmp_path):
    """The halo counts code points: no text is lost where characters take three bytes and the limit is half the halo."""
    text = "\n".join("山" * 3_400 + "。" for _ in range(40))
    path = tmp_path / "wide.txt"
    path.write_bytes(text.encode())
    sample = spark.createDataFrame([(1, text[:8_000], "txt")], "doc_id long, text string, source_type string")
    got = rows_of(pieces(file_ranges(spark, [(path.as_uri(), path.stat().st_size)], 4_000, 100), train(sample)))
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= 4_000 and t and text[a:b] == t for a, b, t in got)
    assert all(nxt[0] == prev[1] - 100 for prev, nxt in zip(got, got[1:]))


def test_formula_over_ranges(spark):
    """A formula that straddles ranges, or spans several, is one sentence; what follows it is split as in one pass."""
    plain = "One short sentence here. And another one follows it. "
    text = plain * 150 + "$$" + "a + b. " * 3_000 + "$$ " + plain * 200 + "$$ x. y. $$$$ z. $$ " + plain * 150 + "$$ not closed. " + plain * 30
    text = text.strip()
    sample = spark.createDataFrame([(1, plain * 50, "txt")], "doc_id long, text string, source_type string")
    model = train(sample)
    items = spark.createDataFrame([("i", text, 400, 0)], "item string, text string, max_chars int, overlap_chars int")
    want, longest = range_ends(text, 0, 0, len(text), True, model)
    for size, halo in ((5_000, 2_000), (7_001, 1_000)):
        got = pieces(text_ranges(items, size, halo), model, halo).collect()
        assert {r.longest for r in got} == {longest}
        ends = {r.end for r in got}
        inside = range(text.index("$$") + 1, text.index("$$ One") + 2)
        assert all(e in want or e in inside for e in ends)
        narrow = pieces(text_ranges(items, size, halo), model, halo, with_text=False).collect()
        assert sorted((r.piece_no, r.start, r.end) for r in narrow) == sorted((r.piece_no, r.start, r.end) for r in got)


def test_giant_item_equals_its_ranges(spark, text):
    """A giant column value goes through ranges and is whole; a piece that leaves its slice raises."""
    giant = (text + "\n") * (1 + 150_000 // len(text))
    df = spark.createDataFrame([(1, giant, "vector"), (2, text[:5_000], "vector")], "item_id long, text string, import_mode string")
    limits = spark.createDataFrame([("vector", 1_000, 50)], "import_mode string, max_chars int, overlap_chars int")
    for i, own in ((1, giant.strip()), (2, text[:5_000].strip())):
        got = sorted((r.piece_no, r.start_offset, r.end_offset, r.text) for r in split_items(df, limits).where(f"item_id = {i}").collect())
        assert [r[0] for r in got] == list(range(1, len(got) + 1)) and got[-1][2] - got[0][1] == len(own)
        assert all(b[1] == a[2] - 50 for a, b in zip(got, got[1:]))
    with pytest.raises(RuntimeError):
        text_of("abc", 10, 9, 12)


def test_items(spark):
    rows = [
        (1, "  " + "One short sentence here. " * 8, None, "x"), (1, "  " + "One short sentence here. " * 8, None, "x"), (2, "x" * 205, " VECTOR", "x"), (3, None, "vector", "x"), (4, "", "vector", "x"),
        (5, "short", "vector", "x"), (6, "word " * 30, "nomode", "x"), (7, "a line of words\n" * 9, "Relay", "x"), (None, "y" * 900, "vector", "x"), (8, " " * 300 + "tiny" + " " * 300, "vector", "x"),
    ]
    df = spark.createDataFrame(rows, "item_id long, text string, import_mode string, mode string")
    limits = spark.createDataFrame(LIMITS, "import_mode string, max_chars int, overlap_chars int")
    got = split_items(df, limits).collect()
    kinds = {r.item_id: r.cut_kind for r in got}
    assert kinds == {1: "natural", 2: "forced", 7: "natural"}
    source = {r[0]: r[1] for r in rows if r[0]}
    for i, (top, lap) in {1: (60, 10), 2: (60, 10), 7: (40, 0)}.items():
        own = sorted((r.piece_no, r.start_offset, r.end_offset, r.text) for r in got if r.item_id == i)
        t = source[i]
        assert own[0][1] == len(t) - len(t.lstrip()) and own[-1][2] == len(t.rstrip())
        assert all(e - s <= top and t[s:e] == x for _, s, e, x in own)
        assert all(b[1] == a[2] - lap for a, b in zip(own, own[1:]))
    assert split_items(df.limit(0), limits).count() == 0


def test_queries_run(spark):
    found = QUERIES["p5_found"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["item_id", "cut_kind"] and found.count() == found.select("item_id").distinct().count()
