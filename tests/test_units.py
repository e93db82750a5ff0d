"""Pure functions, readers, folds and streams on small inputs."""

import io
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeline.functions.split import spans
from treeline.functions.textdiff import note_parts, text_diff, with_generated
from treeline.operators import documents as D
from treeline.operators.index import require_complete, upsert
from treeline.operators.oplog import Tree
from treeline.operators.search import closure, terms_of
from treeline.operators.sqlread import read_only_sql
from treeline.sources import files, markdown, pdf
from treeline.streaming import volumes
from treeline.streaming.late import late_volumes, maintenance_due


def cut(text, **kw):
    return [text[a:b] for a, b in spans(text, **kw)]


@pytest.mark.parametrize(
    "text,kw,want",
    [
        ("一。二！三？", {}, ["一。", "二！", "三？"]),
        ("A. B! c", {}, ["A. B! c"]),
        ("A. B! c", {"ascii_marks": True}, ["A.", "B!", "c"]),
        ("U.S is 3.14 big... yes", {"ascii_marks": True}, ["U.S is 3.14 big...", "yes"]),
        ("见`a。b`和$x。y$。好", {}, ["见`a。b`和$x。y$。", "好"]),
        ("前$$a。b$$后。", {}, ["前", "$$a。b$$", "后。"]),
        ("前$$a。b", {}, ["前", "$$a。b"]),
        ("(a. b) c. d", {"ascii_marks": True}, ["(a. b) c.", "d"]),
        ("“好。”他说", {}, ["“好。”", "他说"]),
        ("a\nb", {"hard_breaks": True}, ["a", "b"]),
        ("a\nb", {}, ["a\nb"]),
        ("---- | ---", {}, []),
        ("", {}, []),
    ],
)
def test_rule_spans(text, kw, want):
    assert cut(text, **kw) == want


@settings(max_examples=150, deadline=None)
@given(st.text("abc \n", max_size=40), st.text("abc \n", max_size=40))
def test_text_diff_rebuilds_and_is_shortest(a, b):
    d = text_diff(a, b)
    assert "".join(t for k, t in d if k != "ins") == a and "".join(t for k, t in d if k != "del") == b
    assert all(x[0] != y[0] for x, y in zip(d, d[1:]))
    table = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(table[j - 1] if x == y else 1 + min(table[j], row[-1]))
        table = row
    assert sum(len(t) for k, t in d if k != "equal") == table[-1]


def test_text_diff_limit_and_notes():
    assert text_diff("x" * 50 + "a" * 30, "x" * 50 + "b" * 30, 10) == [("equal", "x" * 50), ("del", "a" * 30), ("ins", "b" * 30)]
    assert text_diff(None, "") == []
    note = with_generated("by hand", "made")
    assert note_parts(note) == [("by hand", False), ("made", True)] and note_parts(with_generated(None, " ")) == []
    assert note_parts(note.replace("-->", "-->", 1).rsplit("<!--", 1)[0]) == [("by hand", False), ("made", True)]


def test_markdown_blocks_and_tree():
    text = "# A\npara one\nmore\n\n```py\n# no heading\n```\n- x\n- y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n## B\n> q\n\n$$\nx\n$$\n![i](p.png)\n---\n<table>\n<tr></tr>\n</table>\n"
    kinds = [(k, lv) for k, lv, *_ in markdown.blocks(text)]
    assert kinds == [("heading", 1), ("paragraph", 0), ("code", 0), ("list", 0), ("table", 0), ("heading", 2), ("quote", 0), ("math", 0), ("image", 0), ("table", 0)]
    assert all(text[s:e].strip() for _, _, s, e, _ in markdown.blocks(text))
    assert [a for a, *_ in markdown.tree_records(text)] == ["1-1", "1-1-1", "1-1-2", "1-1-3", "1-1-4", "1-1-5", "1-1-5-1", "1-1-5-2", "1-1-5-3", "1-1-5-4"]
    assert markdown.plain_text("## T\n**b** _i_ [l](u) `c` $\\alpha \\le \\frac{1}{2}$") == "T\nb i l c α ≤ 1/2"
    assert markdown.image_sources("![a](b.png) ![c](d)") == ["b.png", "d"]


def zipped(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_office_readers():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    doc = f'<w:document {w}><w:body>{p("Title", "<w:outlineLvl w:val=\"0\"/>")}{p("body")}{p("Sub", "<w:pStyle w:val=\"h2\"/>")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    styles = f'<w:styles {w}><w:style w:styleId="h2"><w:name w:val="heading 2"/></w:style></w:styles>'
    assert files.docx_records(zipped({"word/document.xml": doc, "word/styles.xml": styles})) == [("1-1", "Title", ""), ("1-1-1", "", "body"), ("1-1-2", "Sub", ""), ("1-1-2-1", "", "a | b")]
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {m}><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>9</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>'
    assert files.xlsx_records(zipped({"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {m}><si><t>head</t></si><si><t>one</t></si></sst>"})) == [("1-1", "", "one"), ("1-2", "", "in")]
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c" href="c.xhtml"/><item id="d" href="d.xhtml"/></manifest><spine><itemref idref="d"/><itemref idref="c"/></spine></package>'
    book = zipped({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/x.opf"/></rootfiles></container>', "O/x.opf": opf, "O/c.xhtml": "<h1>C</h1><p>c</p>", "O/d.xhtml": "<h1>D</h1><p>d &amp; e</p>"})
    assert files.epub_records(book) == [("1-1", "D", ""), ("1-1-1", "", "d & e"), ("1-2", "C", ""), ("1-2-1", "", "c")]


def test_text_readers():
    assert files.decode("中文".encode("gb18030")) == "中文" and files.decode("é".encode("utf-16")) == "é" and files.decode(b"\xef\xbb\xbfa") == "a"
    assert files.csv_records(b'name,text\n1,"a ""q"", b"\n2,c\n') == [("1-1", "", 'a "q", b'), ("1-2", "", "c")]
    assert files.csv_vectors(b"1,a,x,0.5,2\n2,b,x,no\n") == [[0.5, 2.0], None]
    lines = [
        '{"type":"user","message":{"content":"hi"}}', "broken", '{"type":"user","isMeta":true,"message":{"content":"m"}}', '{"type":"user","message":{"content":"<system-reminder>x"}}', '[1]',
        '{"type":"assistant","message":{"content":[{"type":"text","text":"yo"},{"type":"tool_use","name":"t","input":{"a":1}}]}}', '{"type":"user","message":{"role":"assistant","content":"<b>kept"}}', '{"message":{"role":"user","content":"no type"}}',
    ]
    assert files.transcript_records("\r\n".join(lines).encode()) == [("1-1", "user", "hi"), ("1-2", "assistant", "yo"), ("1-2-1", "t", '{"a": 1}'), ("1-3", "user", "<b>kept")]
    code = "import a\nfrom b import c\nx = 1\nif x:\n    y = 2\nelse:\n    y = 3\nfor i in x:\n    pass\n"
    assert [(a, t) for a, t, _ in files.python_records(code.encode())] == [("1-1", "IMPORT"), ("1-2", "TEXT"), ("1-3", "IF"), ("1-3-1", "TEXT"), ("1-3-2", "ELSE") if False else ("1-4", "ELSE"), ("1-4-1", "TEXT"), ("1-5", "FOREACH"), ("1-5-1", "TEXT")]
    assert files.html_blocks("<h2>T</h2><p>a<br>b</p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>") == [("heading", 2, "T"), ("paragraph", 0, "a b"), ("table", 0, "1 | 2")]
    assert files.decode_entities("&lt;&#65;&unknown;") == "<A&unknown;"
    with pytest.raises(ValueError):
        files.reader_for("x.csv", "relay")


def test_broken_files_are_rows(spark):
    df = spark.createDataFrame([("a.docx", b"no zip"), ("b.txt", "一。二。".encode()), ("c.bin", b"x")], "path string, content binary")
    got = {(r.path, r.record_no): r.text for r in files.parse_files(df).collect()}
    assert got == {("a.docx", 0): None, ("b.txt", 1): "一。", ("b.txt", 2): "二。", ("c.bin", 0): None}


def test_pdf_pages(spark):
    item = lambda x, y, t, h=10.0, w=40.0: {"x": float(x), "x1": float(x + w), "y0": float(y), "y1": float(y + h), "text": t, "bold": False}
    columns = [item(50, 20.0 * i, f"L{i}", w=200) for i in range(1, 8)] + [item(350, 20.0 * i, f"R{i}", w=200) for i in range(1, 8)] + [item(50, 0, "Top", 16, 500)]
    got = [ln["text"] for ln in pdf.page_lines(columns, 600)]
    assert got == ["Top"] + [f"L{i}" for i in range(1, 8)] + [f"R{i}" for i in range(1, 8)]
    assert [ln["text"] for ln in pdf.page_lines([item(0, 0, "中"), item(60, 1, "文"), item(120, 0, "a"), item(200, 0, "b")], 600)] == ["中文 a b"]
    rows = [("f", 1, 600.0, i["x"], i["y0"], i["x1"], i["y1"], i["text"], False) for i in columns]
    df = spark.createDataFrame(rows, "path string, page int, page_width double, x double, y0 double, x1 double, y1 double, text string, bold boolean")
    table = pdf.lines(df)
    assert [(r.line_no, r.level) for r in pdf.headings(table).collect()] == [(1, 1)]
    body = [("f", 1, 600.0, 50.0, y, 250.0, y + 10, t, False) for y, t in ((40.0, "one"), (52.0, "two"), (120.0, "three"), (140.0, "12"))] + [("f", 1, 600.0, 50.0, 0.0, 250.0, 16.0, "Top", False), ("f", 2, 600.0, 50.0, 0.0, 250.0, 10.0, "four", False)]
    small = pdf.lines(spark.createDataFrame(body, df.schema))
    blocks = pdf.paragraphs(small, pdf.headings(small)).orderBy("block_no").collect()
    assert [(r.type, r.level, r.text) for r in blocks] == [("heading", 1, "Top"), ("paragraph", 0, "one\ntwo"), ("paragraph", 0, "three"), ("paragraph", 0, "four")]
    assert pdf.paragraphs(small.limit(0), pdf.headings(small.limit(0))).count() == 0 and pdf.page_lines([], 600) == []
    assert pdf.unbroken("中\n文\nand\nso.") == "中文 and so." and pdf.image_only("few", 3)
    assert pdf.outline_positions("x\nA  B\n", [("A B", 0), ("x", 0)]) == [("A B", 2, 6), ("x", 0, 1)]


def test_tree_fold_against_lists():
    rng = random.Random(5)
    for _ in range(60):
        ids = [f"n{i}" for i in range(12)]
        rows = [{"id": "r", "parent_id": None, "sort_order": 1, "text": "r"}] + [{"id": x, "parent_id": rng.choice(["r", *ids[:i]]), "sort_order": i, "text": x} for i, x in enumerate(ids)]
        tree = Tree(rows)
        for k in range(40):
            a, b = rng.choice(ids), rng.choice(["r", *ids])
            kind = rng.choice(["node.move", "node.promote", "node.reparent", "node.moveBefore", "node.moveAfter", "node.mergeInto", "node.mergePrevious", "node.delete", "node.insert", "node.split", "node.update"])
            tree.apply(kind, {"node": f"x{k}" if kind == "node.insert" else a, "target": b, "parent": b, "after": a, "direction": rng.choice(["up", "down"]), "sentences": ["p", "q"], "new_ids": [f"s{k}"], "fields": {"text": "u"}})
            out = tree.rows()
            assert sorted(r["id"] for r in out) == sorted(tree.data) and len({r["address"] for r in out}) == len(out)
            assert {r["id"]: r["parent_id"] for r in out} == tree.up
    tree = Tree([{"id": "r", "parent_id": None, "sort_order": 1, "text": ""}, {"id": "a", "parent_id": "r", "sort_order": 1, "text": "one"}, {"id": "b", "parent_id": "r", "sort_order": None, "text": "two"}, {"id": "c", "parent_id": "b", "sort_order": 1, "text": ""}])
    tree.apply("node.delete", {"node": "r"})
    tree.apply("node.mergePrevious", {"node": "b"})
    assert [(r["id"], r["address"], r["text"]) for r in tree.rows()] == [("r", "1", ""), ("a", "1-1", "one\n\ntwo"), ("c", "1-1-1", "")]


def test_guards(spark):
    docs = spark.createDataFrame([(1, "a", "p"), (2, "b", None), (3, "b", "p/q")], "doc_id long, title string, path string")
    assert D.one_document(docs, "doc:2").doc_id == 2 and D.one_document(docs, "a").doc_id == 1
    for bad in ("b", "nothing"):
        with pytest.raises(LookupError):
            D.one_document(docs, bad)
    commits = spark.createDataFrame([("c1", "2024-01-01", "first"), ("c2", "2024-02-01", "second")], "commit_id string, created_at string, summary string")
    assert D.one_commit(commits, "2024-02").commit_id == "c2" and D.one_commit(commits, "c1").summary == "first"
    with pytest.raises(LookupError):
        D.one_commit(commits, "2024")
    with pytest.raises(ValueError):
        read_only_sql(spark, "DROP TABLE x")
    with pytest.raises(ValueError):
        read_only_sql(spark, "SELECT 1; SELECT 2")
    assert read_only_sql(spark, "SELECT id FROM range(5) WHERE id > :x", 2, {"x": 0}).collect()[0].truncated
    with pytest.raises(RuntimeError):
        require_complete(spark.createDataFrame([(1, "missing")], "doc_id int, status string"))
    assert terms_of(" a  b a B ") == ["a", "b", "B"] and maintenance_due(200, 60) and not maintenance_due(199, 90)
    got = upsert(docs.select("doc_id", "title"), spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 1)], "doc_id long, title string, seq int"), "doc_id", "seq")
    assert sorted(map(tuple, got.collect())) == [(1, "y"), (2, "b"), (3, "b"), (9, "z")]


def test_closure_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    groups = {r.id: r.group_id for r in closure(links).collect()}
    assert groups == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert closure(links.limit(0)).count() == 0


def test_streams(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [("k", day, "u"), ("k", day + timedelta(seconds=3), "u"), ("k", day + timedelta(seconds=30), "u"), ("j", day, "u")]
    schema = "idempotency_key string, ts timestamp, user_id string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = volumes.start_append(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert 2 <= spark.read.parquet(str(tmp_path / "out")).count() <= 3
    batch = volumes.deduplicated_batch(spark.createDataFrame(rows, schema), "idempotency_key", "ts", "user_id")
    assert batch.count() == 3
    sessions = volumes.session_volumes(spark.createDataFrame([("a", day, 1), ("a", day + timedelta(hours=23), 1), ("a", day + timedelta(hours=48), 1)], "user_id string, ts timestamp, x int"))
    assert sorted(r.n for r in sessions.collect()) == [1, 2]


def test_appended_ordinals_continue(spark, tmp_path):
    from treeline.streaming.volumes import start_append

    schema = "idempotency_key string, ts timestamp, parent_id string, seq long, text string"
    for turn, rows in enumerate(([("a", "p", 1), ("b", "p", 2), ("c", "q", 3)], [("d", "p", 4), ("e", "r", 5), ("f", "p", 6)])):
        from datetime import datetime

        df = spark.createDataFrame([(k, datetime(2024, 1, 1, turn, i), p, s, k) for i, (k, p, s) in enumerate(rows)], schema)
        df.coalesce(1).write.parquet(str(tmp_path / f"in/{turn}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        start_append(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.text: r.sort_order for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 1, "b": 2, "c": 1, "d": 3, "e": 1, "f": 4}


def test_late_pushes_stay_until_the_seal(spark, tmp_path):
    schema = "user_id string, ts timestamp"
    day = datetime(2024, 1, 1)
    src = tmp_path / "pushes"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    # 30 h later a is idle, but not sealed yet; b moves the watermark on; a's next push opens a new volume
    for i, (who, hours) in enumerate((("a", 0), ("a", 30), ("b", 200), ("b", 201), ("a", 202))):
        spark.createDataFrame([(who, day + timedelta(hours=hours))], schema).coalesce(1).write.mode("append").parquet(str(src))
        if i == 0:
            q = late_volumes(stream, "user_id", "ts").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
    got = [(r.volume_no, r.event, r.n) for r in spark.sql("select * from late where user_id = 'a'").collect()]
    q.stop()
    assert got == [(1, "push", 1), (1, "push", 2), (1, "sealed", 2), (2, "push", 1)]


def test_state_of_volumes(spark):
    day = datetime(2024, 1, 1)
    df = spark.createDataFrame([(day, day + timedelta(hours=h), s, d) for h, s, d in [(1, None, None), (25, None, None), (49, None, None), (60, day, day + timedelta(hours=2)), (2, day + timedelta(hours=1), None)]], "last timestamp, now timestamp, sealed timestamp, distilled timestamp")
    got = [r[0] for r in df.select(volumes.volume_state(F.col("last"), F.col("now"), F.col("sealed"), F.col("distilled"))).collect()]
    assert got == ["active", "sealed", "distillable", "distilled", "sealed"]


def test_pdf_lines_lays_out_all_words(spark):
    from pyspark.sql import functions as F

    from treeline.plans.editing import QUERIES
    from treeline.sources.corpus import corpus_docs

    sf = "/root/testdata/sf0.01"
    docs = corpus_docs(spark, sf).where("path is not null").select("path", F.size(F.filter(F.split("source_text", r"\s+"), lambda w: w != "")).alias("n"))
    want = {r.path: r.n for r in docs.groupBy("path").agg(F.sum("n").alias("n")).where("n > 0").collect()}
    got = QUERIES["pdf_lines"](spark, sf).groupBy("path").agg(F.max("page").alias("page"), F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("n")).collect()
    whole = corpus_docs(spark, sf).where("path is not null").groupBy("path").agg(F.sum(F.length(F.regexp_replace("source_text", r"\s+", ""))).alias("n"))
    assert max(want.values()) > 400 and {r.path: r.n for r in got} == {r.path: r.n for r in whole.where("n > 0").collect()}
    assert max(r.page for r in got) >= 2


def test_closure_of_a_chain_that_advances_one_id_a_round(spark):
    ids = [0, *range(100, 0, -1)]
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")
    assert {r.id: r.group_id for r in closure(links).collect()} == dict.fromkeys(ids, 0)


def test_circles_raise_and_depth_is_no_cap(spark):
    from treeline.operators.orphans import orphan_nodes
    from treeline.operators.versions import chain, reachable

    long = spark.createDataFrame([(i, i - 1 if i else None) for i in range(150)], "id long, parent_id long")
    assert chain(long, spark.createDataFrame([(149,)], "id long")).count() == 150
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "id long, parent_id long")
    with pytest.raises(RuntimeError):
        chain(ring, spark.createDataFrame([(0,)], "id long"))
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(20)] + [("20", "3")], "parent string, child string")
    assert reachable(edges, spark.createDataFrame([("0",)], "hash string")).count() == 21
    hung = orphan_nodes(spark.createDataFrame([(f"n{i:02d}", f"n{i - 1:02d}" if i else "gone") for i in range(14)], "id string, parent_id string"))
    assert max(r.hops for r in hung.collect()) == 13 and hung.count() == 14


def test_synonyms_and_related_ids_over_all_orders(spark):
    from treeline.plans.retrieval import QUERIES

    sf = "/root/testdata/sf0.001"
    links = {(r.o_custkey, r.o_custkey // 3) for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").collect()}
    top: dict = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            top[high] = low
    want = {x: find(x) for x in list(top)}
    assert {r.id: r.group_id for r in QUERIES["synonym_groups_all"](spark, sf).collect()} == want and max(want) >= 40
    group = {x for x in want if want[x] == want.get(5)} | {5}
    pairs = {(r.l_partkey, r.l_suppkey) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()}
    related = {y for p in pairs for x, y in (p, p[::-1]) if x in group} - group
    assert {r.related_id for r in QUERIES["entity_related_all"](spark, sf).collect()} == related


def test_embedded_texts_takes_every_node_with_a_text(spark):
    from treeline.functions.embed import HashingEmbedder
    from treeline.plans.editing import QUERIES
    from treeline.sources.corpus import corpus_nodes

    rows = [r for r in corpus_nodes(spark, "/root/testdata/sf0.001").collect() if r.text.strip()]
    put = {r.id: "\n".join(t.strip() for t in (r.node_title, r.text, r.node_note) if t and t.strip()) for r in rows}
    got = {r.id: r.embedding for r in QUERIES["embedded_texts"](spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == put.keys() and any(r.depth == 3 for r in rows)
    some = sorted(put)[:50]
    for i, v in zip(some, HashingEmbedder(32)([put[i] for i in some])):
        assert got[i] == pytest.approx(v, abs=1e-6)
