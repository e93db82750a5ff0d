"""Readers of files as rows: text with charset detection, CSV, XLSX, DOCX, EPUB, HTML, chat transcripts, Python sources.

Files come from ``binaryFile`` (one row a file, workers parse their own files); nothing is read on the driver. Every reader
returns (path, record_no, address, title, text); a file that cannot be parsed gives one row with text null and the reason as title.
"""

from __future__ import annotations

import ast
import csv
import html
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from treeline.functions.split import spans
from treeline.sources.markdown import tree_records

_SCHEMA = "path string, record_no int, address string, title string, text string"
Record = tuple[str, str, str]


def decode(raw: bytes) -> str:
    """UTF-8 (with or without mark), UTF-16 with mark, else GB18030, else Latin-1."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for code in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(code)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def _flat(texts: list[str], title: str = "") -> list[Record]:
    return [(f"1-{i}", title, t) for i, t in enumerate(texts, 1)]


def txt_records(raw: bytes) -> list[Record]:
    t = decode(raw)
    return _flat([t[a:b] for a, b in spans(t, True, True)])


def markdown_records(raw: bytes) -> list[Record]:
    return [(a, title, text) for a, _, title, text, _ in tree_records(decode(raw))]


def direct_records(raw: bytes) -> list[Record]:
    return [("1", "", decode(raw))]


def csv_records(raw: bytes) -> list[Record]:
    """Text is the second column, else the first; a first line without a digit and with only short cells is a header."""
    rows = [r for r in csv.reader(io.StringIO(decode(raw), newline="")) if any(c.strip() for c in r)]
    if len(rows) > 1 and all(len(c) <= 30 and not re.search(r"\d", c) for c in rows[0]):
        rows = rows[1:]
    return [(f"1-{i}", "", r[1] if len(r) > 1 else r[0]) for i, r in enumerate(rows, 1)]


def csv_vectors(raw: bytes) -> list[list[float] | None]:
    """Vectors of the columns from the fourth on, where all of them are finite numbers."""
    out: list[list[float] | None] = []
    for r in csv.reader(io.StringIO(decode(raw), newline="")):
        try:
            v = [float(c) for c in r[3:]]
        except ValueError:
            v = []
        out.append(v if v and all(abs(x) < float("inf") for x in v) else None)
    return out


def xlsx_records(raw: bytes) -> list[Record]:
    """First sheet, from the second row on: column B is the text."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        out: list[Record] = []
        for row in ET.fromstring(z.read(sheets[0])).iter(f"{{{ns['m']}}}row"):
            number = int(row.get("r", "0"))
            for c in row.findall("m:c", ns):
                if number >= 2 and re.fullmatch(r"B\d+", c.get("r", "")):
                    v = c.find("m:v", ns)
                    inline = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    text = shared[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else "")
                    if text:
                        out.append((f"1-{len(out) + 1}", "", text))
        return out


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items and table rows of a page; scripts and styles are skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str]] = []
        self.role, self.level, self.text, self.skip, self.row = "paragraph", 0, "", 0, None

    def flush(self) -> None:
        t = re.sub(r"\s+", " ", self.text).strip()
        if t:
            self.out.append((self.role, self.level, t))
        self.text, self.role, self.level = "", "paragraph", 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.role, self.level = "heading", int(tag[1])
        elif tag in ("p", "div", "li", "blockquote", "pre", "section", "article"):
            self.flush()
        elif tag == "tr":
            self.flush()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.text = ""
        elif tag == "br":
            self.text += " "

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.row is not None:
            self.row.append(re.sub(r"\s+", " ", self.text).strip())
            self.text = ""
        elif tag == "tr" and self.row is not None:
            if any(self.row):
                self.out.append(("table", 0, " | ".join(self.row)))
            self.row, self.text = None, ""
        elif re.fullmatch(r"h[1-6]", tag) or tag in ("p", "div", "li", "blockquote", "pre", "section", "article"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text += data


def html_blocks(page: str) -> list[tuple[str, int, str]]:
    """(role, level, text) of a page in order."""
    p = _Blocks()
    p.feed(page)
    p.close()
    p.flush()
    return p.out


def _by_heading(blocks: list[tuple[str, int, str]]) -> list[Record]:
    stack, counts, out = [(0, "1")], {}, []
    for role, level, text in blocks:
        if role == "heading":
            while len(stack) > 1 and stack[-1][0] >= level:
                stack.pop()
        parent = stack[-1][1]
        counts[parent] = counts.get(parent, 0) + 1
        address = f"{parent}-{counts[parent]}"
        if role == "heading":
            stack.append((level, address))
        out.append((address, text if role == "heading" else "", "" if role == "heading" else text))
    return out


def html_records(raw: bytes) -> list[Record]:
    return _by_heading(html_blocks(decode(raw)))


def docx_records(raw: bytes) -> list[Record]:
    """Headings by outline level, else by style name; tables as rows of cells."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{w}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{w}style"):
                n, o = s.find(f"{w}name"), s.find(f"{w}pPr/{w}outlineLvl")
                names[s.get(f"{w}styleId")] = (n.get(f"{w}val", "") if n is not None else "", o.get(f"{w}val") if o is not None else None)

    def words(e) -> str:
        return "".join((t.text or "") if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "\n" if t.tag == f"{w}br" else "" for t in e.iter())

    blocks: list[tuple[str, int, str]] = []
    for e in body if body is not None else []:
        if e.tag == f"{w}p":
            text = words(e).strip()
            level = 0
            o, s = e.find(f"{w}pPr/{w}outlineLvl"), e.find(f"{w}pPr/{w}pStyle")
            name, inherited = names.get(s.get(f"{w}val"), (s.get(f"{w}val", ""), None)) if s is not None else ("", None)
            if o is not None or inherited is not None:
                level = int(o.get(f"{w}val") if o is not None else inherited) + 1
            elif m := re.search(r"(?i)(?:heading|标题)\s*([1-9])", name):
                level = int(m.group(1))
            if text:
                blocks.append(("heading" if 1 <= level <= 9 else "paragraph", level, text))
        elif e.tag == f"{w}tbl":
            for row in e.iter(f"{w}tr"):
                blocks.append(("table", 0, " | ".join(words(c).strip() for c in row.findall(f"{w}tc"))))
    return _by_heading(blocks)


def epub_records(raw: bytes) -> list[Record]:
    """Pages in the order of the spine; each page's blocks by its headings."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        box = ET.fromstring(z.read("META-INF/container.xml"))
        root = next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))
        opf = ET.fromstring(z.read(root))
        base = root.rpartition("/")[0]
        items = {e.get("id"): e.get("href") for e in opf.iter() if e.tag.endswith("}item")}
        blocks: list[tuple[str, int, str]] = []
        for ref in (e.get("idref") for e in opf.iter() if e.tag.endswith("}itemref")):
            name = f"{base}/{items[ref]}".lstrip("/") if ref in items else ""
            if name in z.namelist():
                blocks += html_blocks(decode(z.read(name)))
    return _by_heading(blocks)


#: Beginnings of user lines that a program wrote.
SYNTHETIC = (
    "<command-name", "<command-message", "<command-args", "<local-command-stdout", "<local-command-stderr", "<local-command-caveat",
    "<system-reminder", "<task-notification", "<user-memory-input",
)


def _said(content: object) -> tuple[str, list[dict]]:
    """Text and tool uses of a message's content (a string or a list of blocks)."""
    if isinstance(content, str):
        return content.strip(), []
    blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
    text = "\n".join(b["text"] for b in blocks if b.get("type") == "text" and isinstance(b.get("text"), str))
    return text.strip(), [b for b in blocks if b.get("type") == "tool_use"]


def transcript_records(raw: bytes) -> list[Record]:
    """Turns of a JSON-lines transcript: (role, text), the role being the line's type; broken lines, user lines a program wrote
    and empty turns are dropped; tool uses are children of their turn."""
    out: list[Record] = []
    turn = 0
    for line in decode(raw).split("\n"):
        try:
            e = json.loads(line)
        except ValueError:
            continue
        role = e.get("type") if isinstance(e, dict) else None
        if role not in ("user", "assistant"):
            continue
        message = e.get("message")
        content = message.get("content") if isinstance(message, dict) else None
        text, tools = _said(content)
        if role == "user":
            written = any(e.get(k) is True for k in ("isMeta", "isCompactSummary", "isVisibleInTranscriptOnly"))
            if not text or written or text.startswith(SYNTHETIC):
                continue
            tools = []
        elif not isinstance(content, list) or not (text or tools):
            continue
        turn += 1
        out.append((f"1-{turn}", role, text))
        out += [(f"1-{turn}-{k}", p.get("name") or "tool", json.dumps(p.get("input") or {}, ensure_ascii=False)) for k, p in enumerate(tools, 1)]
    return out


def python_records(raw: bytes) -> list[Record]:
    """Statements as a tree: imports grouped, suites nested; the title is the kind of node."""
    source = decode(raw)
    module = ast.parse(source)
    kinds = {ast.If: "IF", ast.For: "FOREACH", ast.AsyncFor: "FOREACH", ast.While: "LOOP", ast.FunctionDef: "FUNCTION", ast.AsyncFunctionDef: "FUNCTION", ast.ClassDef: "CLASS", ast.Try: "TRY", ast.With: "WITH"}
    lines = source.splitlines()
    out: list[Record] = []

    def walk(body: list[ast.stmt], parent: str) -> None:
        n, run = 0, []

        def put(title: str, text: str) -> str:
            nonlocal n
            n += 1
            out.append((f"{parent}-{n}", title, text))
            return f"{parent}-{n}"

        def imports() -> None:
            if run:
                put("IMPORT", "\n".join(ast.get_source_segment(source, s) or "" for s in run))
                run.clear()

        for s in body:
            if isinstance(s, (ast.Import, ast.ImportFrom)):
                run.append(s)
                continue
            imports()
            kind = next((k for t, k in kinds.items() if isinstance(s, t)), "TEXT")
            inner = getattr(s, "body", None)
            if kind == "TEXT" or not isinstance(inner, list):
                put("TEXT", ast.get_source_segment(source, s) or "")
                continue
            head = "\n".join(lines[s.lineno - 1 : max(s.lineno, inner[0].lineno - 1)]).strip()
            walk(inner, put(kind, head))
            if getattr(s, "orelse", None):
                walk(s.orelse, put("ELSE", "else:"))
        imports()

    walk(module.body, "1")
    return out


#: Readers by extension; the modes 'direct' and 'vector' take any text.
READERS: dict[str, Callable[[bytes], list[Record]]] = {
    "txt": txt_records, "md": markdown_records, "markdown": markdown_records, "csv": csv_records, "xlsx": xlsx_records, "docx": docx_records,
    "epub": epub_records, "html": html_records, "htm": html_records, "jsonl": transcript_records, "py": python_records,
}


def reader_for(path: str, mode: str = "complete") -> Callable[[bytes], list[Record]]:
    """Reader by extension and mode; CSV and XLSX are no relay formats, unknown extensions are refused."""
    ext = path.rpartition(".")[2].lower()
    if mode == "direct":
        return direct_records
    if ext not in READERS or (mode == "relay" and ext in ("csv", "xlsx")):
        raise ValueError(f"{ext or path} can't be imported in mode {mode}")
    return READERS[ext]


def parse_files(files: DataFrame, mode: str = "complete") -> DataFrame:
    """Records of (path, content) rows, as read by the ``binaryFile`` source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(path, i, *r) for i, r in enumerate(reader_for(path, mode)(bytes(raw)), 1)]
                except Exception as e:  # a broken file must not end the job
                    rows.append((path, 0, None, f"{type(e).__name__}: {e}"[:200], None))
            yield pd.DataFrame(rows, columns=["path", "record_no", "address", "title", "text"])

    return files.select("path", "content").mapInPandas(run, _SCHEMA)


def read_files(spark: SparkSession, pattern: str, mode: str = "complete") -> DataFrame:
    return parse_files(spark.read.format("binaryFile").load(pattern), mode)


def decode_entities(text: str) -> str:
    """The five XML entities, numeric ones and the no-break space."""
    return re.sub(r"&(amp|lt|gt|quot|apos|nbsp|#\d+|#[xX][0-9a-fA-F]+);", lambda m: html.unescape(m.group(0)), text)
