"""Minimal writers of office files from rows of text: the counterpart of the readers in ``files``, for exports and round trips."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.sax.saxutils import escape

#: Namespaces of the formats.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = "http://www.idpf.org/2007/opf"
BOX = "urn:oasis:names:tc:opendocument:xmlns:container"
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _xml(text: str) -> str:
    return escape(_NO_XML.sub("", text))


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def docx(title: str, texts: list[str]) -> bytes:
    """A heading of level 1 and a paragraph a text."""
    style = f'<w:styles xmlns:w="{WORD}"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    head = f'<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>{_xml(title)}</w:t></w:r></w:p>'
    body = "".join(f"<w:p><w:r><w:t>{_xml(t)}</w:t></w:r></w:p>" for t in texts)
    return _zip({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{head}{body}</w:body></w:document>', "word/styles.xml": style})


def xlsx(texts: list[str]) -> bytes:
    """One sheet: a header row, then number and text in columns A and B."""
    cell = '<row r="{r}"><c r="A{r}"><v>{r}</v></c><c r="B{r}" t="inlineStr"><is><t>{t}</t></is></c></row>'
    rows = "".join(cell.format(r=i, t=_xml(t)) for i, t in enumerate(["text", *texts], 1))
    return _zip({"xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{rows}</sheetData></worksheet>'})


def epub(title: str, texts: list[str]) -> bytes:
    """A page with the title and one with the texts, in the order of the spine."""
    box = f'<container xmlns="{BOX}"><rootfiles><rootfile full-path="b/book.opf"/></rootfiles></container>'
    names = ("p1", "p2")
    items = "".join(f'<item id="{n}" href="{n}.xhtml"/>' for n in reversed(names))
    book = f'<package xmlns="{PACKAGE}"><manifest>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{n}{chr(34)}/>" for n in names)}</spine></package>'
    pages = [f"<html><body><h1>{_xml(title)}</h1></body></html>", "<html><body>" + "".join(f"<p>{_xml(t)}</p>" for t in texts) + "</body></html>"]
    return _zip({"META-INF/container.xml": box, "b/book.opf": book} | {f"b/{n}.xhtml": p for n, p in zip(names, pages)})


def transcript(texts: list[str]) -> bytes:
    """A line of JSON a turn, of user and assistant in turn."""
    said = [{"type": ("user", "assistant")[i % 2], "message": {"content": [{"type": "text", "text": t}]}} for i, t in enumerate(texts)]
    return "\n".join(json.dumps(x, ensure_ascii=False) for x in said).encode()


def sheet(texts: list[str]) -> bytes:
    """Comma-separated: a header, then number and quoted text."""
    return "\n".join(["no,text", *('{},"{}"'.format(i, t.replace('"', '""')) for i, t in enumerate(texts, 1))]).encode()


def page(title: str, texts: list[str]) -> bytes:
    """A heading and a paragraph a text."""
    return (f"<html><head><title>{_xml(title)}</title></head><body><h1>{_xml(title)}</h1>" + "".join(f"<p>{_xml(t)}</p>" for t in texts) + "</body></html>").encode()


WRITERS = {
    "docx": docx, "epub": epub, "xlsx": lambda title, texts: xlsx(texts),
    "jsonl": lambda title, texts: transcript(texts), "csv": lambda title, texts: sheet(texts),
    "html": page,
}
