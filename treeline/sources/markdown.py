"""Markdown as blocks, blocks as trees.

A block is code, math, heading, image, table, list, quote or paragraph with its offsets. Trees follow a stack of headings:
a block hangs on the last heading above it of a lower level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_RULE = re.compile(r"\s*(?:[-*_]\s*){3,}$")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+(.*)$")
_IMAGE = re.compile(r"\s*!\[[^\]]*\]\(([^)\s]+)[^)]*\)\s*$")
_FENCE = re.compile(r"\s*(```|~~~)\s*(.*)$")
_TABLE_RULE = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")


def blocks(text: str) -> list[tuple[str, int, int, int, str]]:
    """(type, level, start, end, text) in order; level is that of a heading, else 0. Rules and blank lines are no blocks."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines: list[tuple[int, str]] = []
    at = 0
    for raw in text.split("\n"):
        lines.append((at, raw))
        at += len(raw) + 1
    out: list[tuple[str, int, int, int, str]] = []
    i = 0

    def run(kind: str, j: int, body: list[str], level: int = 0) -> None:
        nonlocal i
        s, last = lines[i][0], lines[j - 1]
        out.append((kind, level, s, last[0] + len(last[1]), "\n".join(body)))
        i = j

    def until(stop) -> int:
        j = i
        while j < len(lines) and not stop(j):
            j += 1
        return j

    while i < len(lines):
        line = lines[i][1]
        bare = line.strip()
        if not bare or (_RULE.match(line) and not _ITEM.match(line)):
            i += 1
        elif m := _FENCE.match(line):
            fence = m.group(1)
            j = i + 1
            while j < len(lines) and not lines[j][1].strip().startswith(fence):
                j += 1
            body = [x.strip() for _, x in lines[i + 1 : j]]
            run("code", min(j + 1, len(lines)), body)
        elif bare.startswith(("$$", "\\[")):
            close = "$$" if bare.startswith("$$") else "\\]"
            j = i
            if not (bare.endswith(close) and len(bare) > 3):
                j += 1
                while j < len(lines) and close not in lines[j][1]:
                    j += 1
            j = min(j + 1, len(lines))
            run("math", j, [x.strip() for _, x in lines[i:j]])
        elif m := _HEAD.match(line):
            run("heading", i + 1, [m.group(2)], len(m.group(1)))
        elif m := _IMAGE.match(line):
            run("image", i + 1, [m.group(1)])
        elif bare.lower().startswith("<table"):
            j = i
            while j < len(lines) and "</table>" not in lines[j][1].lower():
                j += 1
            j = min(j + 1, len(lines))
            run("table", j, [x.strip() for _, x in lines[i:j]])
        elif "|" in bare and i + 1 < len(lines) and "-" in lines[i + 1][1] and _TABLE_RULE.match(lines[i + 1][1]):
            j = until(lambda k: not lines[k][1].strip() or "|" not in lines[k][1])
            run("table", j, [x.strip() for _, x in lines[i:j] if not _TABLE_RULE.match(x)])
        elif _ITEM.match(line):
            j = until(lambda k: not _ITEM.match(lines[k][1]))
            run("list", j, [_ITEM.match(x).group(1) for _, x in lines[i:j]])
        elif bare.startswith(">"):
            j = until(lambda k: not lines[k][1].strip().startswith(">"))
            run("quote", j, [x.strip()[1:].strip() for _, x in lines[i:j]])
        else:
            def ends(k: int) -> bool:
                x = lines[k][1]
                return not x.strip() or (k > i and bool(_HEAD.match(x) or _FENCE.match(x) or _ITEM.match(x) or _IMAGE.match(x) or x.strip().startswith((">", "$$"))))

            j = until(ends)
            run("paragraph", j, [x.strip() for _, x in lines[i:j]])
    return out


def tree_records(text: str) -> list[tuple[str, int, str, str, float]]:
    """(address, depth, title, text, position) of a document: headings open sections by their level, other blocks hang on
    the last section; paragraphs hold half-step positions, as containers of sentences."""
    stack: list[tuple[int, str]] = [(0, "1")]
    counts: dict[str, int] = {}
    out: list[tuple[str, int, str, str, float]] = []
    for k, (kind, level, _, _, body) in enumerate(blocks(text), 1):
        if kind == "heading":
            while len(stack) > 1 and stack[-1][0] >= level:
                stack.pop()
        parent = stack[-1][1]
        counts[parent] = counts.get(parent, 0) + 1
        address = f"{parent}-{counts[parent]}"
        if kind == "heading":
            stack.append((level, address))
        out.append((address, address.count("-") + 1, body if kind == "heading" else "", "" if kind == "heading" else body, k - 0.5 if kind == "paragraph" else float(k)))
    return out


def block_rows(docs: DataFrame, key: str = "doc_id", text: str = "source_text") -> DataFrame:
    """(key, block_no, type, level, start_offset, end_offset, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *b) for k, t in zip(pdf[key], pdf[text]) if t for i, b in enumerate(blocks(t), 1)]
            yield pd.DataFrame(rows, columns=[key, "block_no", "type", "level", "start_offset", "end_offset", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, block_no int, type string, level int, start_offset int, end_offset int, text string")


def structured(docs: DataFrame, key: str = "doc_id", text: str = "source_text") -> DataFrame:
    """(key, address, depth, title, text, position)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *r) for k, t in zip(pdf[key], pdf[text]) if t for r in tree_records(t)]
            yield pd.DataFrame(rows, columns=[key, "address", "depth", "title", "text", "position"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, address string, depth int, title string, text string, position double")


def inspect(block_table: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_blocks, n_headings, has_structure)."""
    heads = F.sum((F.col("type") == "heading").cast("int"))
    return block_table.groupBy(key).agg(F.count(F.lit(1)).alias("n_blocks"), heads.alias("n_headings"), (heads > 0).alias("has_structure"))


def import_policy(inspected: DataFrame, lengths: DataFrame, limit: int = 1000, key: str = "doc_id") -> DataFrame:
    """How each document is imported in 'simple' mode: 'paragraph' where it has structure, 'direct' where it is flat and
    short, 'refused' where it is flat and longer than the limit."""
    both = lengths.join(inspected, key, "left")
    mode = F.when(F.coalesce("has_structure", F.lit(False)), "paragraph").when(F.col("n_chars") <= limit, "direct").otherwise("refused")
    return both.select(key, mode.alias("import_as"))


#: TeX names rendered as characters.
TEX = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "pi": "π", "sigma": "σ", "mu": "μ", "lambda": "λ", "omega": "ω", "times": "×", "cdot": "·", "le": "≤", "ge": "≥", "ne": "≠", "infty": "∞", "sum": "∑", "int": "∫", "sqrt": "√", "to": "→", "pm": "±", "in": "∈"}


def tex_to_text(tex: str) -> str:
    """Simple TeX as characters: names, fractions as a/b, braces dropped."""
    tex = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", tex)
    tex = re.sub(r"\\([A-Za-z]+)", lambda m: TEX.get(m.group(1), m.group(1)), tex)
    return re.sub(r"[{}]", "", tex).strip()


def plain_text(text: str) -> str:
    """Markdown without its marks: headings, emphasis, links (their label), images (dropped), code ticks, inline formulas as text."""
    text = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"(?m)^\s{0,3}#{1,6}\s+", "", text)
    text = re.sub(r"(?m)^\s*>\s?", "", text)
    text = re.sub(r"(\*\*|__)(.+?)\1", r"\2", text)
    text = re.sub(r"(?<!\w)([*_])([^*_\n]+)\1(?!\w)", r"\2", text)
    text = re.sub(r"`([^`\n]+)`", r"\1", text)
    text = re.sub(r"\$([^$\n]+)\$", lambda m: tex_to_text(m.group(1)), text)
    return text.strip()


def image_sources(text: str) -> list[str]:
    return re.findall(r"!\[[^\]]*\]\(([^)\s]+)", text)
