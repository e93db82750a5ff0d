"""Rule-based sentence spans with offsets (full-width marks by default, ASCII marks on request)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Marks, closers, units that are never cut, lines that are no sentences.
WIDE, NARROW = "。！？", ".!?"
CLOSERS = "\"'”’）」】》〉〕］)"
_CLOSING = re.compile("[" + re.escape(CLOSERS) + "]*")
_RULE = re.compile(r"[-_:| ]{3,}")
_TOKEN = re.compile(r"\$\$.*?(?:\$\$|\Z)|\\\[.*?(?:\\\]|\Z)|`+|\$+|\n|[\[\]()]|[。！？.!?]", re.S)


def spans(text: str, ascii_marks: bool = False, hard_breaks: bool = False) -> list[tuple[int, int]]:
    """(start, end) of the sentences in order. Code in backticks and single-dollar formulas hide marks; ``$$`` and ``\\[``
    formulas are units; a dot between letters or digits, inside brackets or before another dot ends nothing."""
    out: list[tuple[int, int]] = []
    begin, ticks, math, depth = 0, 0, False, {"[": 0, "(": 0}

    def push(a: int, b: int) -> None:
        part = text[a:b]
        bare = part.strip()
        if bare and bare != "$$" and not _RULE.fullmatch(bare):
            a += len(part) - len(part.lstrip())
            out.append((a, a + len(bare)))

    at = 0
    while m := _TOKEN.search(text, at):
        tok, at = m.group(), m.end()
        formula = tok.startswith(("$$", "\\["))
        if formula and not ticks and not math:
            push(begin, m.start())
            push(m.start(), at)
            begin, depth = at, {"[": 0, "(": 0}
        elif formula:  # hidden by code or an open formula: only its first sign counts
            at = m.start() + (2 if tok.startswith("$$") else 1)
        elif tok[0] == "`" and not math:
            ticks = 0 if ticks and len(tok) >= ticks else ticks or len(tok)
        elif tok[0] == "$" and not ticks:
            math ^= len(tok) == 1
        elif ticks or math:
            continue
        elif tok == "\n":
            if hard_breaks:
                push(begin, m.start())
                begin = at
        elif tok in "[(":
            depth[tok] += 1
        elif tok in "])":
            opener = "[" if tok == "]" else "("
            depth[opener] = max(0, depth[opener] - 1)
        elif tok in WIDE or (ascii_marks and tok in NARROW):
            if tok == ".":
                before, after = text[m.start() - 1 : m.start()], text[at : at + 1]
                if (re.match("[A-Za-z0-9]", before) and re.match("[A-Za-z0-9]", after)) or any(depth.values()) or after == ".":
                    continue
            at = _CLOSING.match(text, at).end()
            push(begin, at)
            begin = at
    push(begin, len(text))
    return out


def span_rows(df: DataFrame, key: str, text: str, ascii_marks: bool = False, hard_breaks: bool = False) -> DataFrame:
    """(key, sentence_index from 1, start_offset, end_offset, text) of every row; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (k, i, a, b, t[a:b])
                for k, t in zip(pdf[key], pdf[text])
                if t
                for i, (a, b) in enumerate(spans(t, ascii_marks, hard_breaks), 1)
            ]
            yield pd.DataFrame(rows, columns=[key, "sentence_index", "start_offset", "end_offset", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, sentence_index int, start_offset int, end_offset int, text string")
