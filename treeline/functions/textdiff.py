"""Character differences and notes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

MOST_EDITS = 600
#: Marks around generated parts of a note.
NOTE_OPEN, NOTE_CLOSE = "<!-- generated-note:start -->", "<!-- generated-note:end -->"
Segment = tuple[str, str]


def _joined(parts: Iterator[Segment] | list[Segment]) -> list[Segment]:
    out: list[Segment] = []
    for kind, text in parts:
        if text and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + text)
        elif text:
            out.append((kind, text))
    return out


def _shortest(a: str, b: str, most: int) -> list[Segment] | None:
    """Shortest edit script by furthest-reaching points; each point links back to the edit that led to it. None beyond ``most``."""
    # reached[k] = (x, link); a link is (kind, character, run of equal text after it, link before)
    reached: dict[int, tuple[int, tuple | None]] = {}
    for edits in range(most + 1):
        for k in range(-edits, edits + 1, 2):
            down, right = reached.get(k + 1), reached.get(k - 1)
            ways = [(0, None)] if not edits else []
            if right is not None and right[0] < len(a):
                ways.append((right[0] + 1, ("del", a[right[0]], right[1])))
            if down is not None and down[0] - k - 1 < len(b):
                ways.append((down[0], ("ins", b[down[0] - k - 1], down[1])))
            if not ways:
                continue
            x, link = max(ways, key=lambda w: w[0])
            s = x
            while x < len(a) and x - k < len(b) and a[x] == b[x - k]:
                x += 1
            reached[k] = (x, ("equal", a[s:x], link) if x > s else link)
            if x >= len(a) and x - k >= len(b):
                out, link = [], reached[k][1]
                while link is not None:
                    out.append((link[0], link[1]))
                    link = link[2]
                return out[::-1]
    return None


def text_diff(before: str | None, after: str | None, most: int = MOST_EDITS) -> list[Segment]:
    """('equal' | 'del' | 'ins', text) runs; null counts as empty. Common ends are cut off first; beyond ``most`` edits
    the middle is replaced as a whole."""
    a, b = before or "", after or ""
    n = min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    s = next((i for i in range(n - p) if a[-1 - i] != b[-1 - i]), n - p)
    x, y = a[p : len(a) - s], b[p : len(b) - s]
    middle = _shortest(x, y, most) if x and y else [("del", x), ("ins", y)]
    if middle is None:
        middle = [("del", x), ("ins", y)]
    return _joined([("equal", a[:p]), *middle, ("equal", a[len(a) - s :])])


def diff_rows(df: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """(key, part_no, type, text) of each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, *seg) for k, a, b in zip(pdf[key], pdf[before], pdf[after]) for i, seg in enumerate(text_diff(a, b), 1)]
            yield pd.DataFrame(rows, columns=[key, "part_no", "type", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, before, after).mapInPandas(run, f"{key} {kind}, part_no int, type string, text string")


def note_parts(note: str | None) -> list[tuple[str, bool]]:
    """(text, generated) parts of a note; an unclosed generated part reaches to the end."""
    out: list[tuple[str, bool]] = []
    for i, chunk in enumerate((note or "").split(NOTE_OPEN)):
        made, _, rest = chunk.partition(NOTE_CLOSE) if i else ("", "", chunk)
        out += [(t.strip(), flag) for t, flag in ((made, True), (rest, False)) if t.strip()]
    return out


def with_generated(note: str | None, text: str | None) -> str:
    parts = [(note or "").strip(), f"{NOTE_OPEN}\n{text.strip()}\n{NOTE_CLOSE}" if text and text.strip() else ""]
    return "\n\n".join(p for p in parts if p)
