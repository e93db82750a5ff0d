"""Text layers of PDF pages: positioned items to lines, reading order, paragraphs and inferred headings.

Input rows are items (path, page, page_width, x, y0, x1, y1, text, bold). A page is the unit of work and small by nature; pages are
spread over the workers, where bands of items become lines. What spans pages (body size, heading levels, margins, paragraphs) is
left to Spark as aggregates and windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The layout rules. Heights are of the line, widths shares of the page's.
SHIFT, LEAST_SHIFT = 0.55, 2.0  # centres of one line differ by at most this share of its height, or this
WORD_GAP = 0.18  # a wider gap between items is a space
WIDE, WIDE_FROM, WIDE_TO = 0.58, 0.38, 0.62  # a full-width line is wider, or starts before and ends behind
COLUMN_SLACK = 0.12  # a column may pass the middle by this share of the half page
LEAST_LINES, LEAST_SIDE = 12, 4  # two columns need so many lines, and so many on each side
PARAGRAPH_GAP, LEAST_HEIGHT = 2.3, 8.0  # a wider step between lines, in heights of at least that, is a blank line
TITLE_NEAR, TITLE_FAR = 8_000, 12_000  # characters behind the page's start in which a title is searched, also by its letters
MOST_TITLE = 80
NO_SPACE_BEFORE = set("，。？！；：、）】》」』,.!?;:%)")
CJK = re.compile("[ᄀ-ᇿ぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]")
PAGE_NUMBER = r"^[\-–— ]*[0-9ivxlc]{1,5}[\-–— ]*$"
_LINE = "path string, page int, line_no int, x0 double, y0 double, x1 double, y1 double, height double, bold boolean, column_break boolean, text string"


@dataclass
class _Band:
    """Items of one line and the box around them."""

    items: list[dict] = field(default_factory=list)
    box: np.ndarray = field(default_factory=lambda: np.array([np.inf, np.inf, -np.inf, -np.inf]))  # x0, y0, x1, y1
    height: float = 0.0

    def holds(self, it: dict, middle: float) -> bool:
        """Whether an item stands at this height and not in another column."""
        x0, y0, x1, y1 = self.box
        tall = max(self.height, it["y1"] - it["y0"])
        level = abs((it["y0"] + it["y1"]) - (y0 + y1)) / 2 <= max(LEAST_SHIFT, SHIFT * tall)
        across = middle > 0 and ((x0 + x1) / 2 - middle) * ((it["x"] + it["x1"]) / 2 - middle) < 0
        gap = max(x0, it["x"]) - min(x1, it["x1"])
        return bool(level and not (across and gap > max(tall, 1.0)))

    def add(self, it: dict) -> None:
        self.items.append(it)
        low, high = np.minimum(self.box[:2], (it["x"], it["y0"])), np.maximum(self.box[2:], (it["x1"], it["y1"]))
        self.box, self.height = np.concatenate([low, high]), max(self.height, it["y1"] - it["y0"])

    def text(self) -> str:
        """Items from left to right, with a space where a gap is wide and both scripts use spaces."""
        row = sorted(self.items, key=lambda i: i["x"])
        parts = [row[0]["text"]]
        for a, b in zip(row, row[1:]):
            spaced = b["x"] - a["x1"] > max(1.0, WORD_GAP * (a["y1"] - a["y0"])) and b["text"][:1] not in NO_SPACE_BEFORE
            both_cjk = CJK.match(a["text"][-1:]) and CJK.match(b["text"])
            parts.append(" " * bool(spaced and not both_cjk) + b["text"])
        return "".join(parts)

    def line(self) -> dict:
        sizes = np.array([len(i["text"]) for i in self.items])
        heavy = sizes[[bool(i.get("bold")) for i in self.items]].sum()
        x0, y0, x1, y1 = map(float, self.box)
        return {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "height": float(self.height), "bold": bool(heavy >= 0.6 * sizes.sum()), "column_break": False, "text": self.text()}


def zones(box: np.ndarray, width: float) -> np.ndarray:
    """Reading zone of each line (rows x0, y0, x1): 0 above the columns, 1 left, 2 right, 3 full-width between, 4 below; all 0 on a
    page of one column."""
    x0, y0, x1 = box.T
    middle = width / 2
    full = (x1 - x0 > WIDE * width) | ((x0 < WIDE_FROM * width) & (x1 > WIDE_TO * width))
    n_left, n_right = (x1 < middle * (1 + COLUMN_SLACK)).sum(), (x0 > middle * (1 - COLUMN_SLACK)).sum()
    if len(box) < LEAST_LINES or min(n_left, n_right) < LEAST_SIDE or n_left + n_right <= 2 * full.sum() or full.all():
        return np.zeros(len(box), int)
    inside = y0[~full]
    return np.select([full & (y0 < inside.min()), full & (y0 > inside.max()), full, (x0 + x1) / 2 < middle], [0, 4, 3, 1], 2)


def page_lines(items: list[dict], width: float) -> list[dict]:
    """Lines of one page in reading order."""
    bands: list[_Band] = []
    for it in sorted((i for i in items if i["text"]), key=lambda i: (i["y0"], i["x"])):
        if not bands or not bands[-1].holds(it, width / 2):
            bands.append(_Band())
        bands[-1].add(it)
    lines = [b.line() for b in bands]
    if not lines:
        return lines
    box = np.array([[ln["x0"], ln["y0"], ln["x1"]] for ln in lines])
    zone = zones(box, width)
    order = np.lexsort((box[:, 0], box[:, 1], zone))
    out = [lines[i] for i in order]
    right = np.flatnonzero(zone[order] == 2)
    if len(right):
        out[right[0]]["column_break"] = True
    return out


def lines(items: DataFrame) -> DataFrame:
    """Lines of all pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, page, width, own in zip(pdf["path"], pdf["page"], pdf["page_width"], pdf["items"]):
                rows += [{"path": path, "page": page, "line_no": i, **ln} for i, ln in enumerate(page_lines(list(own), float(width or 0)), 1)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LINE.split(", ")])

    per = items.where("text is not null").groupBy("path", "page").agg(F.max("page_width").alias("page_width"), F.collect_list(F.struct("x", "x1", "y0", "y1", "text", "bold")).alias("items"))
    return per.mapInPandas(run, _LINE)


def headings(table: DataFrame) -> DataFrame:
    """Inferred headings (path, page, line_no, level): lines larger than the body size (the size of most characters), ranked by
    size; else bold, at the left margin, and short. Page numbers and lines over 80 characters are none."""
    text = F.trim("text")
    fit = table.where((F.length(text) > 0) & (F.length(text) <= MOST_TITLE) & ~text.rlike(PAGE_NUMBER)).withColumn("size", F.round("height").cast("int"))
    weight = fit.groupBy("path", "size").agg(F.sum(F.length("text")).alias("w"))
    body = weight.groupBy("path").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"))
    margin = fit.groupBy("path", F.round("x0").alias("left")).agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(F.max_by("left", F.struct("n", -F.col("left"))).alias("left"))
    bigger = fit.join(body, "path").where("size > body").groupBy("path").agg(F.array_sort(F.collect_set("size")).alias("sizes"))
    joined = fit.join(body, "path").join(margin, "path").join(bigger, "path", "left")
    n = F.coalesce(F.size("sizes"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    by_size = F.when(F.col("size") > F.col("body"), n - F.array_position("sizes", F.col("size")) + 1)
    by_weight = F.when(F.col("bold") & (F.abs(F.col("x0") - F.col("left")) <= 3) & (F.length(text) <= 40), n + 1)
    return joined.select("path", "page", "line_no", F.coalesce(by_size, by_weight).cast("int").alias("level")).where("level is not null")


def breaks_before() -> Column:
    """Whether a blank line stands before a line of its page: at column breaks and wide steps downwards."""
    along = Window.partitionBy("path", "page").orderBy("line_no")
    step = F.col("y0") - F.lag("y0").over(along)
    tall = F.greatest("height", F.lag("height").over(along), F.lit(LEAST_HEIGHT))
    return F.coalesce(F.col("column_break") | (step > tall * PARAGRAPH_GAP), F.lit(True))


def paragraphs(table: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks of a text layer: path, block_no, type ('heading' or 'paragraph'), level (0 for paragraphs), text.

    ``table`` holds the lines, ``found`` the headings among them (path, page, line_no, level). A paragraph is a run of lines between
    headings without a blank line inside, across pages only where the page begins without one; page numbers are left out.
    """
    known = table.join(found, ["path", "page", "line_no"], "left").withColumn("blank", breaks_before())
    text = F.trim("text")
    kept = known.where(F.col("level").isNotNull() | ~text.rlike(PAGE_NUMBER)).where(text != "")
    along = Window.partitionBy("path").orderBy("page", "line_no")
    fresh = F.col("level").isNotNull() | F.lag("level").over(along).isNotNull() | F.col("blank") | F.lag("text").over(along).isNull()
    block = F.sum(fresh.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    lines_of = F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", text.alias("t")))), lambda x: x["t"])
    return kept.withColumn("block_no", block).groupBy("path", "block_no").agg(
        F.when(F.max("level").isNotNull(), "heading").otherwise("paragraph").alias("type"), F.coalesce(F.max("level"), F.lit(0)).alias("level"), F.array_join(lines_of, "\n").alias("text")
    )


def unbroken(text: str) -> str:
    """Lines of a paragraph run together: no space between two CJK characters or before closing marks; sentence ends keep their break."""
    out = ""
    for line in text.split("\n"):
        line = line.strip()
        if not out or not line:
            sep = "\n" if out else ""
        elif out[-1] in "。！？!?；;：:":
            sep = "\n"
        elif line[0] in "、，。！？!?；;：:）)】》〉」』”\"'’" or (CJK.match(out[-1]) and CJK.match(line[0])):
            sep = ""
        else:
            sep = " "
        out += sep + line
    return out


def image_only(text: str, pages: int) -> bool:
    """Too few letters and digits for a text layer."""
    return sum(c.isalnum() for c in text) < max(40, 8 * max(1, pages))


def outline_positions(text: str, titles: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(title, start, end) of outline entries (title, page start) in the text: near the page's start, else anywhere, else a line
    behind the page's start that has the title's letters with other white space. Entries that are nowhere are left out."""

    def spans(title: str, at: int) -> Iterator[tuple[int, int]]:
        for low, high in ((at, at + TITLE_NEAR), (0, len(text))):
            if title and (k := text.find(title, low, high)) >= 0:
                yield k, k + len(title)
        letters = r"[^\S\n]*".join(map(re.escape, "".join(title.split())))
        if letters and (m := re.compile(rf"^[^\S\n]*{letters}[^\S\n]*$", re.M).search(text, at, at + TITLE_FAR)):
            yield m.span()

    hits = ((title, next(spans(title, at), None)) for title, at in titles)
    return [(title, *hit) for title, hit in hits if hit]
