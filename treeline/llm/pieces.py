"""Splitting oversized items at natural boundaries (problem 5).

Method: byte-range processing. A text beyond ``RANGE`` code points, or a file, is cut into ranges with a halo on both sides;
each worker sees one range and finds the sentences that end in its core. Only narrow boundary tables are stitched, never
texts: per range its number of ``$$`` marks (their prefix sums tell whether a range starts inside a formula), its last
boundary (where the next range's pieces begin) and its piece count. Prefix sums over range lengths give global offsets,
over piece counts the piece numbers, and each piece's text comes out of its own range's slice by offset. A text of one
range needs no stitching: it is cut where it is read.

Ends of pieces: the last sentence end (line breaks end sentences here) that keeps the piece within the limit; a sentence
that alone exceeds the limit is cut at its last white space in the second half of the piece, else at the limit, but not
inside a grapheme. Each piece repeats exactly ``overlap_chars`` code points of the one before.

Only texts of several ranges know the halo: in them a quotation or bracket pair longer than ``HALO`` in one line no longer protects
the end marks inside it (formulas of any length do).
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treeline.llm.sentences import Model, load_model, share_model, split, train
from treeline.plans.session import materialize, spread

RANGE = 1 << 16
HALO = 1 << 13
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff\x1c\x1d\x1e\x1f"
_SLICE = "item string, range_no int, core_start long, core_end long, slice_start long, slice string, last boolean, max_chars int, overlap_chars int"
_NAMES = ["item", "range_no", "core_start", "core_end", "slice_start", "slice", "last", "max_chars", "overlap_chars"]
_PIECE = "item string, piece_no long, start long, end long, text string, longest long"
_DOLLARS = re.compile(r"\${2,}")


def text_ranges(items: DataFrame, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """Ranges of (item, text, max_chars, overlap_chars); offsets are code points of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for item, text, top, lap in zip(pdf["item"], pdf["text"], pdf["max_chars"], pdf["overlap_chars"]):
                n = len(text)
                for k, a in enumerate(range(0, max(n, 1), size)):
                    b, s = min(a + size, n), max(0, a - halo)
                    rows.append((item, k, a, b, s, text[s : min(n, b + halo)], b == n, top, lap))
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=_NAMES)
                        rows = []
            yield pd.DataFrame(rows, columns=_NAMES)

    return items.select("item", "text", "max_chars", "overlap_chars").mapInPandas(run, _SLICE)


def _read(uri: str, a: int, b: int) -> bytes:
    """Bytes [a, b) of a file on any file system that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))
    with where.open_input_file(path) as f:
        return f.read_at(b - a, a)


def _chars(uri: str, a: int, b: int, n: int) -> str:
    """Characters whose first byte is in [a, b) of a UTF-8 file of n bytes."""
    raw = _read(uri, a, min(n, b + 4))
    i = 0
    while a and i < len(raw) and raw[i] & 0xC0 == 0x80:
        i += 1
    j = min(b - a, len(raw))
    while j < len(raw) and raw[j] & 0xC0 == 0x80:
        j += 1
    return raw[i:j].decode("utf-8", "replace")


def file_ranges(spark: SparkSession, files: list[tuple[str, int]], max_chars: int, overlap_chars: int, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """Ranges of giant UTF-8 files given as (URI or path readable on all workers, bytes): each worker reads its byte range.

    A first pass counts the code points of each byte range (a byte that continues a character belongs to the range before);
    their prefix sums give the global offsets; the second reads the slices. The halo counts code points, as everywhere:
    four bytes are read for each and what is too much is cut off.
    """
    table = spark.createDataFrame([(p, int(n)) for p, n in files], "item string, bytes long")
    parts = table.where("bytes > 0").select(
        "item", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("at")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(n=[len(_chars(p, a, min(a + size, n), n)) for p, a, n in zip(pdf["item"], pdf["at"], pdf["bytes"])])

    sized = materialize(spread(parts, "item", "at").mapInPandas(count, "item string, bytes long, at long, n long"), "bytes")
    before = Window.partitionBy("item").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("core_start", F.coalesce(F.sum("n").over(before), F.lit(0)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, a, n, c, chars in zip(pdf["item"], pdf["at"], pdf["bytes"], pdf["core_start"], pdf["n"]):
                b = min(a + size, n)
                left = _chars(p, max(0, a - 4 * halo), a, n)[-halo:] if a else ""
                right = _chars(p, b, min(n, b + 4 * halo), n)[:halo] if b < n else ""
                text = left + _chars(p, a, b, n) + right
                yield pd.DataFrame([(p, a // size, c, c + chars, c - len(left), text, b == n, max_chars, overlap_chars)], columns=_NAMES)

    return placed.mapInPandas(cut, _SLICE)


def dollar_marks(slice_: str, shift: int, start: int, stop: int) -> list[int]:
    """Global positions of the ``$$`` marks of the runs of dollar signs that begin in [start, stop)."""
    out: list[int] = []
    if "$$" in slice_:
        for m in _DOLLARS.finditer(slice_):
            at = m.start() + shift
            if m.start() == 0 and shift > 0 or not start <= at < stop:  # a run cut off by the slice belongs to the range before
                continue
            out += range(at, at + (m.end() - m.start()) // 2 * 2, 2)
    return out


def range_ends(
    slice_: str, shift: int, core_start: int, core_end: int, last: bool, model: Model, before: int = 0, total: int | None = None, opened: int = -1
) -> tuple[list[int], int]:
    """Sentence ends in (core_start, core_end] and the longest sentence that ends there or leaves the slice.

    ``before``: ``$$`` marks ahead of the core, ``total``: of the whole text (None: the slice holds them all), ``opened``: position of the last one
    ahead of the slice. A formula that began before the slice or ends behind it is one sentence all the same.
    """
    size = len(slice_)
    found: list[tuple[int, int]] = []
    a, b = 0, size
    if total:
        marks = dollar_marks(slice_, shift, 0, shift + size)
        ahead = before - sum(m < core_start for m in marks)
        total -= total % 2  # a last mark without its partner opens nothing
        if ahead % 2 and ahead < total:  # the slice starts inside a formula
            a = marks[0] + 2 - shift if marks else size
            found.append((opened, shift + a))
        if (ahead + len(marks)) % 2 and ahead + len(marks) <= total and marks and marks[-1] - shift >= a:  # the last one leaves the slice
            b = marks[-1] - shift
    found += [(s + shift + a, e + shift + a) for s, e in split(slice_[a:b], False, model, True, lines=True)]
    if b < size:
        found.append((b + shift, shift + size))
    ends, longest = [], 0
    for s, e in found:
        cut_off = e == shift + size and not last
        if (core_start < e <= core_end and not cut_off) or (cut_off and s < core_end):
            longest = max(longest, e - s)
        if core_start < e <= core_end and not cut_off:
            ends.append(e)
    return ends, longest


def cut_pieces(begin: int, stop: int, ends: list[int], text: str, shift: int, top: int, lap: int) -> list[tuple[int, int]]:
    """Pieces of [begin, stop): each at most ``top`` long including the ``lap`` repeated code points before it."""
    out: list[tuple[int, int]] = []
    at = begin
    while at < stop:
        start = max(0, at - lap) if at > 0 else 0
        limit = start + top
        if stop <= limit:
            out.append((start, stop))
            break
        k = bisect.bisect_right(ends, limit) - 1
        end = ends[k] if k >= 0 and ends[k] > max(at, start + lap) else 0
        if not end:
            end = limit
            for p in range(limit, max(at, limit - top // 2), -1):
                if text[p - 1 - shift] in _WS:
                    end = p
                    break
            else:
                while end > at + 1 and (unicodedata.combining(text[end - shift]) or text[end - shift] in "\u200d\ufe0f" or text[end - 1 - shift] == "\u200d"):
                    end -= 1
        out.append((start, end))
        at = end
        if stop == shift + len(text) and not text[at - shift :].strip():
            break
    return out


def _checked(top: int, lap: int, halo: int) -> None:
    if top * 2 > halo or not 0 <= lap * 2 < top:
        raise ValueError(f"limits {top}, {lap} do not fit the halo {halo}")


def pieces(ranges: DataFrame, model: Model, halo: int = HALO, with_text: bool = True) -> DataFrame:
    """Pieces of all ranges: item, piece_no (1-based), start, end, text, and per item ``longest`` sentence.

    Needs max_chars <= halo / 2 and 0 <= overlap_chars < max_chars / 2 (checked).
    """
    shared = share_model(ranges.sparkSession, model)
    along = Window.partitionBy("item").orderBy("range_no")
    ahead, whole = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("item")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                _checked(r.max_chars, r.overlap_chars, halo)
                marks = dollar_marks(r.slice, r.slice_start, r.core_start, r.core_end)
                early = [m for m in marks if m < r.core_end - halo]  # ahead of the next slice
                rows.append((r.item, r.range_no, len(marks), early[-1] if early else None, marks[-1] if marks else None))
            yield pd.DataFrame(rows, columns=["item", "range_no", "n", "early", "late"]).astype({"early": "Int64", "late": "Int64"})

    marked = materialize(ranges.mapInPandas(count, "item string, range_no int, n long, early long, late long"), "marks")
    state = marked.select(
        "item", "range_no", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"),
        # the last mark ahead of the slice: of the range before it must lie ahead of its last halo
        F.coalesce(F.greatest(F.lag("early").over(along), F.max("late").over(along.rowsBetween(Window.unboundedPreceding, -2))), F.lit(-1)).alias("opened"),
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load_model(shared)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                ends, longest = range_ends(r.slice, r.slice_start, r.core_start, r.core_end, r.last, m, r.before, r.total, r.opened)
                # the range's last piece ends at its last sentence end, if the next range can still see that
                near = ends and ends[-1] > r.core_end - halo + r.max_chars
                stop = r.core_end if r.last or not near else ends[-1]
                rows.append((r.item, r.range_no, stop, ends, longest))
            yield pd.DataFrame(rows, columns=["item", "range_no", "stop", "ends", "longest"])

    table = ranges.join(state, ["item", "range_no"]).mapInPandas(scan, "item string, range_no int, stop long, ends array<long>, longest long")
    bounds = materialize(table, "bounds")
    stitched = bounds.select(
        "item", "range_no", F.coalesce(F.lag("stop").over(along), F.lit(0).cast("long")).alias("begin"), F.max("longest").over(whole).alias("longest")
    )
    joined = ranges.join(bounds.drop("longest"), ["item", "range_no"]).join(stitched, ["item", "range_no"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                got = cut_pieces(r.begin, r.stop, list(r.ends), r.slice, r.slice_start, r.max_chars, r.overlap_chars)
                rows.append((r.item, r.range_no, [x for p in got for x in p], len(got), r.longest))
            yield pd.DataFrame(rows, columns=["item", "range_no", "cuts", "n", "longest"])

    cuts = materialize(joined.mapInPandas(cut, "item string, range_no int, cuts array<long>, n long, longest long"), "cuts")
    # piece numbers: prefix sum of the piece counts of the ranges before, over rows without texts
    firsts = cuts.select("item", "range_no", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    numbered = cuts.join(firsts, ["item", "range_no"])
    if not with_text:
        both = numbered.select("item", "ahead", "longest", F.posexplode(F.expr("transform(sequence(0, int(n) - 1), i -> slice(cuts, 2 * i + 1, 2))")).alias("k", "c"))
        return both.select("item", (F.col("ahead") + F.col("k") + 1).alias("piece_no"), F.col("c")[0].alias("start"), F.col("c")[1].alias("end"), F.lit(None).cast("string").alias("text"), "longest")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for k, (s, e) in enumerate(zip(r.cuts[::2], r.cuts[1::2]), 1):
                    rows.append((r.item, r.ahead + k, s, e, text_of(r.slice, r.slice_start, s, e), r.longest))
            yield pd.DataFrame(rows, columns=["item", "piece_no", "start", "end", "text", "longest"])

    return ranges.join(numbered, ["item", "range_no"]).mapInPandas(emit, _PIECE)


def text_of(slice_: str, shift: int, start: int, end: int) -> str:
    """Text of [start, end); a piece that leaves its slice is an error, never an empty or shorter text."""
    if not shift <= start < end <= shift + len(slice_):
        raise RuntimeError(f"piece {start}-{end} leaves its slice {shift}-{shift + len(slice_)}")
    return slice_[start - shift : end - shift]


def whole_pieces(items: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """``pieces`` of texts of one range: cut in one pass, without any exchange."""
    shared = share_model(items.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = load_model(shared)
        for pdf in batches:
            rows = []
            for item, text, top, lap in zip(pdf["item"], pdf["text"], pdf["max_chars"], pdf["overlap_chars"]):
                _checked(top, lap, HALO)
                ends, longest = range_ends(text, 0, 0, len(text), True, m)
                for k, (s, e) in enumerate(cut_pieces(0, len(text), ends, text, 0, top, lap), 1):
                    rows.append((item, k, s, e, text[s:e] if with_text else None, longest))
            yield pd.DataFrame(rows, columns=["item", "piece_no", "start", "end", "text", "longest"])

    return items.select("item", "text", "max_chars", "overlap_chars").mapInPandas(run, _PIECE)


def limited_items(import_nodes: DataFrame, limits: DataFrame) -> DataFrame:
    """Items with their limits, without white space at both ends: item_id, text, lead (code points cut off in front),
    n_chars, max_chars, overlap_chars. Copies are one item; a null mode is 'vector'; modes without limits and null ids or
    texts have none and are left out."""
    mode = F.lower(F.trim(F.coalesce("import_mode", F.lit("vector"))))
    one = (
        import_nodes.where("item_id is not null and text is not null")
        .repartition(import_nodes.sparkSession.sparkContext.defaultParallelism * 3, "item_id")
        .groupBy("item_id")
        .agg(F.max(F.struct("text", mode.alias("mode"))).alias("r"))
        .select("item_id", "r.text", "r.mode")
    )
    known = limits.select(F.lower(F.trim("import_mode")).alias("mode"), "max_chars", "overlap_chars")  # five rows
    ws = "[" + "".join(f"\\u{ord(c):04x}" for c in _WS) + "]+"
    bare = F.regexp_replace("text", f"^{ws}", "")
    return (
        one.join(F.broadcast(known), "mode")
        .withColumns({"bare": bare, "lead": (F.length("text") - F.length(bare)).cast("long")})
        .withColumn("bare", F.regexp_replace("bare", f"{ws}$", ""))
        .select("item_id", F.col("bare").alias("text"), "lead", F.length("bare").alias("n_chars"), "max_chars", "overlap_chars")
    )


def split_items(import_nodes: DataFrame, limits: DataFrame, model: Model | None = None, with_text: bool = True) -> DataFrame:
    """Pieces of every item longer than its limit: item_id, piece_no, start_offset, end_offset (code points of the stored
    text), text, cut_kind ('forced' if some sentence alone exceeds the limit, else 'natural')."""
    items = materialize(limited_items(import_nodes, limits), "items")
    if model is None:
        model = train(spread(items.select(F.col("item_id").alias("doc_id"), "text", F.lit("txt").alias("source_type")), "doc_id", per_core=1))
    long_ones = items.where(F.col("n_chars") > F.col("max_chars"))
    work = long_ones.select(F.concat_ws(" ", "lead", "max_chars", F.col("item_id").cast("string")).alias("item"), "text", "max_chars", "overlap_chars", "n_chars")
    cut = whole_pieces(spread(work.where(F.col("n_chars") <= RANGE), "item", per_core=1), model, with_text)
    giant = work.where(F.col("n_chars") > RANGE)
    if not giant.isEmpty():
        cut = cut.unionByName(pieces(text_ranges(spread(giant, "item")), model, with_text=with_text))
    # the item's key carries what the result needs of its row, so nothing is joined back
    key = F.split("item", " ", 3)
    lead = key[0].cast("long")
    return cut.select(
        key[2].cast(items.schema["item_id"].dataType).alias("item_id"), F.col("piece_no").cast("int").alias("piece_no"),
        (F.col("start") + lead).alias("start_offset"), (F.col("end") + lead).alias("end_offset"),
        "text", F.when(F.col("longest") > key[1].cast("long"), "forced").otherwise("natural").alias("cut_kind"),
    )
