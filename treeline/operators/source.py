"""Source provenance: chunks, spans, overlaps with windows, coverage, run compression, box merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = 1024
STRIPE = 1 << 16
RUN = 256


def chunks(docs: DataFrame, size: int = 512, overlap: float = 0.1) -> DataFrame:
    """Sliding pieces of fixed size: doc_id, chunk_no, start_offset, text. Overlap is a share in 0..0.9; the last piece ends
    with the text. The positions are exploded, texts are cut by expressions."""
    step = max(1, size - int(size * min(max(overlap, 0.0), 0.9)))
    n = F.length("source_text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    at = docs.where(n > 0).select("doc_id", "source_text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return at.select("doc_id", "chunk_no", (F.col("chunk_no") * step).alias("start_offset"), F.substring("source_text", F.col("chunk_no") * step + 1, F.lit(size)).alias("text"))


def overlaps(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Spans meeting windows (doc_id, window_id, lo, hi) of the same document: window_id, id. Both sides are cut into buckets of
    ``BUCKET`` positions, so the range condition is an equi-join; a pair is kept in the bucket where the later one starts."""
    def buckets(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / F.lit(BUCKET)), F.floor((hi - 1) / F.lit(BUCKET))))

    s = spans.where("end_offset > start_offset").withColumn("bucket", buckets(F.col("start_offset"), F.col("end_offset")))
    w = windows.where("hi > lo").withColumn("bucket", buckets(F.col("lo"), F.col("hi")))
    met = s.join(w, ["doc_id", "bucket"]).where((F.col("end_offset") > F.col("lo")) & (F.col("start_offset") < F.col("hi")))
    return met.where(F.col("bucket") == F.floor(F.greatest("start_offset", "lo") / F.lit(BUCKET))).select("window_id", "id")


def points_in_spans(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, pos) inside (doc_id, id, start_offset, end_offset): doc_id, pos, id."""
    s = spans.where("end_offset > start_offset").select("*", F.explode(F.sequence(F.floor(F.col("start_offset") / BUCKET), F.floor((F.col("end_offset") - 1) / BUCKET))).alias("bucket"))
    p = points.withColumn("bucket", F.floor(F.col("pos") / BUCKET))
    return p.join(s, ["doc_id", "bucket"]).where("pos >= start_offset and pos < end_offset").select("doc_id", "pos", "id")


def next_of(asked: DataFrame, give: DataFrame) -> DataFrame:
    """As-of lookup forward, by document: for every (doc_id, at) the ``value`` of the first (doc_id, at, value) not before it:
    doc_id, at, value (null where there is none). Both sides are distinct in (doc_id, at).

    Positions are cut into runs of ``RUN``: within a run an equi-join finds it, else it is the first of the next run that has any,
    found by a window over one row a run.
    """
    run = F.floor(F.col("at") / F.lit(RUN)).alias("run")
    a, g = asked.select("doc_id", "at", run), give.select("doc_id", F.col("at").alias("g"), "value", run)
    same = a.join(g, ["doc_id", "run"]).where("g >= at").groupBy("doc_id", "at").agg(F.min_by("value", "g").alias("same"))
    firsts = g.groupBy("doc_id", "run").agg(F.min_by("value", "g").alias("first"))
    runs = a.select("doc_id", "run").unionByName(g.select("doc_id", "run")).distinct().join(firsts, ["doc_id", "run"], "left")
    behind = Window.partitionBy("doc_id").orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    later = runs.select("doc_id", "run", F.first("first", ignorenulls=True).over(behind).alias("later"))
    return a.join(same, ["doc_id", "at"], "left").join(later, ["doc_id", "run"]).select("doc_id", "at", F.coalesce("same", "later").alias("value"))


def next_span(asked: DataFrame, spans: DataFrame) -> DataFrame:
    """For every (doc_id, at) the start of the first span with sentence_index >= at (null where there is none)."""
    give = spans.where("sentence_index is not null").groupBy("doc_id", F.col("sentence_index").alias("at")).agg(F.min("start_offset").alias("value")).where("value is not null")
    found = next_of(asked.select("doc_id", "at").distinct(), give)
    return asked.select("doc_id", "at").join(found, ["doc_id", "at"], "left").withColumnRenamed("value", "start_offset")


def source_window(docs: DataFrame, spans: DataFrame, anchors: DataFrame, limit: int = 5000, before: int | None = None) -> DataFrame:
    """Text windows around anchors (doc_id, anchor): doc_id, window_start, window_end, text, n_spans.

    Before the anchor: ``before``, else min(limit / 5, 1000); what is not used there goes behind, not the other way round.
    """
    limit = min(50_000, max(1, limit))
    back = min(1000, limit // 5) if before is None else max(0, min(limit, before))
    n = F.length("source_text")
    at = F.least(n, F.greatest(F.lit(0), F.col("anchor")))
    start = F.greatest(F.lit(0), at - back)
    cut = docs.join(anchors, "doc_id").select("doc_id", "source_text", start.alias("window_start"), F.least(n, at + limit - (at - start)).alias("window_end"))
    inside = spans.join(cut.select("doc_id", "window_start", "window_end"), "doc_id").where("end_offset > window_start and start_offset < window_end")
    counts = inside.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"))
    text = F.substring("source_text", F.col("window_start") + 1, F.col("window_end") - F.col("window_start"))
    return cut.join(counts, "doc_id", "left").select("doc_id", "window_start", "window_end", text.alias("text"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def run_labels(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Runs of consecutive integers per key as '23-25;27'."""
    one = rows.select(key, value).where(F.col(value).isNotNull()).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(key).orderBy(value))
    runs = one.withColumn("island", island).groupBy(key, "island").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    label = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string")))
    return runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", label.alias("t")))), lambda x: x["t"]), ";").alias("runs"))


def _stripe(offset: Column) -> Column:
    return F.floor(offset / F.lit(STRIPE)).alias("stripe")


def merged_ranges(rows: DataFrame, key: str) -> DataFrame:
    """Overlapping or touching [start_offset, end_offset) ranges of a key merged: key, lo, hi.

    A key is cut into stripes of ``STRIPE`` positions, each ordered on its own; what crosses stripes (the farthest end so far, the
    number of merged ranges so far) is carried by windows over one row a stripe, so a document with a third of all spans is
    no single task.
    """
    r = rows.where("end_offset > start_offset").select(key, "start_offset", "end_offset", _stripe(F.col("start_offset")))
    stripes = Window.partitionBy(key).orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    far = r.groupBy(key, "stripe").agg(F.max("end_offset").alias("far")).select(key, "stripe", F.max("far").over(stripes).alias("so_far"))
    inside = Window.partitionBy(key, "stripe").orderBy("start_offset", "end_offset")
    reach = F.greatest("so_far", F.max("end_offset").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(reach.isNull() | (F.col("start_offset") > reach), 1).otherwise(0)
    marked = r.join(far, [key, "stripe"]).withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    base = marked.groupBy(key, "stripe").agg(F.sum("fresh").alias("k")).select(key, "stripe", F.coalesce(F.sum("k").over(stripes), F.lit(0)).alias("base"))
    placed = marked.join(base, [key, "stripe"]).withColumn("island", F.col("base") + F.col("nth"))
    return placed.groupBy(key, "island").agg(F.min("start_offset").alias("lo"), F.max("end_offset").alias("hi")).drop("island")


def gaps(rows: DataFrame, key: str) -> DataFrame:
    """Uncovered stretches between the ranges of a key: key, lo, hi."""
    whole = merged_ranges(rows, key).withColumn("stripe", F.floor(F.col("lo") / F.lit(STRIPE)))
    stripes = Window.partitionBy(key).orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    last = whole.groupBy(key, "stripe").agg(F.max("hi").alias("last")).select(key, "stripe", F.max("last").over(stripes).alias("earlier"))
    before = F.coalesce(F.lag("hi").over(Window.partitionBy(key, "stripe").orderBy("lo")), F.col("earlier"), F.lit(0))
    seen = whole.join(last, [key, "stripe"]).select(key, before.alias("a"), F.col("lo").alias("b"))
    return seen.where("b > a").select(key, F.col("a").alias("lo"), F.col("b").alias("hi"))


def line_boxes(chars: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Boxes of characters (key, pos, x0, y0, x1, y1) merged into one rectangle per line: neighbours in reading order whose vertical
    centres differ by at most ``tolerance`` heights stay on a line."""
    order = Window.partitionBy("key").orderBy("pos")
    centre, height = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    gap = F.abs(centre - F.lag(centre).over(order)) > F.greatest(height, F.lag(height).over(order)) * tolerance
    line = F.sum("brk").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = chars.withColumn("brk", F.coalesce(gap.cast("int"), F.lit(0))).withColumn("line", line)
    return marked.groupBy("key", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
