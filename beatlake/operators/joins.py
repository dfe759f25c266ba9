"""Joins of points and intervals in time. Intervals are half open, [start, end).

Interval joins meet on the entity and a time bucket, so a long entity spreads over many tasks; an interval is repeated for
each bucket that it touches. As-of joins are one union and running windows over (entity, time span): a single shuffle of
points and grid, no pairs. A long entity is cut into spans of time; each span starts with the last grid row before it and
ends with the first one after it, so no span reads another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatlake.sources.lineage import materialised

BUCKET_S = 8.0
#: Seconds of a span of an as-of join.
SPAN_S = 3600.0


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t / width)


def interval_join(points: DataFrame, intervals: DataFrame, by: str, time: str = "time_s", width: float = BUCKET_S, how: str = "inner", closed: bool = False) -> DataFrame:
    """Points with the intervals that hold them. intervals has `by`, start_s, end_s; `by` and time stay the points' own.
    how may be inner, left_semi or left_anti."""
    p = points.withColumn("_bucket", _bucket(F.col(time), width))
    i = intervals.withColumn("_at", F.explode(F.sequence(_bucket(F.col("start_s"), width), _bucket(F.col("end_s"), width)))).withColumnRenamed(by, "_by")
    inside = (F.col(time) >= F.col("start_s")) & ((F.col(time) <= F.col("end_s")) if closed else (F.col(time) < F.col("end_s")))
    # A join by shuffle: Spark doesn't count what explode makes of a row, and would send all of them through the driver.
    out = p.join(i.hint("merge"), (F.col(by) == F.col("_by")) & (F.col("_bucket") == F.col("_at")) & inside, how)
    return out.drop("_bucket", "_at", "_by")


def overlap_join(a: DataFrame, b: DataFrame, by: str, width: float = BUCKET_S) -> DataFrame:
    """Pairs of intervals with a.end > b.start and a.start < b.end; a has a_start, a_end and b has b_start, b_end.
    A pair that shares several buckets is kept in that of the later start alone."""
    spread = lambda df, x: df.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(f"{x}_start"), width), _bucket(F.col(f"{x}_end"), width))))
    both = spread(a, "a").join(spread(b, "b").hint("merge"), [by, "_bucket"])
    first = _bucket(F.greatest("a_start", "b_start"), width)
    return both.filter((F.col("a_end") > F.col("b_start")) & (F.col("a_start") < F.col("b_end")) & (F.col("_bucket") == first)).drop("_bucket")


def _merged(points: DataFrame, grid: DataFrame, by: str, time: str, keep: list[str], span: float) -> DataFrame:
    """Points and grid rows of an entity's span in one table; grid rows sort first at equal times. The outermost grid rows of
    each span stand in the spans between them too, where they are what comes before the first point and after the last."""
    g = grid.select(F.col(by), F.col(time), F.lit(0).alias("_kind"), F.struct(F.col(time).alias("time"), *keep).alias("_grid"), F.lit(None).cast(points.schema.simpleString()).alias("_point"), _bucket(F.col(time), span).alias("_span"))
    p = points.select(F.col(by), F.col(time), F.lit(1).alias("_kind"), F.lit(None).cast(g.schema["_grid"].dataType).alias("_grid"), F.struct(*points.columns).alias("_point"), _bucket(F.col(time), span).alias("_span"))
    # One row for each span of an entity that holds grid rows or points: its outermost grid rows, field by field, as Spark sorts all rows
    # for an aggregate that is a struct.
    fields = grid.select(F.col(by), F.col(time), F.col(time).alias("_time"), *keep, _bucket(F.col(time), span).alias("_span")).filter(F.col(time).isNotNull())
    outer = lambda of: F.struct(of("_time", time).alias("time"), *(of(k, time).alias(k) for k in keep))
    ends = fields.groupBy(by, "_span").agg(outer(F.min_by).alias("_first"), outer(F.max_by).alias("_last"))
    used = ends.unionByName(p.filter(F.col(time).isNotNull()).select(by, "_span").distinct(), allowMissingColumns=True).groupBy(by, "_span").agg(F.first("_first", ignorenulls=True).alias("_first"), F.first("_last", ignorenulls=True).alias("_last"))
    down, up = Window.partitionBy(by).orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    beside = used.select(by, "_span", F.last("_last", ignorenulls=True).over(up).alias("_before"), F.last("_first", ignorenulls=True).over(down).alias("_after"))
    beside = beside.select(by, "_span", F.explode(F.array("_before", "_after")).alias("_grid")).filter("_grid is not null")
    lead = beside.select(F.col(by), F.col("_grid.time").alias(time), F.lit(0).alias("_kind"), "_grid", F.lit(None).cast(points.schema.simpleString()).alias("_point"), "_span")
    return g.unionByName(lead).unionByName(p)


def asof_backward(points: DataFrame, grid: DataFrame, by: str, time: str = "time_s", keep: list[str] | None = None, span: float = SPAN_S) -> DataFrame:
    """Points with the last grid row at or before them, as struct `grid` (null before the first)."""
    w = Window.partitionBy(by, "_span").orderBy(time, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = _merged(points, grid, by, time, keep or [], span).withColumn("grid", F.last("_grid", ignorenulls=True).over(w))
    return out.filter("_kind = 1").select("_point.*", "grid")


def between(points: DataFrame, grid: DataFrame, by: str, time: str, keep: list[str], span: float = SPAN_S) -> DataFrame:
    """Points (in `_point`, where `_kind` is 1) with the grid rows around them, `_before` and `_after`."""
    both = _merged(points, grid, by, time, keep, span)
    # One order, so one sort, gives both sides: the last grid row so far, and the next one unless that stands at the point itself.
    w = Window.partitionBy(by, "_span").orderBy(time, "_kind")
    both = both.withColumns({"_before": F.last("_grid", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.expr("lead(_grid) IGNORE NULLS").over(w)})
    return both.withColumn("_after", F.when(F.col("_before.time") == F.col(time), F.col("_before")).otherwise(F.col("_after")))


def asof_nearest(points: DataFrame, grid: DataFrame, by: str, time: str = "time_s", keep: list[str] | None = None, span: float = SPAN_S) -> DataFrame:
    """Points with the nearest grid row as struct `grid` and the signed error_s; the earlier one of equals."""
    both = between(points, grid, by, time, keep or [], span)
    t = F.col(time)
    nearer = F.col("_before").isNull() | (F.col("_after.time") - t < t - F.col("_before.time"))
    out = both.filter("_kind = 1").withColumn("grid", F.when(nearer & F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("_before")))
    return out.withColumn("_error", t - F.col("grid.time")).select("_point.*", "grid", F.col("_error").alias("error_s"))


def running_max(rows: DataFrame, by: str, order: list[str], values: dict[str, tuple[Column, bool]], span: float = SPAN_S) -> DataFrame:
    """rows with, by name, the greatest value so far among an entity's rows in their order (of which the first column is time):
    of the rows before alone, or of the row itself too where the second entry is true. Times that grow with the order give
    the last one so far. A long entity is cut into spans: each has the greatest values of the spans before it from a table with a
    row for each span, so spans go to different tasks."""
    known = {f"_v{k}": v for k, (v, _) in enumerate(values.values())}
    cut = rows.withColumns({"_span": _bucket(F.col(order[0]), span), **known})
    ends = cut.groupBy(F.col(by).alias("_by"), F.col("_span").alias("_of")).agg(*(F.max(v).alias(v) for v in known))
    w = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_by", "_of", *(F.max(v).over(w).alias(f"{v}_") for v in known))
    both = cut.join(before, F.col(by).eqNullSafe(F.col("_by")) & F.col("_span").eqNullSafe(F.col("_of")))
    own = Window.partitionBy(by, "_span").orderBy(*order)
    out = {name: F.greatest(f"{v}_", F.max(v).over(own.rowsBetween(Window.unboundedPreceding, 0 if itself else -1))) for v, (name, (_, itself)) in zip(known, values.items())}
    return both.withColumns(out).select(*rows.columns, *values)


def parts(rows: DataFrame, by: str, order: list[str], lo: Column, hi: Column) -> DataFrame:
    """rows with `_part`, a number of a stretch of an entity's rows: a new one begins at a row whose lo is over the hi of all rows
    before it. What is decided inside of [lo, hi] never crosses from one part to another."""
    known = materialised(rows.withColumns({"_lo": lo, "_hi": hi}))  # read several times below
    reach = running_max(known, by, order, {"_reach": (F.col("_hi"), False)})
    first = F.when(F.coalesce(F.col("_reach") < F.col("_lo"), F.lit(True)), F.col(order[0]).cast("double"))
    return running_max(reach, by, order, {"_part": (first, True)}).drop("_lo", "_hi", "_reach")


def proximity_semi(points: DataFrame, events: DataFrame, by: str, tolerance: float = 0.25, time: str = "time_s", strict: bool = False) -> DataFrame:
    """Points with an event within the tolerance (inclusive unless strict)."""
    near = asof_nearest(points, events, by, time)
    apart = F.abs("error_s")
    return near.filter((apart < tolerance) if strict else (apart <= tolerance)).drop("grid", "error_s")


def timing_check(words: DataFrame, onsets: DataFrame, by: str, duration: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """By entity, the share of word starts near an onset over the share that chance gives (the union of windows around
    onsets over the duration); reliable from 1.3 on with 15 words. duration has `by` and duration_s."""
    near = asof_nearest(words, onsets, by).groupBy(by).agg(F.avg((F.abs("error_s") <= tolerance).cast("double")).alias("share"), F.count(F.lit(1)).alias("n_words"))
    w = Window.partitionBy(by).orderBy("time_s")
    fresh = F.least(F.lit(2 * tolerance), F.coalesce(F.col("time_s") - F.lag("time_s").over(w), F.lit(2 * tolerance)))
    covered = onsets.withColumn("_new", fresh).groupBy(by).agg(F.sum("_new").alias("covered_s"))
    out = near.join(covered, by).join(duration, by)
    lift = F.col("share") / F.least(F.lit(1.0), F.col("covered_s") / F.col("duration_s"))
    return out.withColumn("lift", lift).withColumn("reliable", (F.col("lift") >= 1.3) & (F.col("n_words") >= 15))


def onsets_in_phrases(onsets: DataFrame, phrases: DataFrame, by: str, duration: DataFrame) -> DataFrame:
    """Onsets inside any phrase, both ends closed, and the syllable rate over the phrases' seconds (the whole duration
    where there is none)."""
    inside = interval_join(onsets, phrases.select(by, "start_s", "end_s"), by, how="left_semi", closed=True)
    counts = inside.groupBy(by).agg(F.count(F.lit(1)).alias("n_inside"))
    sung = phrases.groupBy(by).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("sung_s"))
    every = onsets.groupBy(by).agg(F.count(F.lit(1)).alias("n_all"))
    out = every.join(counts, by, "left").join(sung, by, "left").join(duration, by, "left")
    inside = F.coalesce("n_inside", F.lit(0))
    return out.withColumn("syllable_rate", F.when(F.col("sung_s") > 0, inside / F.col("sung_s")).otherwise(F.col("n_all") / F.col("duration_s")))
