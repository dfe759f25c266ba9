"""Aggregations that profile takes and beats. Medians and percentiles are exact; `approximate=True` on the frame
aggregates trades that for percentile_approx on very long tables. Empty groups give null, never 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatlake import constants as C
from beatlake.functions.scalars import clip, range_score
from beatlake.operators.joins import SPAN_S, asof_backward, asof_nearest, interval_join


def percentile(x: Column | str, p: float, approximate: bool = False) -> Column:
    return F.percentile_approx(x, p) if approximate else F.percentile(x, p)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, of two arrays of one length; null if one is flat."""
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ma, mb = total(a) / n, total(b) / n
    cross = F.aggregate(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)), F.lit(0.0), lambda s, v: s + v)
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))), total(F.transform(b, lambda x: (x - mb) * (x - mb)))
    return F.when((va > 0) & (vb > 0), cross / F.sqrt(va * vb))


def _unit(profile: tuple, pc: int) -> list[float]:
    """A key's template, centred and of length 1."""
    x = [float(profile[(k - pc) % 12]) for k in range(12)]
    centred = [v - sum(x) / 12 for v in x]
    length = sum(v * v for v in centred) ** 0.5
    return [v / length for v in centred]


def key_of_histogram(histograms: DataFrame, by: str) -> DataFrame:
    """A1, K6: by, bins (12 numbers) -> the best key, its correlation, the confidence, and the five best keys. Against templates
    of length 1 a correlation is one dot product over the length of the centred bins: 24 of them in plain columns."""
    bins = [f"_b{k}" for k in range(12)]
    x = histograms.select(by, *(F.col("bins")[k].cast("double").alias(name) for k, name in enumerate(bins)))
    mean = sum((F.col(b) for b in bins[1:]), F.col(bins[0])) / 12
    x = x.withColumn("_mean", mean).select(by, *((F.col(b) - F.col("_mean")).alias(b) for b in bins))
    x = x.withColumn("_length", F.sqrt(sum((F.col(b) * F.col(b) for b in bins[1:]), F.col(bins[0]) * F.col(bins[0])))).filter("_length > 0")
    score = lambda unit: F.round(sum((F.col(b) * u for b, u in zip(bins[1:], unit[1:])), F.col(bins[0]) * unit[0]) / F.col("_length"), 9)
    keys = [F.struct(score(_unit(profile, pc)).alias("r"), F.lit(-pc).alias("n"), F.lit(mode).alias("key_mode")) for mode, profile in (("major", C.KK_MAJOR), ("minor", C.KK_MINOR)) for pc in range(12)]
    ranked = x.select(by, F.slice(F.sort_array(F.array(*keys), asc=False), 1, 5).alias("x"))
    best, second = F.col("x")[0]["r"], F.col("x")[1]["r"]
    top = F.transform("x", lambda k: F.struct((-k["n"]).alias("pc"), k["key_mode"].alias("mode"), k["r"].alias("score")))
    return ranked.select(by, (-F.col("x")[0]["n"]).alias("key_pc"), F.col("x")[0]["key_mode"].alias("key_mode"), best.alias("correlation"), clip((best - second) * 4 + best * 0.4, 0.0, 1.0).alias("confidence"), top.alias("candidates"))


def key_profile(notes: DataFrame, by: str = "take_id") -> DataFrame:
    """A1: from the time that notes spend in each pitch class."""
    pc = F.pmod(F.bround("midi").cast("int"), F.lit(12))
    sums = notes.groupBy(by).agg(*(F.sum(F.when(pc == k, F.col("duration_s")).otherwise(0.0)).alias(f"_{k}") for k in range(12)))
    return key_of_histogram(sums.select(by, F.array(*(F.col(f"_{k}") for k in range(12))).alias("bins")), by)


def atonality(frames: DataFrame, by: str, harmonic: Column | float = 0.5) -> DataFrame:
    """A5: chroma (12 numbers) frames: the median share of the three greatest bins; .55 of its lack and .45 of the lack of
    harmonicity; atonal from .62."""
    total = F.aggregate("chroma", F.lit(0.0), lambda s, v: s + v)
    top = F.aggregate(F.slice(F.sort_array("chroma", asc=False), 1, 3), F.lit(0.0), lambda s, v: s + v)
    conc = frames.filter(total > 0).groupBy(by).agg(F.percentile(top / total, 0.5).alias("concentration"))
    score = 0.55 * (1 - clip((F.col("concentration") - 0.25) / 0.5, 0.0, 1.0)) + 0.45 * (1 - (harmonic if isinstance(harmonic, Column) else F.lit(harmonic)))
    return conc.withColumn("atonality", score).withColumn("is_atonal", F.col("atonality") >= 0.62)


def tempo_histogram(onsets: DataFrame, by: str, *tie: str) -> DataFrame:
    """Intervals of .08 to 2 s as tempi in 60 bins of 30 to 330, the fullest bin (the first of equals), refined by the median
    from a bin under to two bins over it, folded to 50-210; confidence from the bin's share."""
    from beatlake.operators.sequences import ioi

    tempi = ioi(onsets, by, *tie).filter("ioi_s > 0.08 and ioi_s < 2.0").select(by, (60 / F.col("ioi_s")).alias("t"))
    tempi = tempi.withColumn("bin", F.least(F.lit(59), F.floor((F.col("t") - 30) / 5).cast("int")))
    counts = tempi.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(by).agg(F.max(F.struct("n", (-F.col("bin")).alias("m"))).alias("b"), F.sum("n").alias("total"))
    mode = -F.col("b.m")
    near = tempi.join(best.select(by, mode.alias("peak"), F.col("b.n").alias("at"), "total"), by).filter("bin >= peak - 1 and bin < peak + 2")
    out = near.groupBy(by, "peak", "at", "total").agg(F.percentile("t", 0.5).alias("median"), F.count(F.lit(1)).alias("n_near"))
    raw = F.when(F.col("n_near") >= 3, F.col("median")).otherwise(30 + 5 * F.col("peak") + 2.5)
    fold = F.when(raw < 50, raw * 2).when(raw > 210, raw / 2).otherwise(raw)
    return out.select(by, fold.alias("bpm"), F.least(2.2 * F.col("at") / F.col("total"), F.lit(0.75)).alias("confidence"))


def lag_histogram(onsets: DataFrame, by: str, most_s: float = 2.0, bin_s: float = 0.005, *tie: str) -> DataFrame:
    """Differences of all pairs of onsets up to most_s apart, counted in bins. Pairs meet in time buckets of most_s."""
    left = onsets.select(by, F.col("time_s").alias("a"), F.floor(F.col("time_s") / most_s).alias("_k"))
    right = onsets.select(by, F.col("time_s").alias("b"), F.explode(F.array(F.floor(F.col("time_s") / most_s), F.floor(F.col("time_s") / most_s) - 1)).alias("_k"))
    pairs = left.join(right, [by, "_k"]).filter((F.col("b") > F.col("a")) & (F.col("b") - F.col("a") <= most_s))
    return pairs.groupBy(by, F.floor((F.col("b") - F.col("a")) / bin_s).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def tempo_autocorr(onsets: DataFrame, by: str, bin_s: float = 0.005) -> DataFrame:
    """The first lag from 60/210 s on whose smoothed count is a local peak of at least 0.6 of the greatest."""
    h = lag_histogram(onsets, by, 2.0, bin_s)
    kernel = {0: 1.0, 1: 0.8825, 2: 0.6065, 3: 0.3247, 4: 0.1353}  # a Gaussian of two bins
    spread = h.select(by, F.explode(F.array(*(F.struct((F.col("bin") + k).alias("bin"), (F.col("n") * w).alias("w")) for j, w in kernel.items() for k in {j, -j}))).alias("x"))
    smooth = spread.groupBy(by, F.col("x.bin").alias("bin")).agg(F.round(F.sum("x.w"), 4).alias("w")).filter((F.col("bin") * bin_s >= 60 / 210) & (F.col("bin") * bin_s <= 2.0))
    w = Window.partitionBy(by).orderBy("bin")
    near = lambda f: F.when(f("bin").over(w) == F.col("bin") + (1 if f is F.lead else -1), f("w").over(w)).otherwise(0.0)
    peaks = smooth.withColumns({"_l": near(F.lag), "_r": near(F.lead), "_top": F.max("w").over(Window.partitionBy(by))}).filter((F.col("w") >= 0.6 * F.col("_top")) & (F.col("w") >= F.col("_l")) & (F.col("w") > F.col("_r")))
    first = peaks.groupBy(by).agg(F.min(F.struct("bin", (F.col("w") / F.col("_top")).alias("strength"))).alias("m")).select(by, ((F.col("m.bin") + 0.5) * bin_s).alias("period_s"), "m.strength")
    return first.select(by, "period_s", (60 / F.col("period_s")).alias("bpm"), "strength")


def tempo(onsets: DataFrame, by: str, *tie: str) -> DataFrame:
    """A6 and A7 of each entity, reconciled, as struct `tempo`. The strength of A7 is its peak's share of the greatest."""
    from beatlake.functions.music import reconciled_tempo

    n = onsets.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    h = tempo_histogram(onsets, by, *tie).withColumnsRenamed({"bpm": "_h", "confidence": "_hc"})
    a = tempo_autocorr(onsets, by).select(by, F.col("bpm").alias("_a"), F.col("strength").alias("_s"))
    x = n.join(h, by, "left").join(a, by, "left")
    return x.select(by, reconciled_tempo(F.col("_h"), F.coalesce("_hc", F.lit(0.0)), F.col("_a"), F.coalesce("_s", F.lit(0.0)), F.col("_n")).alias("tempo"))


def grid_fit(onsets: DataFrame, grids: DataFrame, by: list[str], how: str = "median") -> DataFrame:
    """Error of onsets to the nearest line of each grid; by names the entity and, if several, the hypothesis."""
    key = by[0] if len(by) == 1 else "_key"
    o, g = (onsets, grids) if len(by) == 1 else (onsets.withColumn("_key", F.struct(*by)), grids.withColumn("_key", F.struct(*by)))
    near = asof_nearest(o, g, key).filter("error_s is not null")
    size = F.abs("error_s")
    return near.groupBy(*by).agg((F.percentile(size, 0.5) if how == "median" else F.avg(size)).alias("fit_error_s"), F.count(F.lit(1)).alias("n"))


def _runs(batch: pa.RecordBatch, n_keys: int) -> list[tuple[int, int]]:
    """Starts and stops of runs of rows with equal first columns."""
    new = np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
    for k in range(n_keys):
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def tempo_ratio_search(pairs: DataFrame, by: str, lo: float = 0.96, hi: float = 1.04, steps: int = 801) -> DataFrame:
    """A10: time_s and slot_s (seconds per slot): the ratio whose scaled onsets lie nearest to whole slots on the average, with
    a slight cost for moving; the smallest of equal ones. Onsets without time or slot are passed over.

    Onsets meet by entity and span of time, where a task adds up an array with an error for each ratio; an entity's arrays, one
    for each span, are then added up. No onset is repeated, and a task holds one array.
    """
    ratios = np.array([round(lo + (hi - lo) * k / (steps - 1), 6) for k in range(steps)])
    kind = pairs.schema[by].dataType.simpleString()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n, own = None, np.zeros(steps), 0, None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], own), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=[by, "n", "errors"])

        for batch in batches:
            own, out = batch.schema.field(0).type, []
            t, slot = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for start, stop in _runs(batch, 2):
                this = (batch.column(0)[start].as_py(), batch.column(1)[start].as_py())
                if this != key:
                    if n:
                        out.append((key[0], n, total.tobytes()))
                    key, total, n = this, np.zeros(steps), 0
                for a in range(start, stop, 2048):
                    b = min(a + 2048, stop)
                    at = t[a:b, None] * ratios / slot[a:b, None]
                    total += (np.abs(at - np.rint(at)) * slot[a:b, None]).sum(axis=0)
                n += stop - start
            yield told(out)
        if n:
            yield told([(key[0], n, total.tobytes())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, n, own = None, np.zeros(steps), 0, None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], own), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], names=[by, "ratio", "cost"])

        def choice() -> tuple:
            cost = np.round(total / n + 1e-4 * np.abs(ratios - 1), 9)
            return (key, float(ratios[cost.argmin()]), float(cost.min()))

        for batch in batches:
            own, out = batch.schema.field(0).type, []
            for this, count, errors in zip(*(c.to_pylist() for c in batch.columns)):
                if n and this != key:
                    out.append(choice())
                    total, n = np.zeros(steps), 0
                key, total, n = this, total + np.frombuffer(errors), n + count
            yield told(out)
        if n:
            yield told([choice()])

    rows = pairs.filter("time_s IS NOT NULL AND slot_s IS NOT NULL").select(by, F.floor(F.col("time_s") / SPAN_S).alias("_span"), F.col("time_s").cast("double"), F.col("slot_s").cast("double"))
    sums = rows.repartition(by, "_span").sortWithinPartitions(by, "_span").mapInArrow(summed, f"`{by}` {kind}, n long, errors binary")
    return sums.repartition(by).sortWithinPartitions(by).mapInArrow(best, f"`{by}` {kind}, ratio double, cost double")


def residual_drift(pairs: DataFrame, by: str) -> DataFrame:
    """Least squares of error_s on time_s."""
    return pairs.groupBy(by).agg(F.regr_slope("error_s", "time_s").alias("slope"), F.regr_intercept("error_s", "time_s").alias("intercept"))


def grid_stability(beats: DataFrame, by: str, *tie: str) -> DataFrame:
    """1 less four times the coefficient of variation of the intervals; and the median tempo."""
    from beatlake.operators.sequences import ioi

    x = ioi(beats, by, *tie).filter("ioi_s > 0")
    return x.groupBy(by).agg(clip(1 - 4 * F.stddev_pop("ioi_s") / F.avg("ioi_s"), 0.0, 1.0).alias("stability"), F.percentile(60 / F.col("ioi_s"), 0.5).alias("median_bpm"))


def swing(onsets: DataFrame, beats: DataFrame, by: str) -> DataFrame:
    """Where off-beats fall in the beat: phases in [.42, .73) in 24 bins, the centroid about the fullest; .5 if there are
    fewer than four."""
    w = Window.partitionBy(by).orderBy("time_s")
    spans = beats.withColumn("len", F.lead("time_s").over(w) - F.col("time_s"))
    at = asof_backward(onsets, spans, by, keep=["len"]).withColumn("phase", (F.col("time_s") - F.col("grid.time")) / F.col("grid.len")).filter("phase >= 0.42 and phase < 0.73")
    bins = at.withColumn("bin", F.floor((F.col("phase") - 0.42) / (0.31 / 24)).cast("int")).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("phase").alias("p"))
    peak = bins.groupBy(by).agg(F.max(F.struct("n", (-F.col("bin")).alias("m"))).alias("b"), F.sum("n").alias("total"))
    near = bins.join(peak.select(by, (-F.col("b.m")).alias("peak"), "total"), by).filter(F.abs(F.col("bin") - F.col("peak")) <= 1)
    out = near.groupBy(by, "total").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("c"))
    return beats.select(by).distinct().join(out, by, "left").select(by, F.when(F.col("total") >= 4, clip(F.col("c"), 0.30, 0.78)).otherwise(0.5).alias("swing"))


def groove(onsets: DataFrame, bars: DataFrame, by: str, slots: int = 16, extra: tuple[str, ...] = ()) -> DataFrame:
    """By slot (and element, if `extra` names it): onsets within .4 of a slot and 90 ms of it, three at least; those
    beyond max(15 ms, 2.5 x 1.4826 MAD) of the median are left out; weighted mean offset and velocity. Bars of less than half
    or more than twice the median bar are skipped."""
    w = Window.partitionBy(by).orderBy("time_s")
    spans = bars.withColumn("len", F.lead("time_s").over(w) - F.col("time_s")).withColumn("_m", F.percentile("len", 0.5).over(Window.partitionBy(by))).filter("len >= 0.5 * _m and len <= 2 * _m")
    at = asof_backward(onsets, spans, by, keep=["len"]).filter(F.col("grid").isNotNull() & (F.col("time_s") < F.col("grid.time") + F.col("grid.len")))
    rel = (F.col("time_s") - F.col("grid.time")) / F.col("grid.len") * slots
    slot = F.pmod(F.bround(rel).cast("int"), F.lit(slots))
    off = (F.col("time_s") - F.col("grid.time") - slot * F.col("grid.len") / slots) * 1000
    keys = [by, *extra, "slot"]
    obs = at.withColumns({"slot": slot, "off": off}).filter((F.abs("off") <= 90) & (F.abs("off") <= 0.4 * F.col("grid.len") / slots * 1000)).select(*keys, "off", F.col("strength").alias("v"))
    middle = obs.groupBy(*keys).agg(F.percentile("off", 0.5).alias("med"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    dev = obs.join(middle.select(*keys, "med"), keys).withColumn("d", F.abs(F.col("off") - F.col("med")))
    spread = dev.groupBy(*keys).agg(F.percentile("d", 0.5).alias("mad"))
    kept = dev.join(spread, keys).filter(F.col("d") <= F.greatest(F.lit(15.0), 2.5 * 1.4826 * F.col("mad")))
    out = kept.groupBy(*keys).agg((F.sum(F.col("off") * F.greatest("v", F.lit(1e-6))) / F.sum(F.greatest("v", F.lit(1e-6)))).alias("offset_ms"), F.avg("v").alias("_v"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("velocity", F.col("_v") / F.max("_v").over(Window.partitionBy(by, *extra))).drop("_v")


def timing_bias(onsets: DataFrame, grid: DataFrame, by: str, within_s: float = 0.09) -> DataFrame:
    """Median and spread of the signed error within 90 ms."""
    near = asof_nearest(onsets, grid, by).filter(F.abs("error_s") <= within_s)
    return near.groupBy(by).agg(F.percentile("error_s", 0.5).alias("bias_s"), F.stddev_pop("error_s").alias("spread_s"), F.count(F.lit(1)).alias("n"))


def vocal_state(notes: DataFrame, levels: DataFrame, by: str = "take_id") -> DataFrame:
    """The share of note time within 20 cents of a semitone, whether the take is tuned, and whether it is finished too (an
    even level, spread_db in levels). Where notes have their place in the table, `_at`, times are added up in its order, so the share
    doesn't depend on partitions."""
    cents = F.abs(F.col("midi") - F.bround("midi")) * 100
    good, share = F.when(cents <= 20, F.col("duration_s")).otherwise(0.0), F.sum("_good") / F.sum("duration_s")
    notes = notes.withColumn("_good", good)
    if "_at" in notes.columns:
        w = Window.partitionBy(by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        notes = notes.withColumns({"_good": F.sum("_good").over(w), "_all": F.sum("duration_s").over(w)})
        share = F.max_by("_good", "_at") / F.max_by("_all", "_at")
    x = notes.groupBy(by).agg(share.alias("in_tune"), F.percentile(cents, 0.5).alias("deviation"), F.count(F.lit(1)).alias("n")).join(levels, by, "left")
    tuned = (F.col("in_tune") >= 0.55) | ((F.col("deviation") > 0) & (F.col("deviation") <= 22) & (F.col("n") >= 12))
    finished = tuned & F.coalesce((F.col("spread_db") > 0) & (F.col("spread_db") <= 1.5), F.lit(False))
    return x.withColumn("state", F.when(finished, "finished").when(tuned, "tuned").otherwise("raw"))


def noise_verdict(frames: DataFrame, by: str, inside: str, approximate: bool = False) -> DataFrame:
    """Median level inside phrases less that in gaps (85th less 15th percentile with fewer than four frames of
    either), a verdict, and the noise floor (8th percentile). Under eight frames nothing is known."""
    from beatlake.operators.sequences import quantile, ranked

    p = lambda x, q: percentile(x, q, approximate)
    db = F.col("rms_db")
    known = frames if approximate else ranked(frames, by, "rms_db")
    whole = lambda q: p(db, q) if approximate else quantile("rms_db", q)
    x = known.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(inside)).alias("n_in"), p(F.when(F.col(inside), db), 0.5).alias("_in"), p(F.when(~F.col(inside), db), 0.5).alias("_out"), whole(0.85).alias("_hi"), whole(0.15).alias("_lo"), whole(0.08).alias("floor_db")
    )
    both = (F.col("n_in") >= 4) & (F.col("n") - F.col("n_in") >= 4)
    snr = F.when(F.col("n") >= 8, F.when(both, F.col("_in") - F.col("_out")).otherwise(F.col("_hi") - F.col("_lo")))
    verdict = F.when(snr.isNull(), "unknown")
    for name, least in C.NOISE[:-1]:
        verdict = verdict.when(snr >= least, name)
    return x.select(by, snr.alias("snr_db"), verdict.otherwise(C.NOISE[-1][0]).alias("verdict"), "floor_db")


def voice_presence(frames: DataFrame, by: str, inside: str, chance: str) -> DataFrame:
    """The share of speech frames among those in phrases; under .05 there is no voice."""
    x = frames.filter(F.col(inside)).groupBy(by).agg(F.avg((F.col(chance) > 0.5).cast("double")).alias("presence"))
    return x.withColumn("verdict", F.when(F.col("presence") < 0.05, "no_voice").otherwise("voice"))


def take_report(frames: DataFrame, by: str = "take_id", approximate: bool = False) -> DataFrame:
    """One pass over a take's frames (time_s, rms_db, peak_db, clipped, is_voice): measures, usable, and grade by the number
    of warnings. The floor needs ten quiet frames, else it and the signal-to-noise ratio are null."""
    p = lambda x, q: percentile(x, q, approximate)
    voiced, db = F.col("is_voice"), F.col("rms_db")
    x = frames.groupBy(by).agg(
        F.max("time_s").alias("duration_s"), F.count(F.lit(1)).alias("n"), F.count_if(voiced).alias("n_voiced"), F.max("peak_db").alias("peak_db"), (100 * F.avg(F.col("clipped").cast("double"))).alias("clipped_pct"),
        p(F.when(voiced, db), 0.5).alias("rms_db"), F.when(F.count_if(~voiced) >= 10, p(F.when(~voiced, db), 0.5)).alias("floor_db"), (p(F.when(voiced, db), 0.9) - p(F.when(voiced, db), 0.1)).alias("level_spread_db"),
    )
    x = x.withColumn("snr_db", F.col("rms_db") - F.col("floor_db"))
    fatal = (F.col("n_voiced") == 0) | (F.col("clipped_pct") > 0.5) | F.coalesce(F.col("snr_db") < 6, F.lit(False))
    warns = ((F.col("clipped_pct") > 0.02) & (F.col("clipped_pct") <= 0.5)).cast("int") + F.coalesce((F.col("snr_db") < 12) & (F.col("snr_db") >= 6), F.lit(False)).cast("int") + (F.col("peak_db") < -20).cast("int")
    return x.withColumn("usable", ~fatal).withColumn("grade", F.when(fatal, "unusable").when(warns > 1, "rough").when(warns == 1, "ok").otherwise("good"))


def rank_takes(reports: DataFrame, group: str) -> DataFrame:
    """K3: usable first, then grade, signal to noise, and less clipping."""
    order = F.when(F.col("grade") == "excellent", 0).when(F.col("grade") == "good", 1).when(F.col("grade") == "ok", 2).when(F.col("grade") == "rough", 3).otherwise(4)
    w = Window.partitionBy(group).orderBy(F.desc("usable"), order, F.desc_nulls_last("snr_db"), "clipped_pct", "take_id")
    return reports.withColumn("place", F.row_number().over(w))


def intelligibility(words: DataFrame, by: str) -> DataFrame:
    """The share of words with probability .4 and more: clear from .8, muddy from .5."""
    x = words.groupBy(by).agg(F.avg((F.col("probability") >= 0.4).cast("double")).alias("confident"), F.count(F.lit(1)).alias("n_words"))
    return x.withColumn("verdict", F.when(F.col("confident") >= 0.8, "clear").when(F.col("confident") >= 0.5, "muddy").otherwise("unclear"))


BANDS = {"sub": (20, 60), "low": (60, 250), "low_mid": (250, 800), "mid": (800, 4000), "air": (4000, 20_000)}


def spectral_bands(bins: DataFrame, by: str) -> DataFrame:
    """Shares of power by band, room for a voice (220-4000 Hz) and clarity (1-4 kHz over 150-500 Hz, up to 2)."""
    power, hz = F.pow(F.lit(10.0), F.col("mag_db") / 10), F.col("freq_hz")
    inside = lambda lo, hi: F.sum(F.when((hz >= lo) & (hz < hi), power).otherwise(0.0))
    x = bins.groupBy(by).agg(*(inside(*v).alias(f"_{k}") for k, v in BANDS.items()), inside(220, 4000).alias("_v"), inside(1000, 4000).alias("_hi"), inside(150, 500).alias("_lo"), F.sum(power).alias("_all"))
    shares = [(F.col(f"_{k}") / F.col("_all")).alias(k) for k in BANDS]
    return x.select(by, *shares, clip(1 - (F.col("_v") / F.col("_all") - 0.10) / 0.38, 0.0, 1.0).alias("pocket"), F.when(F.col("_lo") > 0, clip(F.col("_hi") / F.col("_lo"), 0.0, 2.0)).alias("clarity"))


def voice_profile(f0: DataFrame, by: str) -> DataFrame:
    """5th, 50th and 95th percentile of voiced pitch, the range and the voice type."""
    from beatlake.functions.music import voice_type
    from beatlake.functions.scalars import midi_to_hz

    x = f0.filter("voiced").groupBy(by).agg(F.percentile("midi", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("p"))
    return x.select(by, F.col("p")[0].alias("low"), F.col("p")[1].alias("median"), F.col("p")[2].alias("high"), (F.col("p")[2] - F.col("p")[0]).alias("range"), voice_type(midi_to_hz(F.col("p")[1])).alias("voice"))


def note_velocity(notes: DataFrame, by: str) -> DataFrame:
    """From each note's level against the take's median; .7 for takes of fewer than six notes."""
    w = Window.partitionBy(by)
    rows = notes.withColumns({"_m": F.percentile("level_db", 0.5).over(w), "_n": F.count(F.lit(1)).over(w)})
    return rows.withColumn("velocity", F.when(F.col("_n") < 6, 0.7).otherwise(clip(0.7 + (F.col("level_db") - F.col("_m")) / 30, 0.0, 1.0))).drop("_m", "_n")


def classify_performance(notes: DataFrame, rates: DataFrame, by: str = "take_id") -> DataFrame:
    """Rap, melodic rap, sung or spoken. rates has syllable_rate."""
    x = rates.join(notes.groupBy(by).agg(F.percentile("duration_s", 0.5).alias("note_s"), F.stddev_pop("midi").alias("spread"), F.avg((F.col("duration_s") > 0.30).cast("double")).alias("held"), F.count(F.lit(1)).alias("n")), by, "left")
    rate = F.col("syllable_rate")
    made = lambda label, c: F.struct(F.lit(label).alias("label"), F.lit(c).alias("confidence"))
    fast = (rate > 3.6) & (F.col("note_s") < 0.16)
    verdict = F.when(F.col("n").isNull(), F.when(rate >= 2, made("rap", 0.3)).otherwise(made("spoken", 0.3))).when(fast & (F.col("spread") < 2.6), made("rap", 0.85)).when(fast, made("melodic_rap", 0.85)).when((F.col("held") > 0.34) & (F.col("spread") > 2), made("sung", 0.85)).when(rate > 2.6, made("melodic_rap", 0.5)).otherwise(made("sung", 0.45))
    return x.select(by, verdict.alias("v")).select(by, F.col("v.label").alias("performance_type"), F.col("v.confidence").alias("confidence"))


def genre_scores(tracks: DataFrame, by: str) -> DataFrame:
    """Tracks with the eight features (hat_density and onset_rate 0 or null if not measured) and a tag, against the
    templates, which are literals: genre, score, margin, runner_up, usable."""
    made = []
    for name, t in C.TEMPLATES.items():
        lo, hi = t["bpm"]
        tempo = lambda x: range_score(x, F.lit(float(lo)), F.lit(float(hi)), F.lit((hi - lo) * 0.5 + 6.0))  # noqa: E731,B023
        bpm = F.greatest(tempo(F.col("bpm")), tempo(F.col("bpm") * 2), tempo(F.col("bpm") * 0.5)) if t["half"] else tempo(F.col("bpm"))
        total, weight = bpm * C.BPM_WEIGHT, F.lit(C.BPM_WEIGHT)
        for f, (tol, w) in {**C.GENRE_FEATURES, **C.GENRE_RHYTHM}.items():
            score = range_score(F.col(f), F.lit(float(t[f][0])), F.lit(float(t[f][1])), F.lit(tol))
            known = F.coalesce(F.col(f) > 0, F.lit(False)) if f in C.GENRE_RHYTHM else F.lit(True)
            total, weight = total + F.when(known, score * w).otherwise(0.0), weight + F.when(known, w).otherwise(0.0)
        made.append(F.struct(F.round(clip(total / weight * t["prior"], 0.0, 1.0), 9).alias("score"), F.lit(-len(made)).alias("order"), F.lit(name).alias("genre")))
    family = {"trap": "hip_hop", "drill": "hip_hop", "hip_hop": "hip_hop", "lofi": "hip_hop", "rnb": "soul", "pop": "pop", "afrobeats": "pop", "drum_and_bass": "electronic"}
    from beatlake.functions.scalars import mapped

    x = tracks.withColumn("_x", F.sort_array(F.array(*made), asc=False))
    best, second = F.col("_x")[0], F.col("_x")[1]
    margin = best["score"] - second["score"]
    usable = (best["score"] >= C.GENRE_SCORE) & ((margin >= C.GENRE_MARGIN) | (mapped(family)[best["genre"]] == mapped(family)[second["genre"]]))
    tag = F.when(F.col("tag").isin(*C.TEMPLATES), F.col("tag"))
    return x.select(by, F.coalesce(tag, best["genre"]).alias("genre"), F.when(tag.isNotNull(), 1.0).otherwise(best["score"]).alias("score"), F.when(tag.isNotNull(), 1.0).otherwise(margin).alias("margin"), second["genre"].alias("runner_up"), (tag.isNotNull() | usable).alias("usable"))


def beat_chroma(frames: DataFrame, beats: DataFrame, by: str) -> DataFrame:
    """A3: the median of each chroma bin in each beat."""
    w = Window.partitionBy(by).orderBy("time_s")
    spans = beats.withColumn("end_s", F.lead("time_s").over(w)).filter("end_s is not null").withColumnRenamed("time_s", "start_s").withColumn("beat", F.row_number().over(Window.partitionBy(by).orderBy("start_s")) - 1)
    inside = interval_join(frames, spans.select(by, "beat", "start_s", "end_s"), by).select(by, "beat", F.posexplode("chroma").alias("pc", "x"))
    return inside.groupBy(by, "beat", "pc").agg(F.percentile("x", 0.5).alias("x"))


def bar_chords(bins: DataFrame, by: str, bar: str = "bar") -> DataFrame:
    """A4: the best of 24 triads by cosine for each bar; bins (12 numbers) are the bar's mean chroma."""
    rows = [(pc, q, [1.0 if (k - pc) % 12 in C.CHORDS[q] else 0.0 for k in range(12)]) for q in ("maj", "min") for pc in range(12)]
    triads = bins.sparkSession.createDataFrame(rows, "root int, quality string, triad array<double>")
    from beatlake.functions.scalars import cosine

    scored = bins.crossJoin(F.broadcast(triads)).withColumn("c", F.round(cosine(F.col("bins"), F.col("triad")), 9))
    best = scored.groupBy(by, bar).agg(F.max(F.struct("c", F.expr("quality = 'maj'").alias("m"), (-F.col("root")).alias("n"), "quality")).alias("b"))
    return best.select(by, bar, (-F.col("b.n")).alias("root"), F.col("b.quality").alias("quality"), F.col("b.c").alias("confidence"))


def weighted_error(rows: DataFrame, by: str, error: str, weight: str) -> DataFrame:
    """A34."""
    w = F.greatest(F.col(weight), F.lit(1e-6))
    return rows.groupBy(by).agg((F.sum(F.abs(error) * w) / F.sum(w)).alias("weighted_error"))


def ride_gains(phrases: DataFrame, by: str, level: str, weight: str) -> DataFrame:
    """Gains that bring phrases to the take's median level, within 6 dB."""
    median = F.percentile(level, 0.5).over(Window.partitionBy(by))
    return phrases.withColumn("_m", median).withColumn("gain_db", clip((F.col("_m") - F.col(level)) * F.col(weight), -6.0, 6.0)).drop("_m")


def resonances(bins: DataFrame, by: str, n: int = 5, half: int = 4) -> DataFrame:
    """Local peaks over the moving mean of neighbours in 150-6000 Hz, the n most prominent."""
    w = Window.partitionBy(by).orderBy("freq_hz")
    rows = bins.withColumns({"_t": F.avg("mag_db").over(w.rowsBetween(-half, half)), "_l": F.lag("mag_db").over(w), "_r": F.lead("mag_db").over(w)})
    peaks = rows.filter((F.col("mag_db") > F.col("_l")) & (F.col("mag_db") >= F.col("_r")) & F.col("freq_hz").between(150, 6000)).withColumn("prominence", F.round(F.col("mag_db") - F.col("_t"), 9)).filter("prominence > 0")
    return peaks.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("prominence"), "freq_hz"))).filter(F.col("place") <= n).select(by, "place", "freq_hz", "prominence")


def channel_check(frames: DataFrame, by: str) -> DataFrame:
    """Correlation of two channels; inverted under -.9, one signal twice over .9995. A flat channel has none: NaN, and stereo."""
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    of = lambda side: F.when(both, F.col(side))
    flat = lambda side: F.min(of(side)) == F.max(of(side))
    # F.corr divides by zero in a flat group, which fails the job under ANSI.
    spread = F.stddev_pop(of("left")) * F.stddev_pop(of("right"))
    corr = F.when(flat("left") | flat("right"), float("nan")).otherwise(F.try_divide(F.covar_pop("left", "right"), spread))
    x = frames.groupBy(by).agg(corr.alias("corr"))
    known = ~F.isnan("corr")
    return x.withColumn("verdict", F.when(F.col("corr") < -0.9, "inverted").when(known & (F.col("corr") > 0.9995), "fake_stereo").otherwise("stereo"))


def dominant_key(regions: DataFrame, by: str) -> DataFrame:
    """The key with the longest total."""
    x = regions.groupBy(by, "key_pc", "key_mode").agg(F.round(F.sum("duration_s"), 6).alias("s"))
    return x.groupBy(by).agg(F.max(F.struct("s", (-F.col("key_pc")).alias("n"), "key_mode")).alias("m")).select(by, (-F.col("m.n")).alias("key_pc"), F.col("m.key_mode").alias("key_mode"), F.col("m.s").alias("total_s"))
