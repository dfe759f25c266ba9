"""Levels, voice, room and pitch of takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatlake.functions.scalars import clip
from beatlake.operators.joins import asof_backward, interval_join
from beatlake.operators.sequences import folded

RT60_BANDS = (125, 250, 500, 1000, 2000, 4000)


def voice_activity(frames: DataFrame, by: str, bins: int = 64, floor_db: float = -75.0) -> DataFrame:
    """By entity the opening and closing level: Otsu's split of the histogram of levels between the 1st and 99th percentile
    (not under the floor); closing is 6 dB lower. Sums over at most 64 bins."""
    range_ = frames.groupBy(by).agg(F.percentile("rms_db", F.array(F.lit(0.01), F.lit(0.99))).alias("p")).select(by, F.greatest(F.col("p")[0], F.lit(floor_db)).alias("lo"), F.col("p")[1].alias("hi"))
    at = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col("rms_db") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    h = frames.join(range_.filter("hi > lo"), by).groupBy(by, "lo", "hi", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w, whole = Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    x = h.withColumns({"n0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("bin")).over(w), "n_all": F.sum("n").over(whole), "s_all": F.sum(F.col("n") * F.col("bin")).over(whole)}).filter("n0 < n_all")
    m0, m1 = F.col("s0") / F.col("n0"), (F.col("s_all") - F.col("s0")) / (F.col("n_all") - F.col("n0"))
    best = x.withColumn("v", F.round(F.col("n0") * (F.col("n_all") - F.col("n0")) * (m0 - m1) * (m0 - m1), 6)).groupBy(by, "lo", "hi").agg(F.max(F.struct("v", (-F.col("bin")).alias("m"))).alias("b"))
    open_at = F.col("lo") + (-F.col("b.m") + 1) * (F.col("hi") - F.col("lo")) / bins
    return best.select(by, open_at.alias("open_db"), (open_at - 6).alias("close_db"))


def downbeat_phase(beats: DataFrame, by: str, beats_per_bar: int = 4) -> DataFrame:
    """The phase whose beats (idx, low_db) are loudest in the low band on the average."""
    x = beats.groupBy(by, (F.col("idx") % beats_per_bar).alias("phase")).agg(F.round(F.avg("low_db"), 9).alias("m"))
    return x.groupBy(by).agg(F.max(F.struct("m", (-F.col("phase")).alias("p"))).alias("b")).select(by, (-F.col("b.p")).alias("phase"), F.col("b.m").alias("low_db"))


def note_vibrato(frames: DataFrame, by: list[str]) -> DataFrame:
    """Pitch frames of notes (time_s, midi): rate and depth of a peak in 4-8 Hz that is five times the median of 1-15 Hz, with
    a depth of 12 cents and a note of .25 s. The trend is a least-squares line; Fourier sums are plain aggregates per rate."""
    w = Window.partitionBy(*by)
    start = F.min("time_s").over(w)
    x = frames.withColumns({"t": F.col("time_s") - start}).withColumns({"d": F.max("t").over(w), "_s": F.regr_slope("midi", "t").over(w), "_i": F.regr_intercept("midi", "t").over(w)}).filter("d >= 0.25")
    x = x.withColumn("y", (F.col("midi") - F.col("_i") - F.col("_s") * F.col("t")) * (0.5 - 0.5 * F.cos(2 * F.pi() * F.col("t") / F.col("d"))))
    rates = F.explode(F.sequence(F.lit(2), F.lit(30))).alias("k")  # half hertz
    s = x.select(*by, "t", "y", "midi", rates).withColumn("f", F.col("k") / 2.0).groupBy(*by, "f").agg(F.sum(F.col("y") * F.cos(2 * F.pi() * F.col("f") * F.col("t"))).alias("c"), F.sum(F.col("y") * F.sin(2 * F.pi() * F.col("f") * F.col("t"))).alias("s"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("p", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) * 4 / F.col("n") * 100)
    out = s.groupBy(*by).agg(F.max(F.when(F.col("f").between(4, 8), F.struct("p", "f"))).alias("b"), F.percentile("p", 0.5).alias("m"))
    good = (F.col("b.p") >= 5 * F.col("m")) & (F.col("b.p") >= 12)
    return out.select(*by, F.when(good, F.col("b.f")).alias("rate_hz"), F.when(good, F.col("b.p")).alias("depth_cents"))


def expression_profile(notes: DataFrame, by: str) -> DataFrame:
    """Means over a take's notes."""
    cents = (F.col("midi") - F.bround("midi")) * 100
    return notes.groupBy(by).agg(F.avg("vibrato_depth_cents").alias("vibrato_cents"), F.avg(F.coalesce(F.col("gesture") == "slide", F.lit(False)).cast("double")).alias("scoop_share"), F.avg(F.col("is_melisma").cast("double")).alias("melisma_share"), F.avg(cents).alias("intonation_cents"), F.stddev_pop(cents).alias("intonation_spread"))


def rt60(frames: DataFrame, onsets: DataFrame, by: str) -> DataFrame:
    """Band envelopes (time_s, band, db): after each onset the slope of the decay between 5 and 35 dB under its peak; times of
    .08-3 s; the median per band, and the spread as confidence (.3 at least)."""
    at = asof_backward(frames, onsets.select(by, "time_s"), by).filter("grid is not null").withColumn("onset", F.col("grid.time"))
    key = [by, "band", "onset"]
    top = F.max("db").over(Window.partitionBy(*key))
    fall = at.withColumn("_top", top).filter((F.col("db") <= F.col("_top") - 5) & (F.col("db") >= F.col("_top") - 35))
    slopes = fall.groupBy(*key).agg(F.regr_slope("db", "time_s").alias("s"), F.count(F.lit(1)).alias("n")).filter("n >= 3 and s < 0").withColumn("t", -60 / F.col("s")).filter("t >= 0.08 and t <= 3")
    out = slopes.groupBy(by, "band").agg(F.percentile("t", 0.5).alias("rt60_s"), F.stddev_pop("t").alias("_s"), F.count(F.lit(1)).alias("n_decays"))
    return out.withColumn("confidence", clip(1 - F.col("_s") / F.col("rt60_s"), 0.0, 1.0)).filter("confidence >= 0.3").drop("_s")


def fill_bands(times: DataFrame, by: str) -> DataFrame:
    """A row for each band; a missing one takes the mean of the known ones."""
    known = times.groupBy(by).agg(F.avg("rt60_s").alias("_m"))
    every = known.withColumn("band", F.explode(F.array(*map(F.lit, RT60_BANDS))))
    return every.join(times.select(by, "band", "rt60_s"), [by, "band"], "left").select(by, "band", F.coalesce("rt60_s", "_m").alias("rt60_s"), F.col("rt60_s").isNotNull().alias("measured"))


def event_rates(onsets: DataFrame, beats: DataFrame, by: str) -> DataFrame:
    """Onsets, and hi-hats, per beat: counts over the span of the beats times the median beat."""
    w = Window.partitionBy(by).orderBy("time_s")
    span = beats.withColumn("_d", F.col("time_s") - F.lag("time_s").over(w)).groupBy(by).agg((F.max("time_s") - F.min("time_s")).alias("span"), F.percentile("_d", 0.5).alias("beat"))
    n = onsets.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("element") == "hat").alias("hats"))
    good = (F.col("span") > 0) & (F.col("n") >= 4)
    return n.join(span, by).select(by, F.when(good, F.col("n") / F.col("span") * F.col("beat")).alias("onset_rate"), F.when(good, F.col("hats") / F.col("span") * F.col("beat")).alias("hat_density"))


def noise_change(verdicts: DataFrame, by: str) -> DataFrame:
    """Verdicts of two stages (before, after) side by side, and the decibels removed."""
    x = verdicts.groupBy(by).pivot("stage", ["before", "after"]).agg(F.first("verdict").alias("verdict"), F.first("floor_db").alias("floor_db"))
    return x.withColumn("removed_db", F.col("before_floor_db") - F.col("after_floor_db"))


def bar_slips(beats: DataFrame, by: str) -> DataFrame:
    """Runs of beat intervals more than 10 % off the median whose sum is half a beat: where bars must be counted anew."""
    w, whole = Window.partitionBy(by).orderBy("time_s"), Window.partitionBy(by)
    x = beats.withColumn("_d", F.lead("time_s").over(w) - F.col("time_s")).withColumn("_m", F.percentile("_d", 0.5).over(whole))
    off = F.coalesce(F.abs(F.col("_d") - F.col("_m")) > 0.1 * F.col("_m"), F.lit(False))
    x = x.withColumn("_off", off).withColumn("_run", F.sum((~F.col("_off")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    slips = x.filter("_off").groupBy(by, "_run").agg(F.min("time_s").alias("start_s"), F.max(F.col("time_s") + F.col("_d")).alias("end_s"), F.abs(F.sum(F.col("_d") - F.col("_m"))).alias("_sum"), F.max("_m").alias("beat_s"))
    return slips.filter(F.col("_sum") >= 0.5 * F.col("beat_s")).select(by, "start_s", "end_s", (F.col("_sum") / F.col("beat_s")).alias("beats_off"))


def extend_lattice(bars: DataFrame, by: str, until: DataFrame) -> DataFrame:
    """Bar lines continued by the median bar until end_s."""
    w = Window.partitionBy(by).orderBy("time_s")
    x = bars.withColumn("_d", F.col("time_s") - F.lag("time_s").over(w)).groupBy(by).agg(F.max("time_s").alias("last"), F.percentile("_d", 0.5).alias("bar")).join(until, by).filter("bar > 0 and end_s > last")
    more = x.withColumn("k", F.explode(F.sequence(F.lit(1), F.ceil((F.col("end_s") - F.col("last")) / F.col("bar")).cast("int")))).select(by, (F.col("last") + F.col("k") * F.col("bar")).alias("time_s"))
    return bars.select(by, "time_s").unionByName(more)


def continued(last: float | None, midi: float, smooth: float = 0.35) -> float:
    """The next output of W28 and T5: a jump of 12 or 24 semitones from the last output is undone, and the two are blended."""
    if last is None:
        return midi
    d = midi - last
    jump = next((k for k in (12, 24) if abs(abs(d) - k) < 1), 0)
    return (midi - (jump if d > 0 else -jump)) * (1 - smooth) + last * smooth


def octave_repair(f0: DataFrame, by: str, smooth: float = 0.35) -> DataFrame:
    """Within a voiced run a jump of 12 or 24 semitones from the last output is undone, and outputs are smoothed: a fold over
    the run, as it depends on its own output. Runs of one take go to different tasks; frames without time or pitch are dropped."""
    w = Window.partitionBy(by).orderBy("time_s", "midi")
    runs = f0.withColumn("_run", F.sum((~F.col("voiced")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("voiced")

    def step(last: float | None, time_s: float, midi: float) -> tuple:
        out = continued(last, midi, smooth)
        return out, (time_s, out)

    pitch = runs.select(by, "_run", F.col("time_s").cast("double").alias("time_s"), F.col("midi").cast("double").alias("midi"))
    return folded(pitch, [by, "_run"], step, "time_s", "midi").drop("_run")


def preroll_guidance(takes: DataFrame) -> DataFrame:
    """Facts and warnings before a take: room (rt60 over .6 s fatal, .35 warn), floor over -45 dB, a scale out of range."""
    rows = F.array(
        F.when(F.col("rt60_s") > 0.6, F.struct(F.lit("room").alias("cue"), F.lit("fatal").alias("severity"))).when(F.col("rt60_s") > 0.35, F.struct(F.lit("room").alias("cue"), F.lit("warn").alias("severity"))),
        F.when(F.col("floor_db") > -45, F.struct(F.lit("floor").alias("cue"), F.lit("warn").alias("severity"))), F.when(F.col("out_of_range") >= 0.25, F.struct(F.lit("range").alias("cue"), F.lit("warn").alias("severity"))),
        F.when(F.col("bpm").isNotNull(), F.struct(F.lit("tempo").alias("cue"), F.lit("info").alias("severity"))),
    )
    return takes.select("take_id", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("take_id", "x.*")


def take_warnings(takes: DataFrame) -> Column:
    """Texts for severe or heavy noise, a cut lead-in, no voice, tempo conflicts."""
    every = F.array(
        F.when(F.col("noise") == "severe", "noise is too strong to remove"), F.when(F.col("noise") == "heavy", "noise will be heard after cleaning"), F.when(F.col("lead_in_s") > 0, F.format_string("%.1f s before the first phrase were cut", F.col("lead_in_s"))),
        F.when(F.col("voice") == "no_voice", "no voice was found"), F.when(F.col("tempo_conflict"), "the stated tempo and the measured one differ"),
    )
    return F.filter(every, lambda x: x.isNotNull())


def frames_in(frames: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """A21's input: frames with `inside`, whether a region holds them."""
    hit = interval_join(frames, regions.select(by, "start_s", "end_s"), by, how="left_semi").select(by, "time_s", F.lit(True).alias("inside")).distinct()
    return frames.join(hit, [by, "time_s"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
