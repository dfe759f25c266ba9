"""Sequence operators. Windows are over one entity's rows in time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush, heappushpop

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatlake import constants as C
from beatlake.functions.music import transition_before
from beatlake.functions.scalars import clip, interpolated, mapped
from beatlake.functions.theory import degree_of, harmonic_function, roman_numeral
from beatlake.operators.joins import parts, running_max
from beatlake.sources.lineage import materialised


def in_time(by: str, *order: str) -> Window:
    return Window.partitionBy(by).orderBy(*(order or ("time_s",)))


def ioi(onsets: DataFrame, by: str, *tie: str) -> DataFrame:
    """Seconds since the onset before."""
    return onsets.withColumn("ioi_s", F.col("time_s") - F.lag("time_s").over(in_time(by, "time_s", *tie)))


def tempo_curve(beats: DataFrame, by: str) -> DataFrame:
    """60 over the interval, at its middle; intervals that aren't positive are dropped."""
    after = F.lead("time_s").over(in_time(by))
    out = beats.withColumn("_next", after).filter(F.col("_next") > F.col("time_s"))
    return out.select(by, ((F.col("time_s") + F.col("_next")) / 2).alias("time_s"), (60 / (F.col("_next") - F.col("time_s"))).alias("bpm"))


def hysteresis(level: Column, open_at: Column, close_at: Column, w: Window) -> Column:
    """On from open_at, off below close_at, else as before."""
    mark = F.when(level >= open_at, 1).when(level < close_at, 0)
    return F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1, F.lit(False))


def regions(frames: DataFrame, by: str, active: str, gap_s: float = 0.35, least_s: float = 0.25, pad_s: float = 0.03, *tie: str) -> DataFrame:
    """Runs of active frames; runs up to gap_s apart join; runs of least_s and longer are kept and padded."""
    on = frames.filter(F.col(active))
    w = in_time(by, "time_s", *tie)
    new = F.coalesce((F.col("time_s") - F.lag("time_s").over(w) > gap_s).cast("int"), F.lit(1))
    runs = on.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(by, "_run").agg(F.min("time_s").alias("_s"), F.max("time_s").alias("_e"), F.count(F.lit(1)).alias("n_frames"))
    return out.filter(F.col("_e") - F.col("_s") >= least_s).select(by, F.greatest(F.lit(0.0), F.col("_s") - pad_s).alias("start_s"), (F.col("_e") + pad_s).alias("end_s"), "n_frames")


def performance_span(phrases: DataFrame, by: str, gap_s: float = 2.0, least_s: float = 6.0) -> DataFrame:
    """From the first to the last run of phrases (gaps under gap_s) of at least least_s, else the longest run."""
    w = in_time(by, "start_s", "end_s")
    new = F.coalesce((F.col("start_s") - F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= gap_s).cast("int"), F.lit(1))
    runs = phrases.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(by, "_run").agg(F.min("start_s").alias("s"), F.max("end_s").alias("e")).withColumn("long", F.col("e") - F.col("s") >= least_s)
    out = runs.groupBy(by).agg(F.min(F.when(F.col("long"), F.col("s"))).alias("a"), F.max(F.when(F.col("long"), F.col("e"))).alias("b"), F.max(F.struct((F.col("e") - F.col("s")).alias("d"), (-F.col("s")).alias("n"), "e")).alias("m"))
    return out.select(by, F.coalesce("a", -F.col("m.n")).alias("start_s"), F.coalesce("b", "m.e").alias("end_s"))


def gestures(notes: DataFrame, by: str) -> DataFrame:
    """Slides, falls and melismas of notes with start_s, end_s, midi and spread_cents."""
    w = in_time(by, "start_s", "end_s")
    duration = F.col("end_s") - F.col("start_s")
    before, after = F.col("start_s") - F.lag("end_s").over(w), F.lead("start_s").over(w) - F.col("end_s")
    step = F.col("midi") - F.lag("midi").over(w)
    slide = (F.col("spread_cents") > 70) | F.coalesce((before < 0.06) & (step > 2), F.lit(False))
    fall = F.coalesce((before < 0.08) & (step < -2.5) & (duration < 0.2), F.lit(False))
    return notes.withColumns({"gesture": F.when(slide, "slide").when(fall, "fall"), "is_melisma": (duration < 0.16) & F.coalesce((before < 0.05) & (after < 0.05), F.lit(False))})


def cadences(chords: DataFrame, by: str, order: str = "bar") -> DataFrame:
    """Chords with key_pc, key_mode (and confidence) -> the cadence that each chord makes with the one after it."""
    w = in_time(by, order)
    root, quality, pc, mode = map(F.col, ("root", "quality", "key_pc", "key_mode"))
    degree, function = degree_of(root, pc, mode), harmonic_function(root, quality, pc, mode)
    rows = chords.withColumns({"_d": degree, "_f": function})
    rows = rows.withColumns({"_nd": F.lead("_d").over(w), "_nf": F.lead("_f").over(w), "_na": F.lead(order).over(w)})
    kind = F.when((F.col("_f") == "D") & (F.col("_nd") == 0), "authentic").when((F.col("_d") == 3) & (F.col("_nd") == 0), "plagal").when((F.col("_d") == 4) & (F.col("_nd") == 5), "deceptive").when((F.col("_nf") == "D") & (F.col("_f") != "D"), "half")
    strength = mapped({"authentic": 1.0, "plagal": 0.7, "deceptive": 0.6, "half": 0.45})[F.col("kind")] * (F.greatest(F.col("confidence"), F.lit(0.3)) if "confidence" in chords.columns else F.lit(1.0))
    return rows.withColumn("kind", kind).withColumn("strength", strength).filter("kind is not null and strength >= 0.35").select(by, F.col("_na").alias(order), "kind", "strength")


def progression_fingerprint(chords: DataFrame, by: str, order: str = "bar") -> DataFrame:
    """Numerals with consecutive repeats left out."""
    numeral = roman_numeral(*map(F.col, ("root", "quality", "key_pc", "key_mode")))
    rows = chords.withColumn("_n", numeral).withColumn("_same", F.col("_n") == F.lag("_n").over(Window.partitionBy(by).orderBy(order)))
    kept = rows.filter("_same is null or not _same").groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, "_n"))).alias("x"))
    return kept.select(by, F.array_join("x._n", " ").alias("progression"))


def subdivide(beats: DataFrame, by: str, n: int) -> DataFrame:
    """N slots in each interval between measured beats, and the last beat itself."""
    rows = beats.withColumn("_next", F.lead("time_s").over(in_time(by)))
    slots = F.when(F.col("_next").isNotNull(), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    out = rows.withColumn("slot", F.explode(slots))
    return out.select(by, "slot", F.when(F.col("slot") == 0, F.col("time_s")).otherwise(F.col("time_s") + (F.col("_next") - F.col("time_s")) * F.col("slot") / n).alias("time_s"))


def map_times(events: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """Piecewise linear from anchors (time_s, to_s), held beyond the edges: between the anchors around each event."""
    from beatlake.operators.joins import between

    both = between(events, anchors, by, "time_s", ["to_s"])
    a, b = F.col("_before"), F.col("_after")
    inner = a["to_s"] + (F.col("time_s") - a["time"]) * (b["to_s"] - a["to_s"]) / (b["time"] - a["time"])
    to = F.when(a.isNull(), b["to_s"]).when(b.isNull() | (a["time"] == b["time"]) | (F.col("time_s") == a["time"]), a["to_s"]).otherwise(inner)
    return both.withColumn("_to", to).filter("_kind = 1").select("_point.*", F.col("_to").alias("mapped_s"))


def folded(rows: DataFrame, by: list[str], step: Callable, *told: str) -> DataFrame:
    """A fold over each key's rows in the order of the columns after `by` (numbers, none null): step(state, *row) gives the next
    state and a tuple of doubles, named by `told`, or None. The state is None at a key's first row. Rows stream through sorted
    partitions, so a task holds a batch and one state, however many rows a key has."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    n = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != key:
                    key, state = row[:n], None
                state, one = step(state, *row[n:])
                if one is not None:
                    out.append((*key, *one))
            types = [*batch.schema.types[:n], *[pa.float64()] * len(told)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[*by, *told])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + [f"`{c}` double" for c in told])
    return rows.dropna(subset=[c for c in rows.columns if c not in by]).repartition(*by).sortWithinPartitions(*rows.columns).mapInArrow(run, schema)


def streamed(rows: DataFrame, by: str, order: list[str], start: Callable, told: str) -> DataFrame:
    """A fold over the rows of each (by, `_part`) in their order: start() gives an object whose push(*row) and close() give lists of
    tuples; row has all columns but by and `_part`. The tuples become rows of by and the columns of `told` ("name kind, ..."; kinds are
    double or that of a column of the rows). Rows stream through sorted partitions, so a task holds a batch and one object."""
    rest = [c for c in rows.columns if c not in (by, "_part")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = [x.split()[0] for x in told.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fold = types = None

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[by, *names])

        for batch in batches:
            known = dict(zip(batch.schema.names, batch.schema.types))
            types, out = [known[by], *(known.get(n, pa.float64()) for n in names)], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or row[:2] != key:
                    out += [(key[0], *x) for x in fold.close()] if fold is not None else []
                    key, fold = row[:2], start()
                out += [(key[0], *x) for x in fold.push(*row[2:])]
            yield made(out)
        if fold is not None:
            yield made([(key[0], *x) for x in fold.close()])

    schema = ", ".join([f"`{by}` {kinds[by]}"] + [f"`{n}` {kinds.get(n, 'double')}" for n in names])
    return rows.select(by, "_part", *rest).repartition(by, "_part").sortWithinPartitions(by, "_part", *order).mapInArrow(run, schema)


def sanitised_anchors(anchors: DataFrame, by: str, gap_s: float = 0.045, lo: float = 0.8, hi: float = 1.25) -> DataFrame:
    """Anchors in order of time_s; one is dropped if it is too near to the last kept one or stretches too much from it.
    A fold, as each decision depends on the last kept. Anchors with a null time are dropped."""

    def step(last: tuple | None, time_s: float, to_s: float) -> tuple:
        apart = time_s - last[0] if last else None
        if last is None or (apart >= gap_s and lo <= (to_s - last[1]) / apart <= hi):
            return (time_s, to_s), (time_s, to_s)
        return last, None

    times = [F.col(c).cast("double").alias(c) for c in ("time_s", "to_s")]
    return folded(anchors.select(by, *times), [by], step, "time_s", "to_s")


def label_sections(sections: DataFrame, by: str) -> DataFrame:
    """By energy against the 70th and 30th percentile, with rules for the first and last section."""
    whole, w = Window.partitionBy(by), in_time(by, "seq")
    cuts = F.percentile("energy", F.array(F.lit(0.7), F.lit(0.3))).over(whole)
    rows = sections.withColumns({"_cut": cuts, "_n": F.row_number().over(w), "_of": F.count(F.lit(1)).over(whole)})
    high, low = F.col("energy") >= F.col("_cut")[0], F.col("energy") <= F.col("_cut")[1]
    label = F.when((F.col("_n") == 1) & ~high, "intro").when((F.col("_n") == F.col("_of")) & ~high & (F.col("_of") > 1), "outro").when(high, "chorus").when(low, "break").otherwise("verse")
    return rows.withColumn("label", label).drop("_cut", "_n", "_of")


def fallback_sections(tracks: DataFrame, bars: int = 8) -> DataFrame:
    """Blocks of bars over entity_id, bar_s, duration_s; the last one is cut."""
    n = F.ceil(F.col("duration_s") / (F.col("bar_s") * bars))
    rows = tracks.withColumn("seq", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    start = F.col("seq") * F.col("bar_s") * bars
    return rows.select("entity_id", "seq", start.alias("start_s"), F.least(start + F.col("bar_s") * bars, "duration_s").alias("end_s"))


#: Labels whose energy climbs as they come again.
CLIMBING = ["hook", "chorus", "verse"]


def energy_levels(sections: DataFrame, by: str, genre: str | None = None) -> DataFrame:
    """Target energy of each section: repeats climb, sections before a hook lift, a hook after a bridge peaks, and the
    genre's contrast spreads all about the song's mean."""
    w = in_time(by, "seq")
    hook = F.col("label").isin("hook", "chorus")
    # How many of its own label came before: counts along the one order of a song, so its rows are sorted once.
    so_far = w.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.coalesce(F.get(F.array(*(F.count_if(F.col("label") == x).over(so_far) for x in CLIMBING)), F.array_position(F.lit(CLIMBING), F.col("label")).cast("int") - 1), F.lit(0))
    base = F.coalesce(mapped(C.BASE_ENERGY)[F.col("label")], F.lit(C.BASE_ENERGY["section"]))
    climb = F.when(hook, F.least(0.06 * nth, F.lit(0.12))).when(F.col("label") == "verse", F.least(0.07 * nth, F.lit(0.14))).otherwise(0.0)
    before_hook = F.coalesce(F.lead("label").over(w).isin("hook", "chorus"), F.lit(False)) & ~hook
    raw = base + climb + F.when(before_hook, 0.08).otherwise(0.0)
    raw = F.when(F.coalesce(F.lag("label").over(w) == "bridge", F.lit(False)) & hook, F.least(raw + 0.08, F.lit(1.0))).otherwise(raw)
    contrast = F.coalesce(mapped(C.GENRE_CONTRAST)[F.col(genre)], F.lit(1.0)) if genre else F.lit(1.0)
    rows = sections.withColumn("_raw", raw).withColumn("_mean", F.avg("_raw").over(Window.partitionBy(by)))
    return rows.withColumn("energy", clip(F.col("_mean") + (F.col("_raw") - F.col("_mean")) * contrast, 0.05, 1.0)).drop("_raw", "_mean")


def contour_points(levels: DataFrame, by: str) -> DataFrame:
    """Two points inside the edges of each section (start_s, end_s, energy, label), and one at the song's start and end."""
    edge = F.least(F.lit(0.35), F.greatest(F.col("end_s") - F.col("start_s"), F.lit(1e-3)) * 0.12)
    inner = levels.withColumn("_e", edge).select(by, "label", F.col("energy").alias("value"), F.explode(F.array(F.col("start_s") + F.col("_e"), F.greatest(F.col("end_s") - F.col("_e"), F.col("start_s") + F.col("_e")))).alias("time_s"))
    ends = levels.groupBy(by).agg(F.min_by(F.struct("label", "energy"), "start_s").alias("a"), F.max_by(F.struct("label", "energy"), "end_s").alias("b"), F.max("end_s").alias("t"))
    outer = ends.select(by, F.explode(F.array(F.struct(F.col("a.label").alias("label"), F.col("a.energy").alias("value"), F.lit(0.0).alias("time_s")), F.struct(F.col("b.label").alias("label"), F.col("b.energy").alias("value"), F.col("t").alias("time_s")))).alias("p")).select(by, "p.*")
    return inner.unionByName(outer)


def transitions(levels: DataFrame, by: str) -> DataFrame:
    """The rise in energy at each boundary and the effects that it calls for."""
    jump = F.col("energy") - F.lag("energy").over(in_time(by, "seq"))
    return levels.withColumn("jump", jump).filter("jump is not null").withColumn("effects", transition_before(F.col("label"), F.col("jump")))


def ranked(frames: DataFrame, by: str, value: str) -> DataFrame:
    """frames with `_rank`, the place from 0 of a value among an entity's in ascending order, and `_of`, the last place (nulls have none)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last(value)))
    return frames.withColumns({"_rank": F.when(F.col(value).isNotNull(), n - 1), "_of": F.count(value).over(Window.partitionBy(by)) - 1})


def quantile(value: str, p: float) -> Column:
    """The aggregate of an entity's ranked frames that is the value at a share p of the way, between neighbours by `interpolated`."""
    at = F.col("_of") * F.lit(p)
    of = lambda place: F.max(F.when(F.col("_rank") == place, F.col(value)))
    return interpolated(of(F.floor(at)), of(F.ceil(at)), F.max(at - F.floor(at)))


def longest_silence(frames: DataFrame, by: str, *tie: str) -> DataFrame:
    """Frames of the longest run under the 95th percentile less 45 dB, between the first and the last loud frame."""
    top = ranked(frames.select(by, "rms_db"), by, "rms_db").groupBy(F.col(by).alias("_by")).agg(quantile("rms_db", 0.95).alias("_top"))
    loud = F.col("rms_db") >= F.col("_top") - 45
    w = in_time(by, "time_s", *tie)
    rows = frames.join(top, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumn("_loud", loud).withColumn("_run", F.sum(F.col("_loud").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max("_run").over(Window.partitionBy(by))
    quiet = rows.withColumn("_last", last).filter("_run > 0 and _run < _last and not _loud").groupBy(by, "_run").agg(F.count(F.lit(1)).alias("n"))
    return frames.select(by).distinct().join(quiet.groupBy(by).agg(F.max("n").alias("n")), by, "left").select(by, F.coalesce("n", F.lit(0)).alias("silent_frames"))


def loudest_excerpt(frames: DataFrame, by: str, n: int = 30, *tie: str) -> DataFrame:
    """Where the sum of n frames' levels is greatest (the first of equals)."""
    w = in_time(by, "time_s", *tie)
    total = F.sum("rms_db").over(w.rowsBetween(0, n - 1))
    rows = frames.withColumns({"_sum": F.round(total, 6), "_n": F.row_number().over(w), "_of": F.count(F.lit(1)).over(Window.partitionBy(by))}).filter(F.col("_n") <= F.greatest(F.lit(1), F.col("_of") - n + 1))
    best = rows.groupBy(by).agg(F.max(F.struct("_sum", (-F.col("time_s")).alias("t"))).alias("m"))
    return best.select(by, (-F.col("m.t")).alias("start_s"), F.col("m._sum").alias("level_sum"))


def chord_spans(chords: DataFrame, by: str, shift: Column | int = 0) -> DataFrame:
    """A chord lasts to the next one's onset, the last one four seconds; roots move with the render's shift."""
    end = F.coalesce(F.lead("time_s").over(in_time(by)), F.col("time_s") + 4.0)
    return chords.select(by, F.pmod(F.col("root") + shift, F.lit(12)).cast("int").alias("root"), "quality", F.col("time_s").alias("start_s"), end.alias("end_s"))


def fallback_hook_regions(phrases: DataFrame, by: str, order: str = "idx") -> DataFrame:
    """The later half of the phrases if there are four, else all."""
    n, of = F.row_number().over(in_time(by, order)), F.count(F.lit(1)).over(Window.partitionBy(by))
    return phrases.withColumns({"_n": n, "_of": of}).filter("_of < 4 or _n > floor(_of / 2)").drop("_n", "_of")


def smooth(frames: DataFrame, by: str, value: str, half_s: float) -> DataFrame:
    """The mean within half_s either way (an approximation of zero-phase smoothing)."""
    half = round(half_s * 1e6)  # ranges are whole numbers, of microseconds
    w = Window.partitionBy(by).orderBy(F.round(F.col("time_s") * 1e6).cast("long")).rangeBetween(-half, half)
    return frames.withColumn(value, F.avg(value).over(w))


class _Note:
    """W3 over a voiced run: the note so far as two heaps around its median, and its moments."""

    def __init__(self, least_s: float, jump: float):
        self.least_s, self.jump = least_s, jump
        self._begin()

    def _begin(self) -> None:
        self.low, self.high, self.first, self.last, self.n, self.mean, self.square = [], [], None, None, 0, 0.0, 0.0

    def median(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2

    def push(self, time_s: float, midi: float) -> list[tuple]:
        told = []
        if self.n and abs(midi - self.median()) > self.jump:
            told = self.close()
            self._begin()
        heappush(self.high, -heappushpop(self.low, -midi))
        if len(self.high) > len(self.low):
            heappush(self.low, -heappop(self.high))
        self.first, self.last, self.n = time_s if self.n == 0 else self.first, time_s, self.n + 1
        step = midi - self.mean
        self.mean += step / self.n
        self.square += step * (midi - self.mean)
        return told

    def close(self) -> list[tuple]:
        if not self.n or self.last - self.first < self.least_s:
            return []
        return [(self.first, self.last, self.median(), (self.square / self.n) ** 0.5 * 100)]


def segment_notes(f0: DataFrame, by: str, least_s: float = 0.06, jump: float = 1.0) -> DataFrame:
    """Notes of pitch frames (time_s, midi, voiced): within a voiced run a new note begins where the pitch is more than a semitone
    from the running median of the note so far. Runs of a take go to different tasks, which stream them; a frame costs the
    logarithm of its note's length. Frames without time or voice part nothing and end runs; those without pitch are passed over."""
    known = f0.filter(F.col("time_s").isNotNull()).select(by, "time_s", "midi", F.coalesce("voiced", F.lit(False)).alias("voiced"))
    runs = running_max(known, by, ["time_s"], {"_part": (F.when(~F.col("voiced"), F.col("time_s").cast("double")), True)})
    sung = runs.filter(F.col("voiced") & F.col("midi").isNotNull()).select(by, "_part", F.col("time_s").cast("double").alias("time_s"), F.col("midi").cast("double").alias("midi"))
    return streamed(sung, by, ["time_s", "midi"], lambda: _Note(least_s, jump), "start_s double, end_s double, midi double, spread_cents double")


class _Limits:
    """W13 over a stretch: pass p works on a pair as soon as pass p - 1 has done the next one, so all passes run through the rows
    once, side by side, and only the last few rows are held."""

    def __init__(self, lo: float, hi: float, passes: int):
        self.lo, self.hi, self.passes = lo, hi, passes
        self.rows, self.base, self.n, self.last = [], 0, 0, None  # rows: [time, move, what else a row has]

    def _pair(self, k: int) -> None:
        """Pull the moves of rows k - 1 and k together if their gap changes too much."""
        if not 1 <= k < self.n or k - 1 < self.base:
            return
        a, b = self.rows[k - 1 - self.base], self.rows[k - self.base]
        gap, change = b[0] - a[0], b[1] - a[1]
        if gap <= 1e-9:
            b[1] = a[1]
            return
        ratio = 1 + change / gap
        if self.lo <= ratio <= self.hi:
            return
        excess = change - ((self.hi if ratio > self.hi else self.lo) - 1) * gap
        a[1] += excess / 2
        b[1] -= excess / 2

    def _settle(self, upto: int) -> list[tuple]:
        told = []
        while self.base < upto:
            t, move, rest = self.rows.pop(0)
            if self.last is not None:
                gap = t - self.last[0]
                move = self.last[1] if gap <= 1e-9 else min(max(move, self.last[1] + (self.lo - 1) * gap), self.last[1] + (self.hi - 1) * gap)
            self.last, self.base = (t, move), self.base + 1
            told.append((t, *rest, t + move))
        return told

    def push(self, time_s: float, target_s: float, *rest) -> list[tuple]:
        self.rows.append([time_s, target_s - time_s, (target_s, *rest)])
        self.n += 1
        for p in range(self.passes):
            self._pair(self.n - 1 - p)
        return self._settle(self.n - self.passes)

    def close(self) -> list[tuple]:
        for k in range(self.n, self.n + self.passes):  # passes that are still behind
            for p in range(self.passes):
                self._pair(k - p)
        return self._settle(self.n)


def limit_by_neighbours(targets: DataFrame, by: str, lo: float = 0.8, hi: float = 1.25, passes: int = 8) -> DataFrame:
    """Targets (time_s, target_s) whose moves are pulled together until each gap changes by lo to hi: relaxation passes, then a
    forward clamp, in the order of time_s and target_s.

    Moves only ever come together, so where a gap is so long that even a take's outermost moves may stand at its ends, nothing
    passes: takes are cut there, and the stretches go to different tasks, which stream them. Rows without times have no limited_s.
    """
    out = [f for f in targets.columns if f != "limited_s"]
    rest = [c for c in out if c not in (by, "time_s", "target_s")]
    kinds = {f.name: f.dataType for f in targets.schema}
    rows = targets.select(by, F.col("time_s").cast("double").alias("time_s"), F.col("target_s").cast("double").alias("target_s"), *rest)
    timed = F.col("time_s").isNotNull() & F.col("target_s").isNotNull()
    move = F.col("target_s") - F.col("time_s")
    reach = rows.filter(timed).groupBy(F.col(by).alias("_by")).agg((F.max(move) - F.min(move)).alias("_range"))
    wide = F.col("_range") / min(1 - lo, hi - 1) if min(1 - lo, hi - 1) > 0 else F.lit(float("inf"))
    ranged = rows.filter(timed).join(reach, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    cut = parts(ranged, by, ["time_s", "target_s"], F.col("time_s"), F.col("time_s") + F.greatest(wide, F.lit(1e-9))).drop("_range")
    told = ", ".join(["time_s double", "target_s double", *(f"{c} {kinds[c].simpleString()}" for c in rest), "limited_s double"])
    done = streamed(cut.select(by, "_part", "time_s", "target_s", *rest), by, ["time_s", "target_s"], lambda: _Limits(lo, hi, passes), told)
    untimed = rows.filter(~timed).withColumn("limited_s", F.lit(None).cast("double"))
    return done.unionByName(untimed).select(*(F.col(c).cast(kinds[c]).alias(c) for c in out), "limited_s")


def split_overlong(regions_: DataFrame, frames: DataFrame, by: str, most_s: float = 12.0) -> DataFrame:
    """Regions longer than most_s are cut at the quietest frame of their middle 60 %, again and again; the number of rounds
    is the logarithm of the longest region, and each is written."""
    from beatlake.operators.joins import interval_join

    long_ = F.col("end_s") - F.col("start_s") > most_s
    cut_at = materialised(regions_.select(by, "start_s", "end_s"))
    done, todo = cut_at.filter(~long_), cut_at.filter(long_)
    while not todo.isEmpty():
        inner = todo.withColumns({"_s": F.col("start_s"), "_e": F.col("end_s")}).withColumns({"start_s": F.col("_s") + 0.2 * (F.col("_e") - F.col("_s")), "end_s": F.col("_s") + 0.8 * (F.col("_e") - F.col("_s"))})
        cut = interval_join(frames.select(by, "time_s", "rms_db"), inner, by).groupBy(by, "_s", "_e").agg(F.min(F.struct("rms_db", "time_s")).alias("m")).select(by, F.col("_s").alias("start_s"), F.col("_e").alias("end_s"), F.col("m.time_s").alias("cut"))
        both = materialised(todo.join(cut, [by, "start_s", "end_s"], "left"))  # read several times, and the next round's beginning
        whole = both.filter("cut is null").select(by, "start_s", "end_s")
        parts_ = both.filter("cut is not null").select(by, F.explode(F.array(F.struct(F.col("start_s").alias("s"), F.col("cut").alias("e")), F.struct(F.col("cut").alias("s"), F.col("end_s").alias("e")))).alias("p")).select(by, F.col("p.s").alias("start_s"), F.col("p.e").alias("end_s"))
        done, todo = done.unionByName(whole).unionByName(parts_.filter(~long_)), parts_.filter(long_)
    return done
