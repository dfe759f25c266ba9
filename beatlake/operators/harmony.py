"""Harmony lines, modulations, groove and alignment of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from beatlake.constants import CHORDS, SCALES
from beatlake.functions.keys import scale_pcs
from beatlake.functions.scalars import clip
from beatlake.functions.theory import avoid_notes
from beatlake.operators.joins import interval_join, running_max
from beatlake.operators.planning import assign_onsets
from beatlake.operators.profiles import grid_fit, key_of_histogram, residual_drift
from beatlake.operators.sequences import limit_by_neighbours
from beatlake.sources.lineage import materialised


def harmony_note(lead: Column, root: Column, quality: Column, key_pc: Column, mode: Column, steps: int = 2, lo: float = 48, hi: float = 84) -> Column:
    """So many steps up the scale from the lead (two for a third); notes that clash, lie within 2.5 semitones or make a tritone
    are passed over, up to four times; then folded into the range by octaves."""
    scale, base = scale_pcs(key_pc, mode), F.bround(lead).cast("int")
    up = F.filter(F.sequence(base + 1, base + 24), lambda p: F.array_contains(scale, F.pmod(p, F.lit(12)).cast("int")))
    tried = F.slice(up, steps, 5)
    bad = F.when(root.isNotNull(), avoid_notes(root, quality)).otherwise(F.array().cast("array<int>"))
    good = F.filter(tried, lambda p: ~F.array_contains(bad, F.pmod(p, F.lit(12)).cast("int")) & (p - lead >= 2.5) & (F.pmod(p - base, F.lit(12)) != 6))
    note = F.coalesce(F.get(good, F.lit(0)), F.get(tried, F.lit(4)))
    down = F.greatest(F.lit(0), F.ceil((note - hi) / 12)) * 12
    lifted = F.greatest(F.lit(0), F.ceil((lo - note) / 12)) * 12
    return (note - down + lifted).cast("double")


def key_from_chroma(frames: DataFrame, by: str, tags: DataFrame | None = None) -> DataFrame:
    """A2: the key of the mean chroma; confidence from the gap to the second best; an equal tag adds .2, another one among the four
    best is adopted at .55 where the detector is under .75. tags: tag_pc, tag_mode."""
    mean = frames.select(by, F.posexplode("chroma").alias("k", "x")).groupBy(by, "k").agg(F.avg("x").alias("x")).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("bins"))
    found = key_of_histogram(mean, by)
    gap = F.col("candidates")[0]["score"] - F.col("candidates")[1]["score"]
    found = found.withColumn("confidence", clip(gap / 0.06 * 0.5 + F.col("correlation") * 0.5, 0.0, 1.0))
    if tags is None:
        return found
    x = found.join(tags, by, "left")
    equal = (F.col("key_pc") == F.col("tag_pc")) & (F.col("key_mode") == F.col("tag_mode"))
    listed = F.exists(F.slice("candidates", 1, 4), lambda k: (k["pc"] == F.col("tag_pc")) & (k["mode"] == F.col("tag_mode")))
    adopt = F.coalesce(~equal & listed & (F.col("confidence") < 0.75), F.lit(False))
    return x.withColumns({
        "key_pc": F.when(adopt, F.col("tag_pc")).otherwise(F.col("key_pc")), "key_mode": F.when(adopt, F.col("tag_mode")).otherwise(F.col("key_mode")),
        "confidence": F.when(adopt, F.greatest(F.col("confidence"), F.lit(0.55))).when(equal, F.least(F.lit(1.0), F.col("confidence") + 0.2)).otherwise(F.col("confidence")),
    }).drop("tag_pc", "tag_mode")


def modulations(chords: DataFrame, by: str, window: int = 4, gain: float = 0.18) -> DataFrame:
    """Chords (bar, root, quality, duration_s) -> key regions. Scores of 24 keys over a sliding window are window sums; the
    switch (a clearly better key of another family that lasts) depends on the key held so far. A task streams the bars of its
    entities and carries that key and the rows that windows still reach."""
    keys = [(mode, pc) for mode in ("major", "minor") for pc in range(12)]
    family = [(pc + 3 * (mode == "minor")) % 12 for mode, pc in keys]
    scales = [{(pc + step) % 12 for step in SCALES[mode]} for mode, pc in keys]
    kind = chords.schema[by].dataType.simpleString()
    hold = max(2, window // 3)
    fits: dict[tuple, list[float]] = {}

    def fit(root: int | None, quality: str | None) -> list[float]:
        """How a chord fits each key; a chord without a root fits none."""
        if (root, quality) not in fits:
            tones = {(root + step) % 12 for step in CHORDS.get(quality, CHORDS["maj"])} if root is not None else set()
            fits[root, quality] = [len(tones & scale) / 3.0 + (0.25 if root == pc else 0.0) for scale, (_, pc) in zip(scales, keys)]
        return fits[root, quality]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Entities, the numbers of their runs, bars and scores, added up in the order of bars."""
        own, bars, run, fitted, lasts, at = [], [], np.zeros(0, np.int64), np.zeros((0, 24)), np.zeros(0), 0

        def upto(end: int) -> tuple:
            total, length = np.zeros((end - at, 24)), np.zeros(end - at)
            for apart in range(-window, window + 1):
                lo, hi = max(at, -apart), min(end, len(run) - apart)
                if lo < hi:
                    same = run[lo:hi] == run[lo + apart : hi + apart]
                    total[lo - at : hi - at] += np.where(same[:, None], fitted[lo + apart : hi + apart], 0.0)
                    length[lo - at : hi - at] += np.where(same, lasts[lo + apart : hi + apart], 0.0)
            score = np.divide(total, length[:, None], out=np.zeros_like(total), where=length[:, None] != 0)
            return own[at:end], run[at:end].tolist(), bars[at:end], np.floor(score * 1e9 + 0.5) / 1e9

        for batch in batches:
            mine, more, roots, qualities = (batch.column(k).to_pylist() for k in range(4))
            long = np.nan_to_num(batch.column(4).to_numpy(zero_copy_only=False).astype(float))
            new = np.cumsum([a != b for a, b in zip(mine, [own[-1] if own else None, *mine])]) + (run[-1] if own else 0)
            own, bars, run, lasts = own + mine, bars + more, np.concatenate([run, new]), np.concatenate([lasts, long])
            fitted = np.concatenate([fitted, np.array([fit(*x) for x in zip(roots, qualities)]).reshape(-1, 24) * long[:, None]])
            if len(own) - window > at:
                yield upto(len(own) - window)
                cut = max(0, len(own) - 2 * window)
                at = len(own) - window - cut
                own, bars, run, fitted, lasts = own[cut:], bars[cut:], run[cut:], fitted[cut:], lasts[cut:]
        if own:
            yield upto(len(own))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, entity = None, None, None
        for owns, runs, bars, s in scored(batches):
            regions = []
            for own, run, bar, best, score in zip(owns, runs, bars, s.argmax(axis=1).tolist(), s):
                if now is None or run != last:
                    if now is not None:
                        regions.append((entity, start, before + 1, *keys[now]))
                    last, entity, now, start, count = run, own, best, bar, 0
                if family[best] != family[now] and score[best] - score[now] > gain:
                    if not count:
                        first, ended = bar, before + 1
                    count += 1
                else:
                    count = 0
                if count >= hold:
                    regions.append((own, start, ended, *keys[now]))
                    now, start, count = best, first, 0
                before = bar
            yield told(regions)
        if now is not None:
            yield told([(entity, start, before + 1, *keys[now])])

    def told(regions: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in regions], t) for k, t in ((0, entity_type), (1, pa.int64()), (2, pa.int64()), (4, pa.int32()), (3, pa.string()))], names=names)

    names, entity_type = [by, "start_bar", "end_bar", "key_pc", "key_mode"], to_arrow_type(chords.schema[by].dataType)
    slim = chords.select(by, "bar", "root", "quality", "duration_s")
    return slim.repartition(by).sortWithinPartitions(by, "bar").mapInArrow(follow, f"`{by}` {kind}, start_bar long, end_bar long, key_pc int, key_mode string")


def groove_compat(pairs: DataFrame) -> DataFrame:
    """Pairs with a_swing, b_swing, a_offsets, b_offsets: .6 of swing likeness and .4 of shape; unknown .6; other subdivisions
    or flat shapes leave swing alone."""
    from beatlake.operators.profiles import correlation

    swing = clip(1 - F.abs(F.col("a_swing") - F.col("b_swing")) / 0.12, 0.0, 1.0)
    shape = F.when(F.size("a_offsets") == F.size("b_offsets"), (correlation(F.col("a_offsets"), F.col("b_offsets")) + 1) / 2)
    known = F.col("a_swing").isNotNull() & F.col("b_swing").isNotNull()
    return pairs.withColumn("compatibility", F.when(~known, 0.6).when(shape.isNull(), swing).otherwise(0.6 * swing + 0.4 * shape))


def stretch_decision(pairs: DataFrame) -> DataFrame:
    """The measured bar-grid ratio (1 within .001); else the matcher's, unless the take fits as it is: over .002 away, six
    onsets, and an error of less than .85 of the stretched one's."""
    measured = F.when(F.abs(F.col("grid_ratio") - 1) <= 0.001, 1.0).otherwise(F.col("grid_ratio"))
    fits = (F.abs(F.col("match_ratio") - 1) > 0.002) & (F.col("n_onsets") >= 6) & (F.col("plain_error_s") < 0.85 * F.col("stretched_error_s"))
    return pairs.withColumn("stretch", F.coalesce(measured, F.when(F.coalesce(fits, F.lit(False)), 1.0).otherwise(F.col("match_ratio"))))


def placement(takes: DataFrame, bars: DataFrame, by: str, most_s: float = 4.0) -> DataFrame:
    """Takes with first_s (first onset): the bar line within most_s whose distance to it is least, as an offset."""
    x = takes.join(bars.select(by, F.col("time_s").alias("bar")), by).filter(F.abs(F.col("bar") - F.col("first_s")) <= most_s)
    best = x.groupBy(by).agg(F.min(F.struct(F.round(F.abs(F.col("bar") - F.col("first_s")), 9).alias("d"), "bar", "first_s")).alias("m"))
    return best.select(by, F.col("m.bar").alias("bar_s"), (F.col("m.bar") - F.col("m.first_s")).alias("offset_s"))


def timing_plan(onsets: DataFrame, grid: DataFrame, by: str, slot_s: float, strength: float = 0.6) -> DataFrame:
    """Drift removed where it is clear (.0008 and more), onsets assigned to slots (J12), pulled past what is heard (P35) by the
    strength, and limited by their neighbours (W13). Takes of fewer than six assignments stay as they are."""
    from beatlake.functions.music import perceptible_ms
    from beatlake.operators.joins import asof_nearest

    near = asof_nearest(onsets, grid, by).filter("error_s is not null")
    drift = residual_drift(near, by).select(by, F.when(F.abs("slope") >= 0.0008, F.col("slope")).otherwise(0.0).alias("drift"))
    straight = materialised(onsets.join(drift, by, "left").withColumn("plain_s", F.col("time_s")).withColumn("time_s", F.col("time_s") * (1 - F.coalesce("drift", F.lit(0.0)))).drop("drift"))
    chosen = materialised(assign_onsets(straight.select(by, "event_id", "time_s", "strength"), grid, by, slot_s))
    enough = chosen.groupBy(by).count().filter("count >= 6").select(by)
    x = straight.join(chosen.join(enough, by, "left_semi"), [by, "event_id"], "left")
    off = F.col("slot_at") - F.col("time_s")
    heard = F.abs(off) * 1000 > perceptible_ms(F.lit(slot_s * 1000))
    target = F.when(F.coalesce(heard, F.lit(False)), F.col("time_s") + off * strength).otherwise(F.col("time_s"))
    return limit_by_neighbours(x.select(by, "event_id", "time_s", target.alias("target_s")), by)


#: Frames of either side that a task aligns at once; how many pieces a longer pair is cut into, and by how many coarse frames a
#: piece reaches over its ends on the reference's side.
FRAMES, PIECES, MARGIN = 2048, 16, 6


def warping_path(a: np.ndarray, b: np.ndarray, first_end: int) -> list[tuple[int, int]]:
    """The cheapest path of frames a through frames b (unit rows) by antidiagonals: cosine costs; a step along one side alone costs
    the median cost more and never follows another of its kind; it starts anywhere in b and ends at b's frame first_end or later.
    Of equal ways the diagonal one, then the step of a alone. Empty if there is no path."""
    cost = np.clip(1 - a @ b.T, 0.0, 2.0)
    n, m = cost.shape
    penalty = float(np.median(cost))
    before = last = np.full(n, np.inf)  # totals of the two antidiagonals before, by a's frame
    kind_last = np.zeros(n, dtype=np.int8)
    kinds, end = [], np.full(m, np.inf)
    for s in range(n + m - 1):
        lo, hi = max(0, s - m + 1), min(n - 1, s) + 1
        diagonal, down, along = np.full(n, np.inf), np.full(n, np.inf), np.full(n, np.inf)
        diagonal[1:] = before[:-1]
        down[1:] = np.where(kind_last[:-1] == 1, np.inf, last[:-1] + penalty)
        along[:] = np.where(kind_last == 2, np.inf, last + penalty)
        best, kind = diagonal, np.zeros(n, dtype=np.int8)
        for k, way in ((1, down), (2, along)):
            better = way < best
            best, kind = np.where(better, way, best), np.where(better, k, kind)
        if lo == 0:
            best[0], kind[0] = 0.0, 0
        at = np.arange(lo, hi)
        now = np.full(n, np.inf)
        now[lo:hi] = best[lo:hi] + cost[at, s - at]
        before, last, kind_last = last, now, kind.astype(np.int8)
        kinds.append(kind_last)
        if hi == n:
            end[s - n + 1] = now[n - 1]
    j = min(first_end, m - 1) + int(end[min(first_end, m - 1) :].argmin())
    if not np.isfinite(end[j]):
        return []
    i, path = n - 1, []
    while i > 0:
        path.append((i, j))
        i, j = {0: (i - 1, j - 1), 1: (i - 1, j), 2: (i, j - 1)}[int(kinds[i + j][i])]
    return [(i, j), *reversed(path)]


def _unit(column: pd.Series) -> np.ndarray:
    m = np.stack(column.to_numpy()).astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def dtw_pairs(a: DataFrame, b: DataFrame, by: str, gully: float = 0.96, every_s: float = 0.25, frames: int = FRAMES) -> DataFrame:
    """Chroma frames (time_s, chroma) of take and reference -> anchors (time_s, to_s) of the cheapest warping path
    (warping_path), about every_s apart; it ends in the last (1 - gully) of b. Frames without time, chroma or `by` are passed over.

    A pair of at most `frames` a side is one group. A longer one is first aligned by means of its chroma over coarse frames, and cut
    along that path into PIECES, each with the reference's frames up to MARGIN coarse frames beyond its ends; pieces that are still
    too long are cut again. So a task holds a few thousand frames, whatever a pair's length; a long pair's path is the best one
    inside those margins, each piece takes its own median cost, and anchors that fall behind an earlier one where pieces meet go.
    """
    kind = a.schema[by].dataType.simpleString()
    size = a.agg(F.max(F.size("chroma"))).first()[0] or 0
    known = lambda x: x.filter(F.col("time_s").isNotNull() & F.col("chroma").isNotNull() & F.col(by).isNotNull()).select(by, F.col("time_s").cast("double").alias("time_s"), "chroma")
    left, right = known(a), known(b)
    ends = lambda x, n: x.groupBy(by).agg(F.min("time_s").alias(f"{n}_lo"), F.max("time_s").alias(f"{n}_hi"))
    pieces = ends(left, "a").join(ends(right, "b"), by).withColumns({"b_end": F.lit(None).cast("double"), "a_hi": F.col("a_hi") + 1e-6, "b_hi": F.col("b_hi") + 1e-6, "piece": F.lit("")})
    fields = f"{by} {kind}, piece string, a_lo double, a_hi double, b_lo double, b_hi double, b_end double"

    def own(x: DataFrame, some: DataFrame, n: str) -> DataFrame:
        spans = some.select(by, "piece", F.col(f"{n}_lo").alias("start_s"), F.col(f"{n}_hi").alias("end_s"), "a_lo", "a_hi", "b_lo", "b_hi", "b_end")
        out = interval_join(x, spans, by, width=60.0).drop("start_s", "end_s")
        return out.toDF(*out.columns)  # both sides of a cogroup come from the same pieces

    def first_end(times: np.ndarray, b_end) -> int:
        return int(gully * (len(times) - 1)) if b_end is None or np.isnan(b_end) else int(np.searchsorted(times, b_end))

    def cut(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in fields.split(", ")]
        if not len(one) or not len(other):
            return pd.DataFrame(columns=names)
        one, other = one.sort_values("bin"), other.sort_values("bin")
        piece, w = one.iloc[0], float(one["w"].iloc[0])
        path = warping_path(_unit(one["chroma"]), _unit(other["chroma"]), first_end(piece["b_lo"] + other["bin"].to_numpy() * w, piece["b_end"])) or [(0, 0), (len(one) - 1, len(other) - 1)]
        at = lambda k: piece["b_lo"] + float(other["bin"].iloc[k]) * w
        step = -(-len(one) // PIECES)
        marks = [next(x for x in path if x[0] >= k) for k in range(0, len(one), step)] + [(len(one), path[-1][1])]
        rows = []
        for k, ((i0, j0), (i1, j1)) in enumerate(zip(marks, marks[1:])):
            final = k == len(marks) - 2
            starts, stops = piece["a_lo"] + float(one["bin"].iloc[i0]) * w, piece["a_hi"] if final else piece["a_lo"] + float(one["bin"].iloc[i1]) * w
            end = max(at(j1) - MARGIN * w, piece["b_lo"]) if not final else piece["b_end"] if piece["b_end"] == piece["b_end"] and piece["b_end"] is not None else piece["b_lo"] + gully * (piece["b_hi"] - piece["b_lo"])
            rows.append((piece[by], f"{piece['piece']}.{k:03}", starts, stops, max(at(j0) - MARGIN * w, piece["b_lo"]), min(at(j1) + (MARGIN + 1) * w, piece["b_hi"]), end))
        return pd.DataFrame(rows, columns=names)

    done = None
    for _ in range(8):  # each round cuts a piece into PIECES
        count = lambda x, n: own(x, pieces, n).groupBy(by, "piece").agg(F.count(F.lit(1)).alias(f"n_{n}"))
        sized = materialised(pieces.join(count(left, "a"), [by, "piece"]).join(count(right, "b"), [by, "piece"], "left").withColumn("fits", F.greatest("n_a", F.coalesce("n_b", F.lit(0))) <= frames).drop("n_a", "n_b"))
        fit = sized.filter("fits").drop("fits")
        done = fit if done is None else done.unionByName(fit)
        large = sized.filter("NOT fits").drop("fits")
        if large.isEmpty():
            break
        width = F.greatest(F.col("a_hi") - F.col("a_lo"), F.col("b_hi") - F.col("b_lo")) / (frames // 2)

        def coarse(x: DataFrame, n: str, large=large) -> DataFrame:
            rows = own(x, large, n).withColumn("w", width)
            binned = rows.withColumn("bin", F.floor((F.col("time_s") - F.col(f"{n}_lo")) / F.col("w")))
            means = F.array(*(F.avg(F.get("chroma", F.lit(k))) for k in range(size)))
            return binned.groupBy(by, "piece", "a_lo", "a_hi", "b_lo", "b_hi", "b_end", "w", "bin").agg(means.alias("chroma"))

        pieces = materialised(coarse(left, "a").groupBy(by, "piece").cogroup(coarse(right, "b").groupBy(by, "piece")).applyInPandas(cut, fields))
    else:
        done = done.unionByName(pieces)

    def align(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        columns = [by, "piece", "time_s", "to_s"]
        if not len(one) or not len(other):
            return pd.DataFrame(columns=columns)
        one, other = one.sort_values("time_s"), other.sort_values("time_s")
        t, u = one["time_s"].to_numpy(), other["time_s"].to_numpy()
        rows, last = [], -np.inf
        for i, j in warping_path(_unit(one["chroma"]), _unit(other["chroma"]), first_end(u, one["b_end"].iloc[0])):
            if t[i] - last >= every_s:
                rows.append((one[by].iloc[0], one["piece"].iloc[0], float(t[i]), float(u[j])))
                last = t[i]
        return pd.DataFrame(rows, columns=columns)

    anchors = own(left, done, "a").groupBy(by, "piece").cogroup(own(right, done, "b").groupBy(by, "piece")).applyInPandas(align, f"{by} {kind}, piece string, time_s double, to_s double")
    met = running_max(anchors, by, ["time_s"], {"_before": (F.col("to_s"), False)})
    return met.filter((F.col("piece") == "") | F.col("_before").isNull() | (F.col("to_s") > F.col("_before"))).select(by, "time_s", "to_s")


def annotate_sections(sections: DataFrame, contour: DataFrame, by: str) -> DataFrame:
    """Sections with the contour's energy at their middle (linear between points)."""
    from beatlake.operators.sequences import map_times

    middle = sections.withColumn("time_s", (F.col("start_s") + F.col("end_s")) / 2)
    return map_times(middle, contour.select(by, "time_s", F.col("value").alias("to_s")).dropDuplicates([by, "time_s"]), by).withColumnRenamed("mapped_s", "energy").drop("time_s")


def held_by(points: DataFrame, regions: DataFrame, by: str) -> DataFrame:
    """Points inside key regions, for P12 and W30 (start_s, end_s, key_pc, key_mode)."""
    return interval_join(points, regions, by)


def fit_of(onsets: DataFrame, grid: DataFrame, by: str) -> DataFrame:
    """J32's errors: the median distance of onsets to a grid."""
    return grid_fit(onsets, grid, [by])
