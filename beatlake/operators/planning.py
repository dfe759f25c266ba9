"""Planning: profiles, variants, policies, questions, tempo and key decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatlake.constants import GENRE_PROFILES, PROFILE_FIELDS, VARIANTS
from beatlake.functions.music import genre_slug
from beatlake.sources.lineage import stored

#: Differences of times that best_lag holds at once.
BLOCK = 1 << 18


def genre_profiles(df: DataFrame) -> DataFrame:
    """Df with a `profile` struct by genre; unknown genres get the default. The table is a literal, so there is no join."""
    made = {name: F.struct(*(F.lit(x).alias(field) for field, x in zip(PROFILE_FIELDS, values))) for name, values in GENRE_PROFILES.items()}
    table = F.create_map(*(x for name, struct in made.items() for x in (F.lit(name), struct)))
    return df.withColumn("profile", F.coalesce(table[genre_slug(F.col("genre"))], made["default"]))


def expand_variants(df: DataFrame) -> DataFrame:
    """Five rows for each, with the variant's overrides as a map."""
    empty = F.create_map().cast("map<string,double>")
    rows = [F.struct(F.lit(name).alias("variant"), (F.create_map(*(F.lit(x) for kv in extra.items() for x in kv)) if extra else empty).alias("overrides")) for name, extra in VARIANTS.items()]
    return df.withColumn("_v", F.explode(F.array(*rows))).select(*df.columns, "_v.*")


def grid_shift(points: DataFrame, grid: DataFrame, by: str, bar_s: float) -> DataFrame:
    """By entity, the shift that puts points on the grid (minus the circular mean of their phases) and its confidence
    (the resultant's length)."""
    from beatlake.operators.joins import asof_nearest

    angle = 2 * F.pi() * F.col("error_s") / bar_s
    means = asof_nearest(points, grid, by).filter("error_s is not null").groupBy(by).agg(F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"))
    return means.select(by, (-F.atan2("_s", "_c") * bar_s / (2 * F.pi())).alias("shift_s"), F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c")).alias("confidence"))


def decide_keys(pairs: DataFrame) -> DataFrame:
    """Pairs with t_candidates and b_candidates (arrays of pc, mode, score), t_conf, b_conf and stated_pc, stated_mode (null
    unless the user said so). A stated key wins; else the best product of scores among related keys (same tonic, same family,
    or a fifth apart), the mode from the voice; unsure pairs share both scales; sure ones shift."""
    from beatlake.functions.keys import circle_distance, family_root

    combos = F.flatten(F.transform("t_candidates", lambda t: F.transform("b_candidates", lambda b: F.struct(
        F.round(t["score"] * b["score"], 9).alias("p"), (-t["pc"]).alias("n"), (-b["pc"]).alias("m"), t["mode"].alias("mode"),
        ((t["pc"] == b["pc"]) | (circle_distance(family_root(t["pc"], t["mode"]), family_root(b["pc"], b["mode"])) <= 1)).alias("related")))))
    best = F.array_max(F.filter(combos, lambda x: x["related"]))
    sure = (F.col("t_conf") >= 0.55) & (F.col("b_conf") >= 0.55)
    x = pairs.withColumn("_best", best)
    action = F.when(F.col("stated_pc").isNotNull(), "stated").when(F.col("_best").isNotNull(), "related").when(sure, "shift").otherwise("shared_scale")
    return x.withColumns({"key_pc": F.coalesce("stated_pc", -F.col("_best.n")), "key_mode": F.coalesce("stated_mode", "_best.mode"), "action": action}).drop("_best")


def relationships(pairs: DataFrame) -> DataFrame:
    """Pairs with t_duration, b_duration, t_bpm, b_bpm, lag_s and lag_ratio: locked to the beat, or free. One bounce keeps
    lag 0 unless the peak is clear."""
    same = (F.abs(F.col("t_duration") - F.col("b_duration")) <= 0.25) & (F.abs(F.col("t_bpm") - F.col("b_bpm")) <= 0.5)
    locked = same | ((F.col("lag_ratio") >= 1.6) & (F.abs(F.col("t_duration") - F.col("b_duration")) <= 4))
    lag = F.when(~locked, None).when(same & (F.coalesce("lag_ratio", F.lit(0.0)) < 1.35), 0.0).otherwise(F.col("lag_s"))
    return pairs.withColumns({"relationship": F.when(F.coalesce(locked, F.lit(False)), "locked").otherwise("free"), "offset_s": lag})


def best_lag(a: DataFrame, b: DataFrame, by: str, most_s: float = 20.0, bin_s: float = 0.01, apart_s: float = 0.15) -> DataFrame:
    """The lag with most pairs of onsets (smoothed over three bins) and its ratio to the best one beyond apart_s. Onsets
    meet in time buckets, so only those within most_s make pairs, and a bucket's pairs are counted in blocks."""
    k = F.floor(F.col("time_s") / most_s)
    left = a.select(by, k.alias("_k"), F.col("time_s").cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    right = b.select(by, F.explode(F.array(k - 1, k, k + 1)).alias("_k"), F.lit(None).cast("double").alias("x"), F.col("time_s").cast("double").alias("y"))
    met = left.unionByName(right).filter(F.col(by).isNotNull() & F.col("_k").isNotNull()).groupBy(by, "_k").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y")).filter((F.size("x") > 0) & (F.size("y") > 0))
    kind, half = a.schema[by].dataType.simpleString(), round(most_s / bin_s) + 2
    at = np.arange(-half, half + 1)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, xs, ys = batch.column(0), batch.column(2), batch.column(3)
            for i in range(len(own)):
                x, y = np.asarray(xs[i].values), np.asarray(ys[i].values)
                n, step = np.zeros(2 * half + 1, np.int64), max(1, BLOCK // len(y))
                for j in range(0, len(x), step):
                    apart = (y[None, :] - x[j : j + step, None]).ravel()
                    lag = apart[np.abs(apart) <= most_s] / bin_s
                    whole = np.trunc(lag)
                    n += np.bincount((whole + np.sign(lag) * (np.abs(lag - whole) >= 0.5)).astype(np.int64) + half, minlength=2 * half + 1)
                bins = np.flatnonzero(n)
                if len(bins):
                    yield pa.RecordBatch.from_arrays([own.slice(i, 1), pa.array([bins.astype(np.int32)]), pa.array([n[bins]])], names=[by, "bin", "n"])

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = None, np.zeros(2 * half + 1, np.int64)

        def told() -> pa.RecordBatch:
            smooth = n.copy()
            smooth[1:] += n[:-1]
            smooth[:-1] += n[1:]
            tops = at[smooth == smooth.max()]
            best = int(min(tops, key=lambda v: (abs(v), v)))
            top, rest = int(smooth.max()), smooth[np.abs(at - best) * bin_s > apart_s].max(initial=0)
            return pa.RecordBatch.from_arrays([own, pa.array([best * bin_s]), pa.array([top / int(rest) if rest else None], pa.float64())], names=[by, "lag_s", "lag_ratio"])

        for batch in batches:
            for i in range(len(batch)):
                if own is None or batch.column(0)[i] != own[0]:
                    if own is not None:
                        yield told()
                    own = pa.array([batch.column(0)[i].as_py()], batch.schema.types[0])
                    n[:] = 0
                n[np.asarray(batch.column(1)[i].values)] += np.asarray(batch.column(2)[i].values)
        if own is not None:
            yield told()

    # Votes are counted where their pairs meet, and go once to their entity's task, which holds one entity's bins.
    counted = met.mapInArrow(votes, f"`{by}` {kind}, bin array<int>, n array<long>")
    return counted.repartition(by).sortWithinPartitions(by).mapInArrow(peaks, f"`{by}` {kind}, lag_s double, lag_ratio double")


def offset_candidates(histogram: DataFrame, by: str, k: int = 3, apart: int = 12) -> DataFrame:
    """K bins with most votes, each at least `apart` bins from those before it: a fold over the sorted histogram."""
    listed = histogram.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("n", (-F.col("bin")).alias("m"))), asc=False).alias("x"))
    kept = F.aggregate("x", F.slice("x", 1, 0), lambda acc, v: F.when((F.size(acc) < k) & ~F.exists(acc, lambda c: F.abs(c["m"] - v["m"]) < apart), F.concat(acc, F.array(v))).otherwise(acc))
    return listed.select(by, F.posexplode(kept).alias("place", "v")).select(by, "place", (-F.col("v.m")).alias("bin"), F.col("v.n").alias("n"))


def snap_sections(sections: DataFrame, beat_sections: DataFrame, by: str, tolerance: float = 1.6) -> DataFrame:
    """Starts within the tolerance of a beat section's edge move there, never before the start before them."""
    from pyspark.sql import Window

    from beatlake.operators.joins import asof_nearest

    edges = beat_sections.select(by, F.col("start_s").alias("time_s")).union(beat_sections.select(by, F.col("end_s").alias("time_s"))).distinct()
    near = asof_nearest(sections.withColumn("time_s", F.col("start_s")), edges, by)
    moved = near.withColumn("_to", F.when(F.abs("error_s") <= tolerance, F.col("grid.time")).otherwise(F.col("start_s")))
    w = Window.partitionBy(by).orderBy("start_s").rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumn("snapped_s", F.max("_to").over(w)).drop("_to", "grid", "error_s", "time_s")


def bar_phase(starts: DataFrame, downbeats: DataFrame, by: str, bar_s: float, beats: int = 4) -> DataFrame:
    """The rotation of the bar lines by whole beats with the least mean distance (up to half a bar) to phrase starts; kept
    only if that is at most .12 bars and half of the unrotated cost."""
    from beatlake.operators.joins import asof_nearest

    turn = F.explode(F.sequence(F.lit(0), F.lit(beats - 1))).alias("turn")
    s = starts.select(by, "time_s", turn).withColumn("_key", F.struct(by, "turn"))
    g = downbeats.select(by, "time_s", turn).withColumn("time_s", F.col("time_s") + F.col("turn") * bar_s / beats).withColumn("_key", F.struct(by, "turn"))
    cost = asof_nearest(s, g, "_key").groupBy(by, "turn").agg(F.round(F.avg(F.least(F.abs("error_s"), F.lit(bar_s / 2)) / bar_s), 9).alias("cost"))
    best = cost.groupBy(by).agg(F.min(F.struct("cost", "turn")).alias("m"), F.max(F.when(F.col("turn") == 0, F.col("cost"))).alias("plain"))
    good = (F.col("m.cost") <= 0.12) & (F.col("m.cost") <= 0.5 * F.col("plain"))
    return best.select(by, F.when(good, F.col("m.turn")).otherwise(0).alias("turn"), F.when(good, F.col("m.cost")).otherwise(F.col("plain")).alias("cost"))


def beat_fit(pairs: DataFrame) -> DataFrame:
    """What the beat needs to last as long as the voice: nothing, a trim to a bar line, a pad, or a loop of the last chorus
    (else a verse over four seconds, else the last eight bars)."""
    need = F.col("vocal_end_s") - F.col("beat_s")
    loop = F.when(F.col("chorus_s").isNotNull(), "chorus").when(F.col("verse_s") > 4, "verse").otherwise("last_8_bars")
    action = F.when(F.abs(need) <= F.col("bar_s"), "none").when(need < 0, "trim").when(need <= 2 * F.col("bar_s"), "pad").otherwise(F.concat(F.lit("loop_"), loop))
    return pairs.withColumns({"fit": action, "target_s": F.when(need < 0, F.ceil(F.col("vocal_end_s") / F.col("bar_s")) * F.col("bar_s")).otherwise(F.greatest("vocal_end_s", "beat_s"))})


def questions(takes: DataFrame) -> DataFrame:
    """take_id, severity, question, position: what must be asked of a take's owner, blocking ones first. Columns that a
    take doesn't have count as unknown."""
    has = set(takes.columns)
    col = lambda name: F.col(name) if name in has else F.lit(None)
    rules = [
        ("length", "block", col("duration_s") < 6), ("voice", "block", col("voice") == "no_voice"), ("noise", "block", col("noise") == "severe"), ("noise", "warn", col("noise") == "heavy"), ("lead_in", "info", col("lead_in_s") >= 3),
        ("performance", "warn", col("performance_confidence") < 0.7), ("language", "info", col("language_source") == "default"), ("key", "warn", col("key_confidence") < 0.5), ("bpm", "warn", col("bpm_confidence") < 0.4), ("entry", "info", col("entry_bar") > 8),
    ]
    rank = {"block": 0, "warn": 1, "info": 2}
    asked = F.array(*(F.when(F.coalesce(c.cast("boolean"), F.lit(False)), F.struct(F.lit(rank[s]).alias("rank"), F.lit(k).alias("position"), F.lit(q).alias("question"), F.lit(s).alias("severity"))) for k, (q, s, c) in enumerate(rules)))
    return takes.select("take_id", F.explode(F.filter(asked, lambda x: x.isNotNull())).alias("x")).select("take_id", "x.severity", "x.question", "x.rank", "x.position")


REFUSALS = ("", "cancel", "no", "none", "stop")


def unanswered_blocks(asked: DataFrame, intents: DataFrame) -> DataFrame:
    """Blocking questions without an answer: intents has take_id, question, answer; an empty one or a refusal is none."""
    answered = intents.filter(F.col("answer").isNotNull() & ~F.lower(F.trim("answer")).isin(*REFUSALS))
    return asked.filter("severity = 'block'").join(answered.select("take_id", "question"), ["take_id", "question"], "left_anti")


def refuse_unanswered(takes: DataFrame, open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes that may be planned, and those that need answers."""
    return takes.join(open_, "take_id", "left_anti"), takes.join(open_, "take_id", "left_semi")


def validated_intents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows with auto and empty as null, and bad ones with the fields at fault. Columns: performance, tuning, timing,
    bpm, loudness, nudge (all text)."""
    text = lambda name: F.when(~F.lower(F.trim(name)).isin("", "auto"), F.lower(F.trim(name)))
    number = lambda name: F.expr(f"try_cast(nullif(nullif(lower(trim({name})), ''), 'auto') AS double)")
    bad_number = lambda name, lo, hi: text(name).isNotNull() & (number(name).isNull() | ~number(name).between(lo, hi))
    bad_strength = lambda name: text(name).isNotNull() & (text(name) != "off") & (number(name).isNull() | ~number(name).between(0, 1))
    checks = {
        "performance": text("performance").isNotNull() & ~text("performance").isin("rap", "melodic_rap", "sung", "spoken"), "tuning": bad_strength("tuning"), "timing": bad_strength("timing"),
        "bpm": bad_number("bpm", 40, 220), "loudness": bad_number("loudness", -30, -3), "nudge": bad_number("nudge", -16, 16),
    }
    strength = lambda name: F.when(text(name) == "off", 0.0).otherwise(number(name))
    faults = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())
    rows = df.withColumn("faults", faults)
    good = rows.filter(F.size("faults") == 0).withColumns({"performance": text("performance"), "tuning": strength("tuning"), "timing": strength("timing"), "bpm": number("bpm"), "loudness": number("loudness"), "nudge": number("nudge")}).drop("faults")
    return good, rows.filter(F.size("faults") > 0)


def resolve_tempo(takes: DataFrame) -> DataFrame:
    """The reference beat if stated or its bleed was removed (.95), else the user's (.95), else a detected tempo of
    confidence .25, else unknown; tempo 0 is unknown. Warns where the user's isn't an octave of the beat's, or the grid is off."""
    from beatlake.functions.music import octave_related

    made = lambda bpm, c, s: F.struct(bpm.cast("double").alias("bpm"), F.lit(c).cast("double").alias("confidence") if isinstance(c, float) else c.cast("double").alias("confidence"), F.lit(s).alias("source"))
    known = lambda name: F.when(F.col(name) > 0, F.col(name))
    beat = F.when(known("beat_bpm").isNotNull() & (F.col("beat_stated") | F.col("bleed_removed")), made(F.col("beat_bpm"), 0.95, "beat"))
    user = F.when(known("user_bpm").isNotNull(), made(F.col("user_bpm"), 0.95, "user"))
    heard = F.when(known("bpm").isNotNull() & (F.col("bpm_confidence") >= 0.25), made(F.col("bpm"), F.col("bpm_confidence"), "detected"))
    warn = F.filter(F.array(F.when(known("user_bpm").isNotNull() & known("beat_bpm").isNotNull() & ~octave_related(F.col("user_bpm"), F.col("beat_bpm")), "user_tempo_conflicts"), F.when(F.col("grid_error_s") > 0.09, "grid_is_off")), lambda x: x.isNotNull())
    return takes.withColumns({"tempo": F.coalesce(beat, user, heard), "tempo_warnings": warn})


def render_policy(pairs: DataFrame) -> DataFrame:
    """One decision per stage as struct(method, reason); what the user said wins, doubt does less."""
    from beatlake.functions.music import quantise_strength

    made = lambda method, reason: F.struct(F.lit(method).alias("method"), F.lit(reason).alias("reason"))
    locked, tuned = F.col("relationship") == "locked", F.col("state").isin("tuned", "finished")
    unsure_key, unsure_bpm = F.coalesce(F.col("key_confidence") < 0.5, F.lit(True)), F.coalesce(F.col("bpm_confidence") < 0.4, F.lit(True))
    plan = {
        "denoise": F.when(F.col("noise").isin("heavy", "severe"), made("denoise", "noisy")).otherwise(made("none", "clean enough")),
        "placement": F.when(locked, made("measured_lag", "same bounce")).otherwise(made("downbeat", "free take")),
        "stretch": F.when(locked | unsure_bpm, made("none", "locked or unsure tempo")).otherwise(made("stretch", "tempo known")),
        "shift": F.when(unsure_key | (F.col("shift") == 0), made("none", "no sure shift")).otherwise(made("shift", "keys agree after it")),
        "tuning": F.when(F.col("intent_tuning") == 0, made("off", "the user's choice")).when(tuned | unsure_key | (F.col("performance_type") == "rap"), made("off", "tuned, rapped or unsure")).otherwise(made("tune", "raw singing")),
        "timing": F.when(F.col("intent_timing") == 0, made("off", "the user's choice")).when(locked, made("single_offset", "same bounce")).otherwise(made("grid_align", "free take")),
        "dynamics": F.when(F.col("state") == "finished", made("none", "already finished")).otherwise(made("full", "raw take")),
        "space": F.when(F.col("rt60_s") > 0.35, made("dry", "a live room")).otherwise(made("genre", "a dry take")),
        "arrangement": F.when(locked, made("none", "same bounce")).otherwise(made("fit", "free take")),
    }
    strength = F.when(plan["timing"]["method"] == "grid_align", quantise_strength(F.col("genre"), F.col("performance_type"), F.col("grid_consistency"))).otherwise(0.0)
    return pairs.withColumns({**plan, "timing_strength": strength})


def effective_strengths(pairs: DataFrame) -> DataFrame:
    """tuning_strength with tuning_off (why there is none) and timing_strength. Planned tuning counts as it is; without a plan it is
    the genre's with the user's change, none for rap; up to .02 is off. Timing is the larger of the plan's and P36's on a grid,
    none for a single offset, else the plan's."""
    from beatlake.functions.music import quantise_strength

    planned = F.col("plan_tuning").isNotNull()
    own = F.greatest(F.lit(0.0), F.col("genre_tuning") + F.coalesce("tuning_change", F.lit(0.0)))
    tuning = F.when(planned, F.col("plan_tuning")).when(F.col("performance_type") == "rap", 0.0).otherwise(own)
    why = F.when(tuning > 0.02, F.lit(None).cast("string")).when(planned, F.coalesce("plan_reason", F.lit("planned"))).when(F.col("performance_type") == "rap", "rap").otherwise("genre")
    genre = quantise_strength(F.col("genre"), F.col("performance_type"), F.coalesce("grid_stability", F.lit(0.0)))
    base = F.coalesce("plan_timing", F.lit(0.0))
    timing = F.when(F.col("timing_method") == "single_offset", 0.0).when(F.coalesce(F.col("timing_method") == "grid_align", F.lit(True)), F.greatest(base, genre)).otherwise(base)
    return pairs.withColumns({"tuning_strength": F.when(tuning > 0.02, tuning).otherwise(0.0), "tuning_off": why, "timing_strength": timing})


def nudged(offset_s: Column, beats: Column, bpm: Column) -> Column:
    """An offset moved by beats of the beat's own tempo; without either it stays."""
    return offset_s + F.coalesce(F.when(bpm > 0, beats * 60 / bpm), F.lit(0.0))


class _Slots:
    """J12 over a stretch of onsets: the cheapest choices so far by their last slot, each with its chain of choices."""

    def __init__(self, slot_s: float, skip: float, pull: float):
        self.slot_s, self.skip, self.pull = slot_s, skip, pull
        self.states = [(0.0, float("-inf"), None)]  # cost, last slot, chain of (event, slot, chain)

    def push(self, time_s: float, event_id, strength: float, slots: list[float]) -> list[tuple]:
        told = []
        # What ended before the first slot in reach only differs in its cost.
        ended = min((x for x in self.states if x[1] < slots[0]), key=lambda x: x[0], default=None)
        self.states = ([ended] if ended else []) + [x for x in self.states if x[1] >= slots[0]]
        if len(self.states) == 1:  # all later choices go on from here
            told, (_, last, _) = self.close(), self.states[0]
            self.states = [(0.0, last, None)]
        found = [(c + self.skip, s, chain) for c, s, chain in self.states]
        for slot in slots:
            best = min(((c, chain) for c, s, chain in self.states if s < slot), key=lambda x: x[0], default=None)
            if best:
                found.append((best[0] + abs(time_s - slot) / self.slot_s - self.pull * strength, slot, (event_id, slot, best[1])))
        found.sort(key=lambda x: (x[1], x[0]))
        self.states = []
        for state in found:  # a state must be cheaper than all with earlier last slots
            if not self.states or state[0] < self.states[-1][0] - 1e-12:
                self.states.append(state)
        return told

    def close(self) -> list[tuple]:
        chain, rows = min(self.states, key=lambda x: x[0])[2], []
        while chain:
            rows.append(chain[:2])
            chain = chain[2]
        return rows


def assign_onsets(onsets: DataFrame, grid: DataFrame, by: str, slot_s: float, most_s: float = 0.12, skip: float = 0.85, pull: float = 0.2) -> DataFrame:
    """Each onset takes a later slot than the one before it, or none: least total of distance / slot - pull x strength, and
    `skip` for none, in the order of time_s and event_id.

    Slots in reach (within most_s) are found by a join on (entity, time bucket). A take is cut where no slot is in reach of
    onsets on both sides, as no choice crosses there; the stretches go to different tasks, which stream them and hold the cheapest
    choices of one. Onsets without time or any slot in reach have no row; no strength counts as 0.
    """
    from beatlake.operators.joins import parts
    from beatlake.operators.sequences import streamed

    near = grid.select(F.col(by).alias("_by"), F.col("time_s").alias("slot_at"), F.floor(F.col("time_s") / most_s).alias("_k"))
    spread = onsets.select(by, "event_id", F.col("time_s").cast("double").alias("time_s"), (F.coalesce("strength", F.lit(0)) / F.lit(100.0)).alias("strength"))
    spread = spread.withColumn("_at", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda j: F.floor(F.col("time_s") / most_s) + j)))
    # A join by shuffle: Spark doesn't count what explode makes of a row, and would send all onsets through the driver.
    pairs = spread.join(near.hint("merge"), (F.col(by) == F.col("_by")) & (F.col("_at") == F.col("_k")) & (F.abs(F.col("time_s") - F.col("slot_at")) <= most_s))
    reach = pairs.groupBy(by, "time_s", "event_id", "strength").agg(F.array_sort(F.collect_set(F.col("slot_at").cast("double"))).alias("slots"))  # those of a fraction of a second
    cut = parts(reach, by, ["time_s", "event_id"], F.col("slots")[0], F.element_at("slots", -1))
    kind = onsets.schema["event_id"].dataType.simpleString()
    return streamed(cut.select(by, "_part", "time_s", "event_id", "strength", "slots"), by, ["time_s", "event_id"], lambda: _Slots(slot_s, skip, pull), f"event_id {kind}, slot_at double")


#: Rows of a table of harmonies (about a hundred bytes each) that may be broadcast.
HARMONIES = 50_000


def pitch_targets(notes: DataFrame, strength: float = 0.6) -> DataFrame:
    """Notes with root, quality, key_pc, key_mode, genre, exposed, gesture, is_melisma and salience -> decision and
    target. Gestures and runs stay; a target past 1.2 semitones is another note; under 4 cents nothing is heard. Pitch classes
    are found once for each harmony (chord, key, genre, exposure) and not for each note; as 12 bits they meet the notes in a
    hash join, and of the seven semitones around a note the nearest whose bit is set is its target."""
    from beatlake.functions.scalars import clip
    from beatlake.functions.theory import tuning_candidates

    harmony = F.struct("root", "quality", "key_pc", "key_mode", "genre", "exposed")
    one = notes.select(harmony.alias("_harmony")).distinct()
    bits = F.aggregate(tuning_candidates(*(F.col(f"_harmony.{c}") for c in ("root", "quality", "key_pc", "key_mode", "genre", "exposed"))), F.lit(0), lambda s, pc: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), pc.cast("int"))))
    # The table of harmonies is written, so that a small one (by its own count) may go to all tasks and the notes stay where they are.
    table = stored(one.withColumn("_bits", bits))
    table = F.broadcast(table) if table.count() <= HARMONIES else table
    rows = notes.withColumn("_harmony", harmony).join(table, "_harmony").drop("_harmony")
    rows = rows.withColumn("_base", F.bround("midi").cast("int"))
    near = []
    for step in range(-3, 4):
        x = F.col("_base") + step
        listed = F.expr(f"getbit(_bits, pmod(_base + {step}, 12)) = 1")
        near.append(F.when(listed & (F.abs(F.col("midi") - x) <= 1.2), F.struct(F.abs(F.col("midi") - x).alias("a"), x.alias("x"))))
    rows = rows.withColumn("_to", F.least(*near)["x"].cast("double")).withColumn("_off", F.col("_to") - F.col("midi")).drop("_bits", "_base")
    decision = F.when(F.col("gesture").isNotNull() | F.col("is_melisma"), "keep").when(F.col("root").isNull() & F.col("key_pc").isNull(), "no_target").when(F.col("_to").isNull(), "too_far").when(F.abs("_off") * 100 < 4, "in_tune").otherwise("move")
    moved = F.col("midi") + F.col("_off") * clip(strength * F.col("salience"), 0.0, 0.95)
    return rows.withColumn("decision", decision).withColumn("target", F.when(F.col("decision") == "move", moved).otherwise(F.col("midi"))).drop("_to", "_off")


def time_targets(notes: DataFrame, grid: DataFrame, by: str, strength: float = 0.6, within_s: float = 0.12) -> DataFrame:
    """Starts within 120 ms of a slot move towards it by clip(strength x salience); lengths stay."""
    from beatlake.functions.scalars import clip
    from beatlake.operators.joins import asof_nearest

    slots = grid.select(by, "start_s" if "start_s" in grid.columns else F.col("time_s").alias("start_s"))
    near = asof_nearest(notes, slots, by, "start_s")
    move = F.when(F.abs("error_s") <= within_s, -F.col("error_s") * clip(strength * F.col("salience"), 0.0, 0.95)).otherwise(0.0)
    return near.withColumn("new_start_s", F.col("start_s") + move).withColumn("new_end_s", F.col("end_s") + move).drop("grid", "error_s")


def assign_words(words: DataFrame, notes: DataFrame, by: str, slack_s: float = 0.06) -> DataFrame:
    """Each word goes to the note that it overlaps most (with some slack); a note's words are joined in time order; notes
    that a word reaches on into get a dash. words has word_id, text, a_start, a_end; notes have note_id, b_start, b_end."""
    from beatlake.operators.joins import overlap_join

    wide = words.withColumns({"a_start": F.col("a_start") - slack_s, "a_end": F.greatest(F.col("a_end"), F.col("a_start") + 0.05) + slack_s})
    over = overlap_join(wide, notes, by).withColumn("o", F.round(F.least("a_end", "b_end") - F.greatest("a_start", "b_start"), 9))
    best = over.groupBy(by, "word_id").agg(F.max(F.struct("o", (-F.col("b_start")).alias("n"), "note_id", "text", "a_start")).alias("m"))
    sung = best.groupBy(by, F.col("m.note_id").alias("note_id")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("m.a_start", "m.text")))["text"], " ").alias("lyric"))
    held = over.filter("o >= 0.03").join(best.select(by, "word_id", F.col("m.note_id").alias("_own"), F.col("m.n").alias("_n")), [by, "word_id"]).filter((F.col("note_id") != F.col("_own")) & (F.col("b_start") > -F.col("_n"))).select(by, "note_id").distinct().withColumn("_dash", F.lit("-"))
    return notes.join(sung, [by, "note_id"], "left").join(held, [by, "note_id"], "left").withColumn("lyric", F.coalesce("lyric", "_dash")).drop("_dash")
