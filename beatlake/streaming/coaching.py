"""T2-T10 and T13 as one job, Q8: live coaching of takes from measured frames, on a stream or as a replay of a table.

A frame passes the gate (its level against a floor of the last 400 frames), the plosive rule, octave repair and the coach, in this
order and in the order of event time. On a stream frames wait in state until the watermark has passed them, so what is told
doesn't depend on triggers, and frames behind the watermark go to a side output instead of changing anything. Event-time timers
tell of takes whose frames stop.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from math import fma

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from beatlake.operators.acoustics import continued
from beatlake.streaming.live import FLOOR_FRAMES, FLOOR_LEAST, FLOOR_START, GATE_DB, GATE_LEAST, SILENCE_S, SUSTAIN_S, Coach

#: Frames as measured: shares of the bands 80-250 Hz and 400-2000 Hz, and a pitch where one was found.
MEASURED = "take_id long, event_id long, ts timestamp, time_s double, rms_db double, peak_db double, clipped boolean, low double, mid double, midi double"
#: What is told: kind is frame, cue or late; a frame has its gate, plosive and repaired pitch, a cue its name and severity.
TOLD = "take_id long, kind string, event_id long, at_s double, floor_db double, is_voice boolean, is_plosive boolean, midi double, cue string, severity string, value double"
COLUMNS = [x.split()[0] for x in TOLD.split(", ")]
#: T4: a burst of lows with almost no mids, twice the lows before it. A frame without a level counts as silent.
LOW, MID, RISE, SILENT_DB = 0.45, 0.12, 2.0, -120.0
#: A take whose frames stop is told of its silence so long after a frame would have told it.
STALL_S = 1.0


class Floor:
    """The tenth percentile of the last FLOOR_FRAMES levels, kept in order so that a frame costs one insertion and removal."""

    def __init__(self, levels=()):
        self.ring = deque(levels)
        self.order = sorted(self.ring)

    def after(self, level: float) -> float:
        self.ring.append(level)
        insort(self.order, level)
        if len(self.ring) > FLOOR_FRAMES:
            del self.order[bisect_left(self.order, self.ring.popleft())]
        if len(self.ring) < FLOOR_LEAST:
            return FLOOR_START
        at = 0.1 * (len(self.order) - 1)
        k = int(at)
        lower, upper = self.order[k], self.order[min(k + 1, len(self.order) - 1)]
        return fma(lower, 1 - (at - k), upper * (at - k))  # as live.voice_gate has it, to the last bit


class Listener:
    """One take: folds frames in event order into rows of TOLD (without the take)."""

    def __init__(self):
        self.floor, self.coach, self.low, self.midi, self.rms, self.stalled = Floor(), Coach(), 0.0, None, SILENT_DB, False

    def due(self) -> float | None:
        """T10 by a timer: when the take is told of its silence if no frame comes."""
        coach = self.coach
        if coach.voice_at is None or self.stalled:
            return None
        silent = coach.voice_at + SILENCE_S
        return max(coach.since.get("silent", silent) + SUSTAIN_S, silent) + STALL_S

    def until(self, t: float) -> list[tuple]:
        """What falls due before t without a frame."""
        due = self.due()
        if due is None or due >= t:
            return []
        self.stalled = True
        self.coach.since.setdefault("silent", self.coach.voice_at + SILENCE_S)
        cue = self.coach.emit(due, "no_signal", "warn", self.rms)
        return [self._cue(None, cue)] if cue else []

    def hear(self, event_id, t, rms, peak, clipped, low, mid, midi) -> list[tuple]:
        told = self.until(t)
        self.stalled, self.rms = False, rms
        floor = self.floor.after(rms)
        voice = rms > max(GATE_LEAST, floor + GATE_DB)  # T3
        plosive = voice and low > LOW and mid < MID and low > RISE * self.low  # T4
        self.low = low if voice else 0.0
        known = not pd.isna(midi)
        self.midi = (continued(self.midi, midi) if known else self.midi) if voice else None  # T5
        told.append(("frame", event_id, t, floor, voice, plosive, self.midi if known else None, None, None, None))
        ratio = low / max(mid, 1e-6) if voice else 0.0
        if cue := self.coach.see(t, rms, peak, clipped, voice, ratio, plosive):
            told.append(self._cue(event_id, cue))
        return told

    @staticmethod
    def _cue(event_id, cue: tuple) -> tuple:
        name, severity, at_s, value = cue
        return ("cue", event_id, at_s, None, None, None, None, name, severity, value)


def told_rows(take, rows: list[tuple]) -> pd.DataFrame:
    """Rows of TOLD for one take."""
    out = pd.DataFrame([(take, *r) for r in rows], columns=COLUMNS)
    return out.astype({"take_id": "Int64", "event_id": "Int64", "is_voice": "boolean", "is_plosive": "boolean"})


def complete(frames: DataFrame) -> DataFrame:
    """Frames with defined values: those without time are passed over; no level is silence, no bands are 0, no clipping is none."""
    value = {"rms_db": SILENT_DB, "peak_db": SILENT_DB, "low": 0.0, "mid": 0.0}
    kept = frames.filter("ts IS NOT NULL AND time_s IS NOT NULL")
    return kept.select("take_id", "event_id", "ts", "time_s", *(F.coalesce(k, F.lit(v)).alias(k) for k, v in list(value.items())[:2]), F.coalesce("clipped", F.lit(False)).alias("clipped"), *(F.coalesce(k, F.lit(v)).alias(k) for k, v in list(value.items())[2:]), "midi")


def plosives(frames: DataFrame) -> DataFrame:
    """T4 over a table of frames with low, mid and is_voice: is_plosive. The lows before a frame are those of the last one of its
    voiced run, 0 at its start."""
    w = Window.partitionBy("take_id").orderBy("time_s", "event_id")
    before = F.when(F.lag("is_voice").over(w), F.lag("low").over(w)).otherwise(0.0)
    return frames.withColumn("is_plosive", F.coalesce(F.col("is_voice") & (F.col("low") > LOW) & (F.col("mid") < MID) & (F.col("low") > RISE * before), F.lit(False)))


def replay(frames: DataFrame) -> DataFrame:
    """Q8 over a table of frames (MEASURED; more columns don't matter): what a stream of them tells once its watermark has passed
    all of them and each take's last timer. A task streams its takes in order and holds one take's fold."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ear = None, None
        for batch in batches:
            for (none, take), some in batch.groupby(["_none", "take_id"], sort=False):
                told = []
                if (none, take) != last:
                    if ear is not None:
                        yield told_rows(None if last[0] else last[1], ear.until(float("inf")))
                    last, ear = (none, take), Listener()
                for row in some[["event_id", "time_s", "rms_db", "peak_db", "clipped", "low", "mid", "midi"]].itertuples(index=False):
                    told += ear.hear(*row)
                yield told_rows(None if none else take, told)
        if ear is not None:
            yield told_rows(None if last[0] else last[1], ear.until(float("inf")))

    known = complete(frames).withColumns({"_none": F.col("take_id").isNull(), "take_id": F.coalesce("take_id", F.lit(0))})
    return known.repartition("_none", "take_id").sortWithinPartitions("_none", "take_id", "time_s", F.col("event_id").asc_nulls_last()).mapInPandas(fold, TOLD)


class CoachProcessor(StatefulProcessor):
    """The fold as a stateful operator. State by take: frames that wait for the watermark, the ring of levels, baseline samples and
    recent cues as lists, timers of conditions and of cues as maps, the rest as one value.

    Spark's watermark stands `spare_ms` behind the one that decides here, so frames behind the latter still come and can be told
    as late; timers are set earlier by as much.
    """

    FRAME = "event_id long, ts_ms long, time_s double, rms_db double, peak_db double, clipped boolean, low double, mid double, midi double"

    def __init__(self, spare_ms: int, ms_per_s: float, idle_ms: int):
        self.spare_ms, self.ms_per_s, self.idle_ms = spare_ms, ms_per_s, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "low double, midi double, rms double, stalled boolean, clips int, last_cue double, voice_at double, voiced_s double, last_t double, baseline double, clock_ms long, clock_s double")
        self.waiting = handle.getListState("waiting", self.FRAME)
        self.lists = {x: handle.getListState(x, "x double") for x in ("ring", "samples", "recent")}
        self.maps = {x: handle.getMapState(x, "k string", "x double") for x in ("since", "emitted")}

    def close(self) -> None:
        pass

    def _load(self) -> tuple[Listener, tuple | None]:
        ear, clock = Listener(), None
        coach = ear.coach
        if self.value.exists():
            ear.low, ear.midi, ear.rms, ear.stalled, coach.clips, coach.last_cue, coach.voice_at, coach.voiced_s, coach.last_t, coach.baseline, *clock = self.value.get()
        lists = {k: [x for (x,) in state.get()] for k, state in self.lists.items()}
        ear.floor, coach.samples, coach.recent = Floor(lists["ring"]), lists["samples"], lists["recent"]
        coach.since, coach.emitted = ({k: x for (k,), (x,) in state.iterator()} for state in self.maps.values())
        return ear, clock

    def _store(self, ear: Listener, clock) -> None:
        coach = ear.coach
        self.value.update((ear.low, ear.midi, ear.rms, ear.stalled, coach.clips, float(coach.last_cue), coach.voice_at, float(coach.voiced_s), coach.last_t, coach.baseline, *clock))
        samples = coach.samples if coach.baseline is None else []  # a baseline, once found, stays
        for state, values in zip(self.lists.values(), (ear.floor.ring, samples, coach.recent)):
            state.clear()
            if values:
                state.put([(float(x),) for x in values])
        for state, values in zip(self.maps.values(), (coach.since, coach.emitted)):
            state.clear()
            for k, x in values.items():
                state.updateValue((k,), (float(x),))

    def _fold(self, key, fresh: pd.DataFrame | None, watermark: int) -> Iterator[pd.DataFrame]:
        now = watermark + self.spare_ms if watermark > 0 else -(1 << 62)
        told, frames = [], list(self.waiting.get())
        if fresh is not None:
            rows = [tuple(r) for r in fresh.itertuples(index=False)]
            told += [("late", r[0], r[2], *[None] * 7) for r in rows if r[1] < now]
            frames += [r for r in rows if r[1] >= now]
        ready, frames = [f for f in frames if f[1] < now], [f for f in frames if f[1] >= now]
        ear, clock = self._load()
        for event_id, ts_ms, t, *rest in sorted(ready, key=lambda f: (f[2], f[0] is None, f[0] or 0)):
            told += ear.hear(event_id, t, *rest)
            clock = (ts_ms, t)
        wake = min((f[1] + 1 for f in frames), default=None)
        if clock:
            told += ear.until(clock[1] + (now - clock[0]) / self.ms_per_s)
            due = ear.due()
            stall = clock[0] + self.idle_ms if due is None else clock[0] + int((due - clock[1]) * self.ms_per_s) + 2
            wake = stall if wake is None else min(wake, stall)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not frames and clock and now > clock[0] + self.idle_ms:  # the take is over
            for state in (self.value, self.waiting, *self.lists.values(), *self.maps.values()):
                state.clear()
        else:
            if clock:
                self._store(ear, clock)
            self.waiting.clear()
            if frames:
                self.waiting.put(frames)
            self.handle.registerTimer(max(wake, now + 1) - self.spare_ms)
        if told:
            yield told_rows(key[0], told)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows))
        fresh["ts_ms"] = fresh["ts"].astype("int64") // {"ns": 1_000_000, "us": 1_000, "ms": 1, "s": 1}[fresh["ts"].dt.unit]
        names = [x.split()[0] for x in self.FRAME.split(", ")]
        fresh = fresh[names].astype(object)
        yield from self._fold(key, fresh.where(fresh.notna(), None), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, None, timerValues.getCurrentWatermarkInMs())


def live_coaching(frames: DataFrame, delay_s: int = 10, spare_s: int = 3600, ms_per_s: float = 1000.0, idle_s: int = 600) -> DataFrame:
    """Q8 on a stream of MEASURED frames (without a watermark): rows of TOLD, append mode.

    Frames are folded when the latest event time of earlier triggers is delay_s past them. Those that come later are told with
    kind late and change nothing; over spare_s later still Spark drops them. State goes idle_s of event time after a take's last frame. ms_per_s
    is a second of a take in milliseconds of event time. Needs the RocksDB state store.
    """
    marked = complete(frames).withWatermark("ts", f"{delay_s + spare_s} seconds")
    return marked.groupBy("take_id").transformWithStateInPandas(CoachProcessor(spare_s * 1000, ms_per_s, idle_s * 1000), TOLD, "Append", "EventTime")


ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
