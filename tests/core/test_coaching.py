"""Live coaching: the stream tells what the replay tells, over many triggers; timers, late frames and the gate."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

from beatlake.streaming import coaching, live

START = datetime(2024, 1, 1)


def frames_of(rng, take, n, step=0.1):
    """A take with loud and quiet stretches, clipping, bursts and leaps of an octave."""
    rows, t = [], 0.0
    for k in range(n):
        t += step * rng.choice([0.5, 1, 1, 1.5]) + (rng.choice([3, 7, 9]) if rng.random() < 0.01 else 0)
        loud = (k // 60) % 3
        rms = rng.gauss((-62, -30, -6 if take % 2 else -41)[loud], 2)
        low = rng.choice([0.1, 0.2, 0.5, 0.95])
        rows.append((take, k, START + timedelta(seconds=t), t, rms, rms + 6, rng.random() < 0.02 or 200 < k < 205, low, rng.choice([0.05, 0.1, 0.3, 0.6]), rng.choice([None, 60.0, 60.2, 72.1, 48.0])))
    return rows


@pytest.fixture(scope="module")
def takes():
    rng = random.Random(4)
    return [r for take in range(3) for r in frames_of(rng, take, 700)]


def started(spark, path, sink, **options):
    spark.conf.set(*coaching.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = spark.readStream.schema(coaching.MEASURED).option("maxFilesPerTrigger", 1).parquet(path)
    out = coaching.live_coaching(stream, **options)
    out.writeStream.format("memory").queryName(sink).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.table(sink).collect()


def store(spark, path, rows, n):
    spark.createDataFrame(rows, coaching.MEASURED).coalesce(1).write.parquet(f"{path}/{n:03}")


def rows_of(rows):
    return Counter((r["take_id"], r["kind"], r["event_id"], r["at_s"], r["floor_db"], r["is_voice"], r["is_plosive"], r["midi"], r["cue"], r["severity"], r["value"]) for r in rows)


def test_a_stream_tells_what_its_replay_tells(spark, takes, tmp_path):
    rng = random.Random(5)
    # Frames come up to four seconds late, over twelve triggers; a last frame of another take moves the watermark over all.
    order = sorted(takes, key=lambda r: r[3] + rng.uniform(0, 4))
    size = -(-len(order) // 12)
    for k in range(12):
        store(spark, tmp_path, order[k * size : (k + 1) * size], k)
    store(spark, tmp_path, [(99, 0, START + timedelta(seconds=5000), 0.0, -70.0, -60.0, False, 0.0, 0.0, None)], 12)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    got = started(spark, f"{tmp_path}/*", "coached", delay_s=6, idle_s=100_000)
    want = coaching.replay(spark.createDataFrame(takes, coaching.MEASURED).repartition(5)).collect()
    assert rows_of(got) == rows_of(want)
    cues = Counter(r["cue"] for r in got if r["kind"] == "cue")
    assert {"clipping", "no_signal", "too_quiet", "plosive"} <= set(cues) and len(cues) >= 5


def test_only_the_watermark_moves(spark, tmp_path):
    """A take whose frames stop is told so, once, though it has no more frames; another take's frames move the time."""
    voice = [(1, k, START + timedelta(seconds=k / 10), k / 10, -20.0 if k > 25 else -65.0, -10.0, False, 0.1, 0.2, None) for k in range(40)]
    store(spark, tmp_path, voice, 0)
    for k in range(1, 5):
        store(spark, tmp_path, [(2, k, START + timedelta(seconds=10 * k), 10.0 * k, -70.0, -60.0, False, 0.0, 0.0, None)], k)
    got = [r for r in started(spark, f"{tmp_path}/*", "stalled", delay_s=2) if r["kind"] == "cue"]
    assert [(r["take_id"], r["cue"], r["event_id"], r["at_s"]) for r in got] == [(1, "no_signal", None, round(3.9 + 4 + 0.8 + 1, 2))]


def test_late_frames_are_told_and_change_nothing(spark, takes, tmp_path):
    one = [r for r in takes if r[0] == 1][:300]
    late = [(1, 10_000 + k, one[k][2], one[k][3], -1.0, 0.0, True, 0.9, 0.01, 70.0) for k in range(20)]
    store(spark, tmp_path, one[:150], 0)
    store(spark, tmp_path, one[150:], 1)
    store(spark, tmp_path, late, 2)
    store(spark, tmp_path, [(2, 0, START + timedelta(seconds=3000), 0.0, -70.0, -60.0, False, 0.0, 0.0, None)], 3)
    got = started(spark, f"{tmp_path}/*", "late", delay_s=1, idle_s=100_000)
    assert sorted(r["event_id"] for r in got if r["kind"] == "late") == [10_000 + k for k in range(20)]
    want = coaching.replay(spark.createDataFrame(one, coaching.MEASURED)).collect()
    assert rows_of(r for r in got if r["kind"] != "late") == rows_of(want)


def test_floor_is_the_percentile_of_a_sliding_ring():
    rng = random.Random(8)
    levels = [rng.choice([-60.0, rng.uniform(-80, 0)]) for _ in range(1500)]
    floor = coaching.Floor()
    for k, x in enumerate(levels):
        got, last = floor.after(x), levels[max(0, k - 399) : k + 1]
        assert got == pytest.approx(live.FLOOR_START if len(last) < 20 else np.percentile(last, 10), abs=1e-9)


def test_replay_of_odd_frames(spark):
    rows = [(None, 1, START, 0.0, None, None, None, None, None, None), (1, None, START, 0.0, -20.0, -3.0, True, 0.5, 0.1, 60.0), (1, 2, None, 1.0, -20.0, -3.0, True, 0.5, 0.1, 60.0), (1, 3, START, None, -20.0, -3.0, True, 0.5, 0.1, 60.0)]
    got = coaching.replay(spark.createDataFrame([(*r, "x") for r in rows], coaching.MEASURED + ", kind string")).collect()
    assert Counter((r["take_id"], r["kind"], r["event_id"], r["is_voice"], r["is_plosive"]) for r in got) == Counter({(None, "frame", 1, False, False): 1, (1, "frame", None, True, True): 1, (1, "cue", None, None, None): 1})  # a budget of one in six seconds
    assert coaching.replay(spark.createDataFrame([], coaching.MEASURED)).count() == 0
