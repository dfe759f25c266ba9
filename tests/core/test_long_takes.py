"""J12, W3 and W13 on takes that are cut into stretches, against plain folds of whole takes; a hot take is spread over many tasks."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from beatlake.operators import joins, planning, sequences


def plain_slots(onsets, slots, slot_s, most_s=0.12, skip=0.85, pull=0.2):
    """The least total over all choices, by last slot, without pruning."""
    states = {-1: (0.0, [])}  # last slot's number: cost, choices
    for t, event, strength in sorted(onsets):
        new = {k: (c + skip, way) for k, (c, way) in states.items()}
        for n, s in enumerate(slots):
            if abs(t - s) <= most_s:
                cost, way = min((v for k, v in states.items() if k < n), key=lambda v: v[0])
                cost += abs(t - s) / slot_s - pull * strength / 100
                if n not in new or cost < new[n][0]:
                    new[n] = (cost, [*way, (event, s)])
        states = new
    return min(states.values(), key=lambda v: v[0])


@pytest.fixture(scope="module")
def hot():
    """A take of two hours and two short ones: bursts of onsets, closer than the slots' reach, with pauses between them."""
    rng, rows, t = random.Random(3), [], 0.0
    for k in range(1200):
        t += rng.choice([0.03, 0.05, 0.11, 0.2, 0.31]) if rng.random() < 0.9 else rng.uniform(0.5, 25)
        rows.append((1, k, t, rng.uniform(0, 100)))
    return rows + [(2, 1, 0.02, 50.0), (2, 2, 0.09, 80.0), (2, 3, 0.5, None), (3, 1, 5.0, 1.0), (None, 1, 0.0, 1.0), (2, 4, None, 1.0)]


def test_slots(spark, hot):
    onsets = spark.createDataFrame(hot, "take_id long, event_id long, time_s double, strength double")
    end = max(r[2] or 0 for r in hot)
    slots = [k * 0.125 for k in range(int(end / 0.125) + 2)]
    grid = spark.createDataFrame([(take, s) for take in (1, 2) for s in slots], "take_id long, time_s double")
    got = planning.assign_onsets(onsets, grid, "take_id", 0.125)
    by = {}
    for r in got.collect():
        by.setdefault(r["take_id"], []).append((r["event_id"], r["slot_at"]))
    assert set(by) == {1, 2}
    for take, found in by.items():
        own = [(t, e, s or 0.0) for k, e, t, s in hot if k == take and t is not None]
        cost, way = plain_slots(own, slots, 0.125)
        at = {e: (t, s) for t, e, s in own}
        total = sum(abs(at[e][0] - s) / 0.125 - 0.2 * at[e][1] / 100 for e, s in found) + 0.85 * (len(own) - len(found))
        assert total == pytest.approx(cost, abs=1e-6) and Counter(found) == Counter(way)
        order = [s for _, s in sorted(found, key=lambda x: at[x[0]][0])]
        assert order == sorted(set(order))


def test_a_hot_take_is_cut_where_no_choice_crosses(spark, hot):
    rows = spark.createDataFrame([r for r in hot if r[0] == 1], "take_id long, event_id long, time_s double, strength double")
    for span in (3600.0, 60.0, 1.0):  # wherever spans end
        reach = rows.withColumns({"_lo": F.col("time_s") - 0.12, "_hi": F.col("time_s") + 0.12})
        out = joins.running_max(reach, "take_id", ["time_s"], {"before": (F.col("_hi"), False), "upto": (F.col("time_s"), True)}, span)
        got = sorted((r["time_s"], r["before"], r["upto"]) for r in out.collect())
        times = sorted(r[2] for r in hot if r[0] == 1)
        assert got == [(t, times[k - 1] + 0.12 if k else None, t) for k, t in enumerate(times)]
    sizes = [r["count"] for r in joins.parts(rows, "take_id", ["time_s"], F.col("time_s") - 0.12, F.col("time_s") + 0.12).groupBy("_part").count().collect()]
    assert sum(sizes) == 1200 and len(sizes) > 80 and max(sizes) < 100


def plain_limits(times, targets, lo=0.8, hi=1.25, passes=8):
    move = [y - t for t, y in zip(times, targets)]
    for _ in range(passes):
        for k in range(1, len(move)):
            gap, change = times[k] - times[k - 1], move[k] - move[k - 1]
            if gap <= 1e-9:
                move[k] = move[k - 1]
            elif not lo <= 1 + change / gap <= hi:
                excess = change - ((hi if 1 + change / gap > hi else lo) - 1) * gap
                move[k - 1] += excess / 2
                move[k] -= excess / 2
    for k in range(1, len(move)):
        gap = times[k] - times[k - 1]
        move[k] = move[k - 1] if gap <= 1e-9 else min(max(move[k], move[k - 1] + (lo - 1) * gap), move[k - 1] + (hi - 1) * gap)
    return [t + m for t, m in zip(times, move)]


def test_limits(spark, hot):
    rng = random.Random(9)
    rows = [(take, t, t + rng.uniform(-0.07, 0.07), f"x{e}") for take, e, t, _ in hot if t is not None]
    rows += [(1, rows[5][1], rows[5][1] + 0.01, "tie"), (7, 1.0, None, "none"), (None, 0.1, 0.2, "null")]
    frame = spark.createDataFrame(rows, "take_id long, time_s double, target_s double, _range string").withColumnRenamed("_range", "label").repartition(5)
    got = sequences.limit_by_neighbours(frame, "take_id")
    assert got.columns == ["take_id", "time_s", "target_s", "label", "limited_s"]
    found = {(r["take_id"], r["label"]): r["limited_s"] for r in got.collect()}
    assert len(found) == len(rows) and found[7, "none"] is None
    for take in (1, 2, 3, None):
        own = sorted((t, y, x) for k, t, y, x in rows if k == take and y is not None)
        for (t, y, x), want in zip(own, plain_limits([r[0] for r in own], [r[1] for r in own])):
            assert found[take, x] == pytest.approx(want, abs=1e-9)
    # Each gap changes by 0.8 to 1.25, also where a take was cut.
    one = sorted((t, found[1, x]) for k, t, _, x in rows if k == 1)
    for (a, x), (b, y) in zip(one, one[1:]):
        assert 0.8 * (b - a) - 1e-9 <= y - x <= 1.25 * (b - a) + 1e-9


def plain_notes(frames, least_s=0.06, jump=1.0):
    out, note = [], []
    for t, midi, voiced in [*sorted(frames), (None, None, False)]:
        if note and (not voiced or abs(midi - statistics.median([m for _, m in note])) > jump):
            if note[-1][0] - note[0][0] >= least_s:
                pitch = [m for _, m in note]
                out.append((note[0][0], note[-1][0], statistics.median(pitch), statistics.pstdev(pitch) * 100))
            note = []
        if voiced:
            note.append((t, midi))
    return out


def test_notes(spark):
    rng = random.Random(6)
    rows, midi = [], 60.0
    for k in range(4000):
        midi = midi + rng.gauss(0, 0.15) if rng.random() < 0.98 else rng.uniform(50, 70)
        rows.append((1, k * 0.011, round(midi, 4), rng.random() < 0.985))
    rows += [(2, 0.0, 60.0, True), (2, 0.05, 61.5, True), (3, 0.0, None, False)]
    frame = spark.createDataFrame([*rows, (2, None, 60.0, True), (2, 0.03, 99.0, None)], "take_id long, time_s double, midi double, voiced boolean").repartition(3)
    got = sorted((r["take_id"], r["start_s"], r["end_s"], r["midi"], r["spread_cents"]) for r in sequences.segment_notes(frame, "take_id").collect())
    want = sorted((1, *x) for x in plain_notes([r[1:] for r in rows if r[0] == 1]))
    assert len(got) == len(want) > 100
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-6)


def test_a_note_of_a_million_frames(spark):
    """One run, one note: a frame costs the logarithm of the note's length."""
    import time

    frame = spark.range(1_000_000).select(F.lit(1).alias("take_id"), (F.col("id") * 0.005).alias("time_s"), (60 + F.sin(F.col("id") * 0.7) * 0.4).alias("midi"), F.lit(True).alias("voiced"))
    began = time.time()
    got = sequences.segment_notes(frame, "take_id").collect()
    assert len(got) == 1 and got[0]["midi"] == pytest.approx(60, abs=1e-3) and time.time() - began < 60


def test_means_are_those_of_the_files_order(spark, tmp_path):
    """Sums of doubles by the order of rows in the files (part-0 before part-1), however partitions split them."""
    from beatlake.operators import profiles
    from beatlake.sources.fixtures import events

    discounts, taxes = [0.01, 0.01, 0.02, 0.05], [0.01, 0.01, 0.01, 0.08]
    lines = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    rows = [(1, 1, 1, k + 1, 10.0 + 2 * (k // 2), 1.0, discounts[k], taxes[k]) for k in range(4)]
    for k in range(2):
        spark.createDataFrame(rows[2 * k : 2 * k + 2], lines).coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        next((tmp_path / f"x{k}").glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    spark.createDataFrame([(1, 7)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    in_order = lambda xs: ((xs[0] + xs[1]) + xs[2]) + xs[3]
    halves = lambda xs: (xs[0] + xs[1]) + (xs[2] + xs[3])
    assert in_order(discounts) != halves(discounts)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(256 << 20))  # a partition for each file
    try:
        got = events(spark, str(tmp_path), "renders").collect()[0]
        assert got["true_peak_db"] == -2 + 20 * (in_order(discounts) / 4)
        notes = events(spark, str(tmp_path), "notes", at=True)
        long_ = [0.05 + t * 10.0 for t in taxes]
        state = profiles.vocal_state(notes.withColumn("midi", F.when(F.col("idx") == 4, 60.5).otherwise(60.0)), spark.createDataFrame([(7, 1.0)], "take_id long, spread_db double")).collect()[0]
        assert state["in_tune"] == ((long_[0] + long_[1]) + long_[2]) / in_order(long_)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
