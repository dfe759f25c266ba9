"""Values of A39, W7, J15, A42, W20 and W21 against plain versions on random songs."""

import random
import statistics

import pytest

from beatlake.constants import CHORDS, SCALES
from beatlake.operators import arrangement, harmony, sequences


def test_modulations(spark):
    rng = random.Random(3)
    chords = []
    for song in range(6):
        key = rng.randrange(12)
        for bar in range(60):
            if rng.random() < 0.06:
                key = rng.randrange(12)
            degree, quality = rng.choice([(0, "maj"), (5, "maj"), (7, "maj"), (9, "min"), (2, "min")])
            chords.append((song, bar, (key + degree) % 12, quality, rng.choice([1.0, 2.0, 4.0])))
    got = sorted(tuple(r) for r in harmony.modulations(spark.createDataFrame(chords, "song long, bar long, root int, quality string, duration_s double").repartition(4), "song").collect())
    names = sorted((mode, pc) for mode in ("major", "minor") for pc in range(12))
    want = []
    for song in range(6):
        rows = [c for c in chords if c[0] == song]
        fit = [[len({(r + s) % 12 for s in CHORDS[q]} & {(pc + s) % 12 for s in SCALES[mode]}) / 3 + (0.25 if r == pc else 0) for mode, pc in names] for _, _, r, q, _ in rows]
        score = []
        for k in range(len(rows)):
            near = range(max(0, k - 4), min(len(rows), k + 5))
            score.append([round(sum(fit[j][n] * rows[j][4] for j in near) / sum(rows[j][4] for j in near), 9) for n in range(24)])
        family = [(pc + 3 * (mode == "minor")) % 12 for mode, pc in names]
        now, start, count = score[0].index(max(score[0])), 0, 0
        for bar, s in enumerate(score):
            best = s.index(max(s))
            if family[best] != family[now] and s[best] - s[now] > 0.18:
                first = bar if not count else first
                count += 1
            else:
                count = 0
            if count >= 2:
                want.append((song, start, first, names[now][1], names[now][0]))
                now, start, count = best, first, 0
        want.append((song, start, len(rows), names[now][1], names[now][0]))
    assert got == sorted(want) and len(want) > 8


def test_overlong_regions(spark):
    rng = random.Random(4)
    frames = [(take, k * 0.25, round(rng.uniform(-60, -10), 2)) for take in range(3) for k in range(400)]
    regions = [(0, 0.0, 90.0), (1, 3.0, 14.9), (1, 20.0, 70.0), (2, 0.0, 100.0), (2, 300.0, 330.0), (2, 200.0, 200.5)]
    got = sorted(tuple(r) for r in sequences.split_overlong(spark.createDataFrame(regions, "take_id long, start_s double, end_s double"), spark.createDataFrame(frames, "take_id long, time_s double, rms_db double").repartition(3), "take_id").collect())

    def split(take, s, e):
        inner = [(db, t) for k, t, db in frames if k == take and s + 0.2 * (e - s) <= t < s + 0.8 * (e - s)]
        if e - s <= 12 or not inner:
            return [(take, s, e)]
        at = min(inner)[1]
        return split(take, s, at) + split(take, at, e)

    assert got == sorted(x for r in regions for x in split(*r))


@pytest.fixture(scope="module")
def song():
    """Phrases of three takes in groups that repeat, with gaps, short ones and chains of likeness."""
    rng, rows = random.Random(7), []
    for take in range(3):
        t = 0.0
        for idx in range(24):
            d = rng.choice([0.3, 0.7, 1.5, 2.5, 4.0])
            t += rng.choice([0.1, 0.5, 1.5])
            rows.append((take, idx, t, t + d, rng.uniform(55, 70), rng.uniform(-30, -10)))
            t += d
    links = [(take, i, j, rng.choice([0.7, 0.83, 0.9])) for take in range(3) for i in range(24) for j in range(i + 1, 24) if rng.random() < 0.06]
    return rows, links + [(0, k, k + 1, 0.9) for k in range(0, 6)]


def groups_of(rows, links, least):
    label = {r[:2]: r[1] for r in rows}
    for _ in range(30):
        for take, i, j, s in links:
            if s >= least:
                label[take, i] = label[take, j] = min(label[take, i], label[take, j])
    return {(take, idx): sorted({v for (t, _), v in label.items() if t == take}).index(v) for (take, idx), v in label.items()}


def test_structure(spark, song):
    rows, links = song
    frame = spark.createDataFrame(rows, "take_id long, idx long, start_s double, end_s double, midi double, level double").repartition(3)
    similar = spark.createDataFrame(links, "take_id long, i long, j long, similarity double")
    got = {(r["take_id"], r["idx"]): r["group_id"] for r in arrangement.repeat_groups(frame, similar, "take_id").collect()}
    group = groups_of(rows, links, 0.82)
    assert got == group
    # A42
    of = frame.selectExpr("*", "end_s - start_s AS duration_s").join(spark.createDataFrame([(*k, v) for k, v in group.items()], "take_id long, idx long, group_id long"), ["take_id", "idx"])
    hooks = {r["take_id"]: (r["hook_group"], r["score"]) for r in arrangement.pick_hook(of, "take_id").collect()}
    want_hooks = {}
    for take in range(3):
        own = [r for r in rows if r[0] == take]
        mean = lambda some, k: sum(r[k] for r in some) / len(some)
        best = None
        for g in sorted({group[r[:2]] for r in own}):
            some = [r for r in own if group[r[:2]] == g]
            unit = lambda x: min(max(x / 6, 0), 1)
            score = round(0.55 * min(len(some) / 4, 1) + 0.3 * unit(mean(some, 4) - mean(own, 4)) + 0.15 * unit(mean(some, 5) - mean(own, 5)), 9)
            if len(some) >= 2 and sum(r[3] - r[2] for r in some) / len(some) >= 0.8 and score > 0 and (best is None or score > best[1]):
                best = (g, score)
        if best:
            want_hooks[take] = best
    assert hooks == {k: (g, pytest.approx(v)) for k, (g, v) in want_hooks.items()} and hooks
    # W20, W21
    sized = [(*r[:4], group[r[:2]], group[r[:2]] == want_hooks.get(r[0], (None,))[0], sum(group[x[:2]] == group[r[:2]] for x in rows if x[0] == r[0])) for r in rows]
    labelled = arrangement.label_phrases(spark.createDataFrame(sized, "take_id long, idx long, start_s double, end_s double, group_id long, is_hook boolean, group_size long").repartition(3), "take_id")
    got_labels = {(r["take_id"], r["idx"]): r["label"] for r in labelled.collect()}
    want_labels, want_sections = {}, []
    for take in range(3):
        own = sorted((x for x in sized if x[0] == take), key=lambda x: (x[2], x[1]))
        median = statistics.median(x[3] - x[2] for x in own)
        label = []
        for k, x in enumerate(own):
            gap = min(x[2] - own[k - 1][3] if k else 1e9, own[k + 1][2] - x[3] if k + 1 < len(own) else 1e9)
            label.append("hook" if x[5] else "adlib" if x[6] == 1 and x[3] - x[2] <= min(1.4, 0.55 * median) and gap <= 1 else "verse")
        first_pass = list(label)
        before = [sum(x[5] for x in own[: k + 1]) for k in range(len(own))]
        for k in range(len(own)):
            if first_pass[k] == "verse" and k == 0 and before[k] == 0 and before[-1] > 0:
                label[k] = "intro"
            elif first_pass[k] == "verse" and k + 1 < len(own) and first_pass[k + 1] == "hook" and before[k] > 0:
                label[k] = "prehook"
        late = [k for k in range(len(own)) if label[k] in ("verse", "prehook") and own[k][6] == 1 and 2 <= before[k] < before[-1]]
        if late:
            label[late[0]] = "bridge"
        want_labels |= {(take, x[1]): v for x, v in zip(own, label)}
        runs = []
        for x, v in zip(own, label):
            if runs and runs[-1][0] == v:
                runs[-1] = (v, runs[-1][1], max(runs[-1][2], x[3]))
            else:
                runs.append((v, x[2], x[3]))
        for k, (v, s, e) in enumerate(runs):
            start = (runs[k - 1][2] + s) / 2 if k else s
            end = (e + runs[k + 1][1]) / 2 if k + 1 < len(runs) else e
            if end - start >= 0.3:
                want_sections.append((take, k, v, pytest.approx(start), pytest.approx(end)))
    assert got_labels == want_labels
    got_sections = sorted((tuple(r[c] for c in ("take_id", "seq", "label", "start_s", "end_s")) for r in arrangement.sections_from_labels(labelled, "take_id").collect()), key=lambda x: x[:2])
    assert got_sections == want_sections


def test_flat_channels_have_no_correlation(spark):
    from beatlake.operators import profiles

    rows = [(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (3, None, 2.0), (4, 1.0, 2.0), (4, 2.0, 4.0), (4, None, 9.0), (5, 1.0, 2.0), (5, 2.0, 1.0)]
    got = {r.k: (r.corr, r.verdict) for r in profiles.channel_check(spark.createDataFrame(rows, "k int, left double, right double"), "k").collect()}
    assert got[1][0] != got[1][0] and got[2][0] != got[2][0] and got[1][1] == got[2][1] == "stereo"
    assert got[3] == (None, "stereo")
    assert abs(got[4][0] - 1) < 1e-12 and got[4][1] == "fake_stereo" and abs(got[5][0] + 1) < 1e-12 and got[5][1] == "inverted"


def test_takes_of_a_kind_share_their_scored_pairs(spark):
    from beatlake.operators import matching

    rows = [(k, 90.0, 0, "major", 0.5, "rap", None if k % 2 else 2.0) for k in range(40)]
    kinds, members = matching.alike(spark.createDataFrame(rows, "take_id long, bpm double, key_pc int, key_mode string, key_confidence double, performance_type string, syllable_rate double"))
    assert kinds.count() == 2
    of = {r.take_id: r._kind for r in members.collect()}
    assert len(of) == 40 and all((of[k] == of[0]) == (k % 2 == 0) for k in range(40))
    got = matching.of_takes(kinds.select("take_id", "syllable_rate"), members).collect()
    assert sorted((r.take_id, r.syllable_rate) for r in got) == [(k, None if k % 2 else 2.0) for k in range(40)]
