"""J14 and F6 against a plain version over all pairs, and how few pairs meet; A10 by arrays against the plain search."""

import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatlake.operators import arrangement, profiles

SCHEMA = "take_id long, idx long, text string, duration_s double, rate double, chroma array<double>"


def phrases(rng, takes, n):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(300)]
    rows = []
    for take in range(takes):
        lines = [rng.choices(words, k=rng.randint(1, 9)) for _ in range(n // 4)]
        for idx in range(n):
            line = list(rng.choice(lines))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            if rng.random() < 0.2:
                line.append(line[0])
            text = rng.choice([None, "", "oh", " ".join(line).upper(), ", ".join(line), " ".join(line)])
            chroma = [rng.random() for _ in range(12)]
            rows.append((take, idx, text, rng.choice([None, 0.0, rng.uniform(0.5, 8), 2.0]), rng.choice([None, rng.uniform(1, 6)]), rng.choice([None, chroma])))
    return rows


def plain(rows, least, columns):
    out = {}
    tokens = lambda t: [w for w in re.sub(r"[^\w\s']+", " ", (t or "").lower()).split() if w]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for take, some in by.items():
        for a in some:
            for b in some:
                if a[1] >= b[1]:
                    continue
                parts = []
                if "chroma" in columns and a[5] and b[5]:
                    x, y = np.array(a[5]), np.array(b[5])
                    parts.append((x @ y / (np.linalg.norm(x) * np.linalg.norm(y)), 0.5))
                for k, name in ((3, "duration_s"), (4, "rate")):
                    if name in columns and a[k] is not None and b[k] is not None:
                        parts.append((min(a[k], b[k]) / max(a[k], b[k], 1e-9), 0.1))
                if "text" in columns and a[2] is not None and b[2] is not None:
                    s, t = tokens(a[2]), tokens(b[2])
                    if len(s) >= 2 and len(t) >= 2:
                        parts.append((difflib.SequenceMatcher(None, s, t, autojunk=False).ratio(), 0.6))
                if parts and (v := sum(x * w for x, w in parts) / sum(w for _, w in parts)) >= least:
                    out[take, a[1], b[1]] = v
    return out


@pytest.mark.parametrize("columns, least", [(("text", "duration_s", "rate"), 0.82), (("duration_s", "rate"), 0.93), (("text",), 0.7), (("text", "chroma", "duration_s"), 0.3)])
def test_similar_phrases(spark, columns, least):
    rows = phrases(random.Random(len(columns)), 2, 60)
    frame = spark.createDataFrame(rows, SCHEMA).select("take_id", "idx", *columns).repartition(3)
    want = plain(rows, least, columns)
    got = {(r["take_id"], r["i"], r["j"]): r["similarity"] for r in arrangement.phrase_similarity(frame, "take_id", least).collect()}
    assert set(got) == set(want) and want
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_few_pairs_meet(spark):
    rng = random.Random(1)
    rows = [r for r in phrases(rng, 1, 800) if r[2] and len(r[2].split()) > 2]
    frame = spark.createDataFrame(rows, SCHEMA).select("take_id", "idx", "text").withColumn("_tokens", arrangement.normalised_tokens(F.col("text")))
    met = {(r["i"], r["j"]) for r in arrangement.phrase_pairs(frame, "take_id", 0.8).collect()}
    want = {k[1:] for k in plain(rows, 0.8, ("text",))}
    assert want <= met and len(met) < len(rows) ** 2 / 20


def test_tempo_ratios(spark):
    rng = random.Random(2)
    rows = [(take, rng.choice([k * 0.5 / 1.01, rng.uniform(0, 9000)]), 0.5 if take else 0.25) for take in range(4) for k in range(400)]
    rows += [(7, 1.0, None), (8, None, 0.5), (None, 1.0, 0.5)]
    frame = spark.createDataFrame(rows, "take_id long, time_s double, slot_s double").repartition(4)
    out = profiles.tempo_ratio_search(frame, "take_id")
    assert "Generate" not in out._jdf.queryExecution().toString()
    got = {r["take_id"]: (r["ratio"], r["cost"]) for r in out.collect()}
    ratios = np.array([round(0.96 + 0.08 * k / 800, 6) for k in range(801)])
    assert set(got) == {0, 1, 2, 3, None}
    for take in got:
        t, slot = (np.array([r[k] for r in rows if r[0] == take])[:, None] for k in (1, 2))
        at = t * ratios / slot
        cost = np.round((np.abs(at - np.rint(at)) * slot).mean(axis=0) + 1e-4 * np.abs(ratios - 1), 9)
        assert got[take] == (ratios[cost.argmin()], pytest.approx(cost.min(), abs=2e-9))


def test_tokens_are_few_objects_at_once(spark):
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    sides = [[None if rng.random() < 0.1 else [f"{rng.randrange(40)} word" for _ in range(rng.randrange(120))] for _ in range(4000)] for _ in "ab"]
    a, b = (pa.array(side, pa.list_(pa.string())) for side in sides)
    a, b, sides = a.slice(7), b.slice(7), [side[7:] for side in sides]
    tracemalloc.start()
    got = arrangement.line_similarity.func(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[:700] == [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x and y else 0.0 for x, y in list(zip(*sides))[:700]]
    assert peak < 2**21  # those tokens as strings are 30 MB
    rows = spark.createDataFrame(phrases(rng, 1, 8), SCHEMA).select("take_id", "idx", "text", "duration_s")
    asked = arrangement.phrase_similarity(rows, "take_id", 0.1)._jdf.queryExecution().analyzed().toString()
    assert "line_similarity(CASE WHEN" in asked  # F.when around a UDF doesn't keep rows from it
