"""Importance resampling against a plain version; the radix sort against sorted(), with small digits and blocks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from beatlake.llm import resampling
from beatlake.llm._shared import Scratch

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n_features string, Weight string, rank string, _text string, place long"


def plain(docs, target, percent=10):
    """Rows as the contract words them."""
    find = lambda t: WORD.findall(bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in (t or "").encode()))
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(zlib.crc32(w) % 10000 for w in find(text))
    for text in target:
        t.update(zlib.crc32(w) % 10000 for w in find(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for doc_id, text in docs:
        words = find(text)
        weight = sum(gain(zlib.crc32(w) % 10000) for w in words) // len(words) if words else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(*r, k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return Counter(ranks + [(*r, None) for r in rows if r[1] < 20])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["Quiet", "river", "ÉTÉ", "straße", "x1", "4", "a" * 40, "b" * 33, "c" * 32, "日本語"] + ["".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(200)]
    docs = [(k * 7 - 900, rng.choice([" ", "-", "  \n", "\x7f", "'"]).join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for k in range(300)]
    docs += [(5000, None), (5001, ""), (5002, "!!! ---"), (None, docs[0][1]), (None, " ".join(vocabulary[:30])), docs[3], docs[3], (6000, " ".join(rng.choices(vocabulary, k=40_000))), (1 << 62, docs[9][1]), (-(1 << 62), docs[9][1])]
    return docs, [" ".join(rng.choices(vocabulary[:60], k=50)) for _ in range(20)] + [None, ""]


def test_equals_the_plain_version(spark, texts, monkeypatch, percent=40):
    monkeypatch.setattr(resampling, "BLOCK", 64)
    docs, target = texts
    frame = spark.createDataFrame([(*r, "n", "w", "r", "t", 3) for r in docs], SCHEMA).repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(frame, wanted, percent=percent)
    assert Counter(tuple(r) for r in got.collect()) == plain(docs, target, percent)
    whole = resampling.drawn(frame, got)
    ids = {r["doc_id"] for r in got.filter("rank IS NOT NULL").collect()}
    assert whole.columns == frame.columns and {r["doc_id"] for r in whole.collect()} == ids


def test_long_texts_are_cut_between_words(texts, monkeypatch):
    import pyarrow as pa

    column = pa.array([t for _, t in texts[0]])
    whole = [np.concatenate([b for b, _ in resampling.buckets_of(column, 97)])]
    cut = resampling.cut_between_words
    monkeypatch.setattr(resampling, "cut_between_words", lambda at, data, inside: cut(at, data, inside, 50))
    blocks = list(resampling.buckets_of(column, 97))
    assert len(blocks) > 1000 and np.array_equal(np.concatenate([b for b, _ in blocks]), whole[0])
    assert sum(np.diff(first) for _, first in blocks).tolist() == [len(WORD.findall((t or "").lower().encode())) for _, t in texts[0]]


def test_empty_tables_and_ids_of_text(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    assert resampling.resampled(docs, some).count() == 0
    assert resampling.resampled(some, docs).collect()[0]["rank"] is None
    with pytest.raises(TypeError):
        resampling.resampled(some.withColumn("doc_id", some["doc_id"].cast("string")), docs)


@pytest.mark.parametrize("digit_bits, block", [(3, 16), (8, 1000)])
def test_radix_places(spark, digit_bits, block):
    """Keys of which one value has a third of the rows, and repeated rows."""
    rng = random.Random(digit_bits)
    rows = [(rng.choice([5, rng.randint(0, 31), rng.randint(0, 31)]), rng.randint(0, (1 << 12) - 1), k) for k in range(900)]
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "a long, b long, k long").repartition(6)
    got = resampling.radix_places(frame, [("a", 5), ("b", 12)], Scratch(spark, "radix"), digit_bits, block).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(rows)))
    assert [(r["a"], r["b"]) for r in got] == sorted(r[:2] for r in rows)
    assert Counter((r["a"], r["b"], r["k"]) for r in got) == Counter(rows)
