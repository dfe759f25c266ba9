"""Parts that need no Spark: plans, suffix arrays, fingerprints, hidden Markov recursions, bands."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from beatlake.llm import digests, hmm, jaccard, packing, quality, repeats
from beatlake.llm._shared import utf8_block, word_spans
from beatlake.llm.suffixes import common_prefixes, suffix_array

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_piece_once_without_gaps(counts):
    places, n = packing.plan(counts, 64, groups=5)
    ranks, fill = {}, {}
    for length, rank, k, first, offset in places:
        ranks.setdefault(length, []).append((rank, k))
        for j in range(k):
            fill.setdefault(first + j, []).append((offset, length))
    assert {x: sum(k for _, k in v) for x, v in ranks.items()} == counts
    for v in ranks.values():
        at = 0
        for rank, k in sorted(v):
            assert rank == at
            at += k
    assert len(fill) == n
    for v in fill.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 64


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    counts = {x: rng.randint(50, 400) for x in range(1, 1024)}
    _, n = packing.plan(counts, 1024)
    bound = max(sum(k * v for k, v in counts.items()) / 1024, sum(v for k, v in counts.items() if k > 512))
    assert n <= 1.01 * bound + 1


def test_ids_are_those_of_the_tokenizer():
    exact = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    parts = ["a", "é", " ", "  ", "\n", "'s", "12", "!", "。", "　", "b c", "\t", "\x85", " ", "\x1c", "日本", "🙂", " x", "<|endoftext|>", "the", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)] + ["", None]
    for some in (texts, [t for t in texts if t and "<|endoftext|>" not in t]):
        ids, edges = packing.block_ids(pa.array(some), PATH)
        assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [exact.encode(t or "", add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("letters", [b"ab", b"abcdef", b"a"])
@pytest.mark.parametrize("n", [0, 1, 7, 60, 400])
def test_suffix_array_and_common_prefixes(letters, n):
    rng = random.Random(n)
    body = bytes(rng.choice(letters) for _ in range(n))
    text = np.frombuffer(body, dtype=np.uint8)
    order = suffix_array(text)
    after = [tuple(body[k:]) + (256,) for k in order]  # the end is greater than any byte
    assert after == sorted(after)
    shared = common_prefixes(text, order, 20, lanes=5)
    for k in range(1, n):
        a, b = body[order[k - 1] :], body[order[k] :]
        same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == min(same, 20)


def test_merging_runs_by_binary_search():
    rng = random.Random(4)
    runs, where = [], {}
    for r in range(5):
        x = np.zeros(40, dtype=repeats._ENTRY)
        x["f"] = sorted(rng.sample(range(150), 40))
        x["g"] = x["f"] * 3
        x["region"], x["start"] = 0, r * 1000 + x["f"]
        for f in x["f"].tolist():
            where.setdefault(f, []).append(r)
        runs.append((x, bytes([r]) * 16))
    got = sorted(repeats.merged(runs))
    assert got == sorted((bytes([r]) * 16, r * 1000 + f) for f, rs in where.items() if len(rs) > 1 for r in rs)


def test_shards_of_one_anchor_find_each_others_strings():
    """A region set cut over two shards gives with merging what one shard gives alone."""
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(60))
    bodies = [bytes(rng.choice(b"xyz") for _ in range(k)) + base[: 40 + k % 9] for k in [8, 9, 10, 8, 12, 9]] + [base, base[3:]]
    parts = [{"key": bytes([k]) * 16, "anchor": 1, "copies": 1, "lo": 0, "shards": 2, "body": b} for k, b in enumerate(bodies)]
    alone = {(k, s) for k, lo, hi in repeats.shard_repeats([p | {"shards": 1} for p in parts], 30)[0] for s in range(lo, hi + 1)}
    found, slices_ = set(), {}
    for some in (parts[::2], parts[1::2]):
        spans, sent = repeats.shard_repeats(some, 30)
        found |= {(k, s) for k, lo, hi in spans for s in range(lo, hi + 1)}
        for _, cut, keys, body in sent:
            slices_.setdefault(cut, []).append((np.frombuffer(body, dtype=repeats._ENTRY), keys))
    for runs in slices_.values():
        found |= set(repeats.merged(runs))
    assert found == alone and alone


def test_suffix_array_of_words():
    rng = random.Random(9)
    text = np.array([rng.choice([7, 1 << 31, 12, 500]) for _ in range(300)] + [0xFFFFFFFF], dtype=np.uint32)
    order = suffix_array(text)
    after = [(*text[k:].tolist(), 1 << 40) for k in order]
    assert after == sorted(after)


@pytest.mark.parametrize("first, second", [(680, 2060), (5, 5)])
def test_a_group_never_joins_a_shard_that_it_would_overflow(first, second):
    rng = np.random.default_rng(1)
    rows = [{"key": bytes(16), "anchor": a, "region": k, "copies": 1, "lo": 0, "hi": 368, "shards": 1, "body": rng.integers(97, 123, 768, dtype=np.uint8).tobytes(), "salt": 0} for a, n in ((1, first), (2, second)) for k in range(n)]
    out = list(repeats._shards(repeats.BYTES)(iter([pa.RecordBatch.from_pylist(rows)])))
    assert sum(x.num_rows for x in out) == 0 and len(out) == (2 if first > 5 else 1)  # random bytes don't repeat


def test_anchors_do_not_depend_on_the_block():
    rng = np.random.default_rng(2)
    own = rng.integers(97, 100, 3000, dtype=np.uint8)
    for unit in (repeats.BYTES, repeats.Unit(51, 8, "u1")):
        alone = repeats.regions(np.array([0, len(own)]), own, unit.length, unit.gram)
        beside = np.concatenate([rng.integers(97, 123, 200_000, dtype=np.uint8), own])
        both = repeats.regions(np.array([0, 200_000, len(beside)]), beside, unit.length, unit.gram)
        assert [x[both[0] == 1].tolist() for x in both[1:]] == [x.tolist() for x in alone[1:]]


def test_words_never_cross_texts():
    texts = ["a b", None, "", "c", " d\x0be ", "f"]
    offsets, data = utf8_block(pa.array(texts))
    starts, ends, first = word_spans(offsets, data)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert [words[a:b] for a, b in zip(first, first[1:])] == [(t or "").split() for t in texts]


def test_fingerprints_tell_edits_from_others():
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(200))
    a, b = text(), text()
    edited = a[: len(a) // 2] + b[: len(a) - len(a) // 2]
    codes = digests.codes_of([a, a, edited, b, "", "ab"])
    near = digests.likeness(np.repeat(codes[:1], 6, axis=0), codes)
    assert near[0] == near[1] == 1 > near[2] > near[3] and (near >= 0).all()
    assert (digests.from_text(digests.as_text(codes)) == codes).all()
    blocks = np.concatenate([digests.codes_of([t]) for t in (a, a, edited, b, "", "ab")])
    assert (blocks == codes).all()  # neighbours in a block have no effect


def _model(states=3, own=4, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(pa.array([f"w{k}" for k in range(own)]), norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, 9))), 10, 5, np.zeros(1), np.zeros(1), pa.array([]), np.zeros(0), 1)


def test_likelihood_and_counts_match_the_plain_recursion(monkeypatch):
    monkeypatch.setattr(hmm, "STRETCH", 4)
    m, rng = _model(), np.random.default_rng(1)
    lengths = [1, 3, 4, 5, 9, 23]
    flat, edges = rng.integers(0, 9, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    want = []
    for a, b in zip(edges, edges[1:]):
        alpha = m.start * m.emit[:, flat[a]]
        for x in flat[a + 1 : b]:
            alpha = (alpha @ m.move) * m.emit[:, x]
        want.append(np.log(alpha.sum()))
    assert np.allclose(hmm.log_likelihood(flat, edges, m), want)
    monkeypatch.setattr(hmm, "STRETCH", 100)
    starts, moves, emits, log = hmm.expected_counts(flat, edges, m)
    assert np.isclose(log, sum(want)) and np.isclose(starts.sum(), len(lengths)) and np.isclose(emits.sum(), len(flat)) and np.isclose(moves.sum(), len(flat) - len(lengths))
    for stretch in (1, 4, 7):  # counts pass over the cuts of long texts
        monkeypatch.setattr(hmm, "STRETCH", stretch)
        for got, whole in zip(hmm.expected_counts(flat, edges, m), (starts, moves, emits, log)):
            assert np.allclose(got, whole)
    better = hmm.replace(m, start=starts / starts.sum(), move=moves / moves.sum(axis=1, keepdims=True), emit=emits / emits.sum(axis=1, keepdims=True))
    assert hmm.log_likelihood(flat, edges, better).sum() > sum(want)  # Baum-Welch never loses


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands()
    assert bands * rows <= jaccard.HASHES and 1 - (1 - 0.8**rows) ** bands >= jaccard.RECALL


def test_quality_tokens_do_not_depend_on_the_block():
    texts = ["Hello, WORLD!! a1 ###", "", "été | x", None, "abc"]
    ids, edges = quality.tokens(*utf8_block(pa.array(texts)))
    for k, t in enumerate(texts):
        alone, _ = quality.tokens(*utf8_block(pa.array([t], pa.string())))
        assert alone.tolist() == ids[edges[k] : edges[k + 1]].tolist()
