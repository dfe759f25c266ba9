"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns; and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from beatlake.llm import ann, chat, digests, hmm, jaccard, licenses, mixing, packing, quality, repeats
from beatlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, mix string, repeats string, digest string, Fingerprint string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    shared = words(rng, 90)
    out = [(k, words(rng, rng.randint(1, 150)), "en", f"s{k % 3}") for k in range(40)]
    near = out[5][1].split() + words(rng, 120).split()
    out[5] = (5, " ".join(near), "en", "s2")
    out.append((40, " ".join(near[:60] + ["edited"] + near[61:]), "en", None))
    out += [(41, out[6][1], "en", "s0"), (42, None, None, None), (43, "", "", ""), (44, "é" * 3, "fr", "s1"), (None, "no id here", "en", "s1"), (5, out[5][1], "en", "s2")]
    out += [(50 + k, words(rng, 5) + " " + shared + " " + words(rng, 5 + k), "en", "s1") for k in range(4)]
    out.append((60, words(rng, 20_000), "en", "s0"))
    out.append((61, "ab " * 700, "en", "s2"))
    return [(*r, len(r[1] or ""), 0.5, "big", "m", "r", "d", "f") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, rows, empty):
    got = digests.edited_fingerprints(docs).collect()
    # Descending ids, null last, ties by Spark's hash of the text (equal here, so the order of the two rows is no matter).
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    want = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        want.append((str(r[0]), len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    by = defaultdict(set)
    for r, s in ((r, r["fingerprint"]) for r in got):
        by[next(x[1] or "" for x in rows if x[0] == r["doc_id"])].add(s)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by.values())
    assert digests.edited_fingerprints(empty).count() == 0
    assert digests.fingerprints(docs).count() == len(rows)


def test_fingerprints_of_an_id_that_most_rows_share(spark):
    """Rows that share an id, or have none, are dealt to many ranges and still follow each other in the order of their hashes."""
    from pyspark.sql import functions as F

    texts = [(None if k % 2 else 7, f"text number {k} " * (1 + k % 3)) for k in range(400)] + [(k, f"own {k}") for k in range(20)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    buckets = digests.with_next(frame).groupBy("_bucket").count().collect()
    assert len(buckets) > 8 and max(r["count"] for r in buckets) < 120
    order = [r["text"] for r in frame.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(order, order[1:] + order[:1]))
    assert sorted(r["edited_sha256"] for r in digests.edited_fingerprints(frame).collect()) == want


def test_mixing(spark, docs, rows, empty):
    sized = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    got = [r.asDict(recursive=True) for r in mixing.mixed(sized).collect()]
    again = [r.asDict(recursive=True) for r in mixing.mixed(sized.repartition(7)).collect()]
    key = lambda r: repr(sorted(r.items(), key=str))
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    totals = Counter()
    for r in rows:
        totals[r[3]] += len(WORDS.findall(r[1] or ""))
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest, heavy = sum(totals.values()) - sum(3 * totals[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * totals[s] if s in full else rest * weight[s] / heavy for s in order}
        more = {s for s in order if s not in full and target[s] > 3 * totals[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in got:
        assert r["mix"]["source_size"] == totals[r["source"]] and r["mix"]["target"] == pytest.approx(target[r["source"]])
        assert r["mix"]["taken"] == r["mix"]["copies"] * r["size"] and 0 <= r["mix"]["copies"] <= 3
        taken[r["source"]] += r["mix"]["taken"]
    for s in order:
        largest = max(len(WORDS.findall(r[1] or "")) for r in rows if r[3] == s)
        assert abs(taken[s] - target[s]) <= largest + 1
    assert mixing.mixed(empty.select("doc_id", "source", mixing.word_count().alias("size"))).count() == 0


def test_mixing_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    sized = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE concat('b', id % 5) END AS source", "id % 97 + 1 AS size")
    got = mixing.mixed(sized).groupBy("source").agg({"mix.taken": "sum", "mix.target": "max", "mix.copies": "count"}).collect()
    for r in got:
        assert abs(r["sum(mix.taken AS taken)"] - r["max(mix.target AS target)"]) < 0.02 * r["max(mix.target AS target)"]
    assert sum(r["count(mix.copies AS copies)"] for r in got) == 3000


def test_packing(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    placed = packing.pack_documents(docs, path, max_length=64)
    got = [r.asDict() for r in placed.collect()]
    want = Counter()
    for r in rows:
        ids = exact.encode(r[1] or "", add_special_tokens=False).ids + [2]
        at, size = 0, len(ids) % 64 or 64
        piece = 0
        while at < len(ids):
            want[(r[0], piece, at, size, np.array(ids[at : at + size], dtype="<u4").tobytes())] += 1
            at, size, piece = at + size, 64, piece + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    fill = defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in fill.values():
        v.sort()
        assert [o for o, _ in v] == [sum(x for _, x in v[:k]) for k in range(len(v))] and sum(x for _, x in v) <= 64
    whole = packing.sequences(placed).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == sum(r["length"] for r in got) and len(whole) == len(fill)
    assert packing.pack_documents(empty, path).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_repeats(spark, docs, rows, empty, monkeypatch, hot):
    if hot:  # the anchors' regions are cut over several shards and merged
        monkeypatch.setattr(repeats, "SHARD", 1500)
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    want = Counter()
    for doc_id, b in data:
        mark = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                mark[k : k + 400] = True
        runs = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        want[(doc_id, len(b), int(mark.sum()), runs, np.frombuffer(b, np.uint8)[~mark].tobytes())] += 1
    out = repeats.without_repeats(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    name = out.columns[-1]
    got = Counter((r["doc_id"], r[name]["n_bytes"], r[name]["n_removed"], r[name]["n_spans"], bytes(r[name]["kept"])) for r in out.collect())
    assert got == want and any(k[2] for k in want)
    assert repeats.without_repeats(empty).count() == 0


def without_passages(texts, n=51):
    """Plain version: (text left, words removed) of each text."""
    spans = [[m.span() for m in WORDS.finditer(t)] for t in texts]
    tokens = [[t[a:b] for a, b in s] for t, s in zip(texts, spans)]
    seen = Counter(tuple(w[k : k + n]) for w in tokens for k in range(len(w) - n + 1))
    out = []
    for t, s, w in zip(texts, spans, tokens):
        mark = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                mark[k : k + n] = [True] * n
        gone, k = [False] * len(t), 0
        while k < len(w):
            if mark[k]:
                first = k
                while k < len(w) and mark[k]:
                    k += 1
                gone[s[first][0] : s[k - 1][1]] = [True] * (s[k - 1][1] - s[first][0])
            k += 1
        out.append(("".join(c for c, x in zip(t, gone) if not x), sum(mark)))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_passages(spark, docs, rows, empty, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(repeats, "SHARD", 150)
    want = Counter((r[0], *x) for r, x in zip(rows, without_passages([r[1] or "" for r in rows])))
    out = repeats.without_passages(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    name = out.columns[-1]
    assert Counter((r["doc_id"], r[name]["kept"], r[name]["n_removed"]) for r in out.collect()) == want and any(k[2] for k in want)
    assert repeats.without_passages(empty).count() == 0


def test_helper_columns_do_not_clash(spark):
    """Columns named as operators might name their own stay as they are."""
    names = ("key", "_key", "spans", "bytes", "_bytes", "body", "_digest", "_known", "_license", "_p", "_share", "_dice", "_block", "_copy", "_place", "_source", "_row", "documents", "_text", "score")
    data = [(k, "some words here " * (k + 1), "s", 3 * (k + 1), *names) for k in range(4)]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string, size long, " + ", ".join(f"`{n}` string" for n in names))
    model = quality.fitted(frame, spark.createDataFrame([], "doc_id long, quality int"))
    for out in (repeats.without_repeats(frame), repeats.without_passages(frame), licenses.scanned(frame), mixing.mixed(frame), quality.scored(frame, model), quality.good_only(frame, model, 0.0)):
        assert out.columns[: len(frame.columns)] == frame.columns
        assert sorted(tuple(r)[: len(frame.columns)] for r in out.collect()) == data


def test_quality_of_ids_that_are_texts_and_repeat(spark):
    data = [(f"d{k}", ("good words here " if k % 2 else "### $$$ !!! ") * 8) for k in range(80)]
    frame = spark.createDataFrame(data * 3, "doc_id string, text string")
    marks = spark.createDataFrame([(f"d{k}", k % 2) for k in range(80)], "doc_id string, quality int")
    got = quality.scored(frame, quality.fitted(frame, marks)).collect()
    assert len(got) == 240 and all((r["score"] >= 0.7) == (int(r["doc_id"][1:]) % 2 == 1) for r in got)


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # Texts without words: near duplicates and repeats keep them, a mix takes no words of them, and each is one packed piece.
    want = {"near duplicates": 2, "repeats": 2, "mix": 0, "packing": 2}
    for rows_ in ([], [(1, None, None, None, None), (None, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows_, schema)
        for name, stage in corpus_pipeline.STAGES[1:]:
            got = stage(spark, docs, str(tmp_path)).collect()
            assert len(got) == (want[name] if rows_ else 0), name
        assert corpus_pipeline.keep_good(spark, docs, str(tmp_path)).count() == 0  # a score of 1/2 isn't good


def test_one_of_each_class_by_row(spark):
    """Rows without an id, an unlike text under an id whose other row goes, and columns with names that helpers could take."""
    rng = random.Random(5)
    text, other = words(rng, 90), words(rng, 80)
    near = text.split()
    near[40] = "edited"
    rows_ = [(3, text), (2, " ".join(near)), (2, other), (None, text), (None, " ".join(near)), (None, ""), (7, None), (2, " ".join(near)), (9, words(rng, 70)), (None, "only here " + words(rng, 30))]
    frame = spark.createDataFrame([(*r, k, 1, 2) for k, r in enumerate(rows_)], "doc_id long, text string, _n int, _row int, _dropped int").repartition(3)
    got = jaccard.one_of_each(frame)
    assert got.columns == frame.columns
    kept = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect()))
    want = sorted((d is None, d or 0, t or "") for d, t in [(2, " ".join(near)), (2, other), (None, ""), (7, None), rows_[8], rows_[9]])
    assert kept == want


def test_ids_of_text_are_told(spark):
    with pytest.raises(TypeError, match="integral"):
        digests.edited_fingerprints(spark.createDataFrame([("a", "x"), ("b", "y")], "doc_id string, text string"))


def grams(text):
    w = WORDS.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def classes(rows, least=0.8):
    sets = [(r[0], grams(r[1])) for r in rows]
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and len(a & b) / len(a | b) >= least:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(k)
    return Counter((sets[k][0], min((sets[j][0] for j in g if sets[j][0] is not None), default=None)) for g in groups.values() for k in g)


def test_near_duplicates(spark, docs, rows, empty):
    got = jaccard.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == classes(rows)
    assert jaccard.near_duplicates(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(c if d is not None else None) for d, c in classes(rows)})


@pytest.mark.parametrize("most", [2048, 16])
def test_near_duplicates_in_chains(spark, monkeypatch, most):
    """Many chained variants: likeness falls with distance, so classes grow over rounds; also with buckets cut in parts."""
    monkeypatch.setattr(jaccard, "MOST", most)
    rng = random.Random(9)
    base = words(rng, 160).split()
    rows = []
    for k in range(60):
        base = base[:]
        at = rng.randrange(len(base))
        base[at] = words(rng, 1)
        rows.append((k, " ".join(base)))
    rows += [(100 + k, words(rng, 40)) for k in range(20)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == classes(rows)


def test_near_duplicates_of_a_large_bucket_all_meet(spark, monkeypatch):
    """100 texts, each linked with one hub alone and only by grams that all share: every bucket in which they meet has many parts."""
    monkeypatch.setattr(jaccard, "MOST", 2)
    rng = random.Random(13)
    shared = words(rng, 204)
    rows = [(0, shared + " " + words(rng, 2)), *((k, shared + " " + words(rng, 40)) for k in range(1, 101))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == classes(rows) == Counter((k, 0) for k in range(101))


@pytest.mark.parametrize("most", [2048, 8])
def test_near_duplicates_count_all_links(spark, monkeypatch, most):
    """n_links of a group of many different texts, of a pair with a copy, and of lone texts, against all pairs."""
    monkeypatch.setattr(jaccard, "MOST", most)
    rng = random.Random(17)
    shared, pair = words(rng, 200), words(rng, 100)
    rows = [(k, shared + " " + words(rng, 1 + k % 20)) for k in range(60)]
    rows += [(100, pair), (101, pair), (102, pair + " edited"), (103, words(rng, 30)), (104, "")]
    sets = {frozenset(grams(x)) for _, x in rows if x}
    want = Counter((k, sum(len(a & b) / len(a | b) >= 0.8 for a in [frozenset(grams(x))] for b in sets if a != b)) for k, x in rows)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_links"]) for r in got) == want
    assert want[(0, 59)] == 1 and want[(100, 1)] == want[(103, 0)] == want[(104, 0)] == 1


def test_language_model(spark, docs, rows, empty):
    got = hmm.scored(docs, states=3, iterations=2).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update([*WORDS.findall((r[1] or "").translate(low)), " "])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        w = [*WORDS.findall((r[1] or "").translate(low)), " "]
        want[(r[0], held(r[0]), len(w), sum(count[x] > 0 for x in w), n, round(sum(np.log10((count[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert hmm.scored(empty).count() == 0


def test_quality(spark, docs, rows, empty):
    rng = random.Random(11)
    data, labels = [], []
    for k in range(600):
        good = k % 3 > 0
        text = words(rng, 60)
        data.append((k, text if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text.upper().split())))
        labels.append((k, int(good)))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (7, 1)], "doc_id long, quality int")
    model = quality.fitted(frame, marks)
    got = {r["doc_id"]: r["score"] for r in quality.scored(frame, model, keep=["doc_id"]).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] >= quality.THRESHOLD) == labels[k][1] for k in held) > 0.97 * len(held)
    out = quality.scored(docs, model)
    assert out.columns[:-1] == docs.columns and out.count() == len(rows)
    assert all(0 <= r[-1] <= 1 for r in out.collect())
    kept = quality.good_only(docs, model, 0.5)
    assert kept.columns == docs.columns
    none = quality.fitted(empty, marks.limit(0))
    assert quality.scored(empty, none).count() == 0 and none.constant == 0.5


def test_neighbours(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    x[100:400] = x[40]  # many equal vectors
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8), (5080, [1.0]), (5100, [float("inf")] * 16), (None, [1.0] * 16), (20, rows[20][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.neighbours(frame).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit, ids = 0, np.arange(3000)
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -np.round(s, 9)))[:20]
        assert [r for r, _, _ in got[q]] == list(range(1, 21)) and all(abs(s[v] - score) < 1e-9 for _, v, score in got[q])
        assert [v for _, v, _ in got[q]] == [v for _, v, _ in sorted(got[q], key=lambda r: (-r[2], r[1]))]
        hit += len(set(want.tolist()) & {v for _, v, _ in got[q]})
    assert len(got) == 150 and hit >= 0.95 * 150 * 20
    few = ann.neighbours(frame.filter("vec_id in (0, 1, 2, 20)")).collect()
    assert Counter(r["query_id"] for r in few) == {0: 3, 20: 3}
    assert ann.neighbours(frame.limit(0)).count() == 0


def test_the_list_of_candidates_grows_where_codes_tell_less():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    small, large = ann.fitted(x, 16, of=4000), ann.fitted(x, 16, of=4_000_000)
    assert small.short >= ann.SHORT and large.short > 4 * small.short
    scores, codes = x[:200] @ x.T, small.approximate(x[:200], x)
    for scored in (scores, codes):
        scored[np.arange(200), np.arange(200)] = -np.inf
    held = [len(set(np.argsort(-a)[:20]) & set(np.argsort(-b)[: small.short])) / 20 for a, b in zip(scores, codes)]
    assert np.mean(held) > 0.97


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "", "x"), (2, 0, None, "x"), (3, 0, "system", "alone"), (None, None, "zoe", "é"), (None, 5, "ann", "")]
    rows += [(9, k, f"p{k % 3}", "t" * (k % 7)) for k in range(1500)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.perspectives(frame)
    cols = got.columns
    conversations = pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], dtype="Int64"), "turn": pd.array([r[1] for r in rows], dtype="Int64"), "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    con = duckdb.connect()
    con.register("conversations", conversations)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({chat.PERSPECTIVES_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want)
    view = sorted((r["start"], r["segment"]) for r in got.filter("conv_id = 1 and perspective = 'bob'").collect())
    assert "".join(s for _, s in view) == "<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi<|end|>\n<|assistant|>\n<|end|>\n<|user name=ann|>\nbye<|end|>\n"
    assert chat.perspectives(frame.limit(0)).count() == 0


def known_texts():
    """Whole licence texts, where the system has them."""
    from pathlib import Path

    at = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [(name, Path("/usr/share/common-licenses") / file) for name, file in at.items()]
    return [(name, file.read_text(encoding="utf-8")) for name, file in found if file.exists()] or [("MIT", "Released under the MIT License.")]


def test_licenses(spark, docs, rows, empty):
    mit = next(t for name, t in licenses.KNOWN if name == "MIT")
    texts = [(1, "MIT Licence\n\nCopyright (c) 2020 Somebody\n(c) 2021 Another\nAll rights reserved.\n\n" + mit.replace(". ", ".\n\n* ").upper()), (2, mit + " more"), (3, None), (4, ""), (5, "released under the mit licence"), (5, "released under the mit licence")]
    got = licenses.scanned(spark.createDataFrame(texts, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["license_id"]) for r in got.collect()) == {(1, "MIT"): 1, (2, None): 1, (3, None): 1, (4, None): 1, (5, "MIT"): 2}
    long = [(name, text) for name, text in licenses.KNOWN if name in ("GPL-3.0", "Unlicense", "MPL-2.0", "Apache-2.0")]
    found = licenses.scanned(spark.createDataFrame([(k, "Copyright 2024 Somebody\n\n  " + text) for k, (_, text) in enumerate(long)], "doc_id long, text string"))
    assert {r["doc_id"]: r["license_id"] for r in found.collect()} == {k: name for k, (name, _) in enumerate(long)}
    whole = known_texts()
    found = licenses.scanned(spark.createDataFrame([(k, text) for k, (_, text) in enumerate(whole)], "doc_id long, text string"))
    assert {r["doc_id"]: r["license_id"] for r in found.collect()} == {k: name for k, (name, _) in enumerate(whole)}
    out = licenses.scanned(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == len(rows) and licenses.scanned(empty).count() == 0
    assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "Arrow" not in plan


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    """Each stage against a plain version of its own input."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "near duplicates":
            want = classes([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({c for _, c in want})
        if name == "repeats":
            data = {r["doc_id"]: r["text"] or "" for r in before.collect()}
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            for (doc_id, text), (left, removed) in zip(data.items(), without_passages(list(data.values()))):
                assert got.get(doc_id) == (None if removed and removed == len(WORDS.findall(text)) else left)
    assert counts[1] > 0.6 * counts[0]
    assert set(QUERIES) >= {"pipeline"}
