"""The filters' audit against a simulation of every order, document by document."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from beatlake.llm import audit

SCHEMA = "doc_id long, text string, lang string, n long, good string, Fails string, digest string, cells string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails_of(text):
    words = WORD.findall(text)
    capitals = sum("A" <= c <= "Z" for c in text)
    checks = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
    return {k for k, v in checks.items() if v}


def plain(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    rows = defaultdict(list)
    for doc_id, text, lang in docs:
        first = least.get(text or "")
        copy = first is not None and (doc_id is None or first < doc_id)
        known = doc_id is not None
        rows[lang or ""].append((fails_of(text or "") | ({"E"} if copy else set()), known and doc_id in good, known and doc_id in toxic))
    out = {}
    for part, found in rows.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = found
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(x in r[0] for r in found) - len(gone), sum(r[0] == {x} for r in found), sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[x])
    return out


def test_audit(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)] + ["ÉTÉ", "\x1c", "\xa0x"]
    docs = []
    for k in range(120):
        text = " \n".join(rng.choices(words[: rng.choice([60, 400])], k=rng.choice([50, 150, 199, 200, 201, 260])))
        text += rng.choice(["", "", " 5%", " a|b"]) + rng.choice(["", "", " " + "XYZ" * 30])
        docs.append((k, text, rng.choice(["en", "en", "de", None])))
    docs += [(200 + k, docs[k][1], "fr") for k in range(0, 60, 3)] + [(300 + k, docs[7][1], "en") for k in range(40)]
    docs += [(None, docs[8][1], "en"), (None, "only without an id " * 80, "en"), (None, "only without an id " * 80, "de"), docs[3], docs[3], (7, "another text of seven", "en")]
    docs += [(400, None, "en"), (401, "", "en"), (402, " ".join(f"w{k % 150000}" for k in range(300_000)), "en"), (403, "é" * 700_000 + " X" * 300_000, "de")]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 420, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (6, None, None)]
    frame = spark.createDataFrame([(*r, 1, "g", "f", "d", "c") for r in docs], SCHEMA).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audited(frame, marks).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got} == plain(docs, labels)
    assert len(got) == 4 * 120 * 5
    assert audit.audited(frame.limit(0), marks).count() == 0
    none = audit.audited(frame, marks.limit(0)).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert list(none) == [0, 0]


def test_weights_are_those_of_shapley():
    for m in (2, 3, 5):
        for i, row in enumerate(audit.shapley_weights(m)):
            for s, got in list(enumerate(row))[1:]:  # the empty coalition removes nothing
                size = bin(s).count("1")
                inside = s >> i & 1
                want = math.factorial(size - inside) * math.factorial(m - 1 - size + inside)
                assert got == (want if inside else -want)


def test_long_texts_are_cut_after_words():
    text = (b"word " * 300_000) + b"x" * 3_000_000 + b" #"
    assert b"".join(audit.PIECES.findall(text)) == text and len(audit.PIECES.findall(text)) > 1
    assert audit.failures(text) == 0b1010
