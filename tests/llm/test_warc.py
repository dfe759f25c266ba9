"""WARC archives: exact round trips of payloads in chunks, and archives that others have written."""

import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest

from beatlake.llm import warc
from beatlake.llm._shared import Scratch

SCHEMA = "page_id long, url string, html binary, record string, body string, Chunk int, kind string, n long"


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(11)
    own = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 99, 100, 101, 5000, 300, 777)]
    tricky = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n\n\n\r\nWARC/1.1\r\n" * 9
    rows = [(k, f"http://a/{k}", b) for k, b in enumerate([*own, tricky, b"\r\n\r\n" * 60, b"\n", "é€".encode() * 90])]
    rows += [(50 + k, "http://b/\r\nX-Injected: 1", own[4]) for k in range(30)] + [(None, None, own[4]), (None, "u", b"none has an id"), (None, "u", b"none has an id")]
    rows += [(90, "u", None), (89, "u", b""), (91, "u", b""), (7, "again", tricky), (7, "again", tricky), (-5, "u", own[3])]
    return [(*r, "r", "b", 1, "k", 2) for r in rows]


def wanted(rows, least_bytes=0):
    out, groups = Counter(), {}
    for r in rows:
        groups.setdefault(r[2] or b"", []).append(r[0])
    for body, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        for k, page in enumerate(ids):
            again = k > 0 and len(body) >= least_bytes
            out[page, len(body), sha1(body), "revisit" if again else "response", ids[0] if again else None] += 1
    return out


@pytest.mark.parametrize("chunk, least_bytes", [(100, 0), (1 << 20, 101)])
def test_round_trip(spark, pages, chunk, least_bytes):
    frame = spark.createDataFrame(pages, SCHEMA).repartition(3)
    path = Scratch(spark, "archives").root + "/a"
    warc.write_archives(frame, path, "page_id", "url", "html", least_bytes, chunk)
    got = warc.read_records(spark, path, chunk).collect()
    number = lambda x: None if x is None else int(x)
    assert Counter((number(r["record_key"]), r["payload_bytes"], r["payload_digest"], r["kind"], number(r["refers_to"])) for r in got) == wanted(pages, least_bytes)
    assert all(r["intact"] for r in got) and len({r["record"] for r in got}) == len(pages)
    # The chunks of a record, in order, are its payload.
    rows = warc.read_chunks(spark, path, chunk).filter("kind = 'response' OR segment > 1").collect()
    bodies = {}
    for r in sorted(rows, key=lambda r: (r["record"], r["segment"], r["chunk"])):
        assert len(r["body"]) <= chunk
        bodies[r["record"]] = bodies.get(r["record"], b"") + bytes(r["body"])
    assert set(bodies.values()) == {r[2] or b"" for r in pages}
    if chunk == 100:
        assert max(r["segment"] for r in rows) == 50


def test_hot_payloads_stay_where_they_are(spark, pages, monkeypatch):
    """With a bound of no rows, every group goes the way of the large ones."""
    from beatlake.llm import _shared

    monkeypatch.setattr(_shared, "max", lambda *_: 0, raising=False)
    path = Scratch(spark, "archives").root + "/a"
    warc.write_archives(spark.createDataFrame(pages, SCHEMA), path, "page_id", "url", "html")
    got = warc.read_records(spark, path).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in got} == Counter(k[3] for k in wanted(pages).elements())


def test_texts_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "u", "<p>é\n</p>"), (2, "u", None)], "page_id int, url string, html string")
    for rows in (frame, frame.limit(0)):
        path = Scratch(spark, "archives").root + "/a"
        warc.write_archives(rows, path, "page_id", "url", "html")
        got = {(r["record_key"], r["payload_digest"]) for r in warc.read_records(spark, path).collect()}
        assert got == ({("1", sha1("<p>é\n</p>".encode())), ("2", sha1(b""))} if rows is frame else set())


def foreign(rng):
    """Records as others write them: no segments, other kinds between, a long payload, a last line end missing."""
    bodies = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 10, 70_000, 300)] + [b"line\n" * 30_000]
    out = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 7\r\n\r\nabc\r\nde\r\n\r\n"
    for k, b in enumerate(bodies):
        http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
        out += b"WARC/1.0\r\ncontent-length: %d\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nContent-Type: application/http;msgtype=response\r\n\r\n" % (len(http) + len(b), k) + http + b + b"\r\n\r\n"
    out += b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <v1>\r\nWARC-Refers-To: <r1>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    out += b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <v2>\r\nWARC-Refers-To: <elsewhere>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    return bodies, out + b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <v3>\r\nContent-Length: 0\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_others(spark, tmp_path, packed):
    bodies, data = foreign(random.Random(2))
    (tmp_path / ("a.warc.gz" if packed else "a.warc")).write_bytes(gzip.compress(data[:900]) + gzip.compress(data[900:]) if packed else data)
    (tmp_path / "b.warc").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a plain file comes in many parts
    try:
        got = {r["record"]: r for r in warc.read_records(spark, str(tmp_path), 1000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert set(got) == {f"<r{k}>" for k in range(5)} | {"<v1>", "<v2>", "<v3>"}
    for k, b in enumerate(bodies):
        assert (got[f"<r{k}>"]["payload_bytes"], got[f"<r{k}>"]["payload_digest"]) == (len(b), sha1(b))
    assert got["<v1>"]["payload_bytes"] == 10 and got["<v2>"]["payload_bytes"] is None and got["<v3>"]["payload_bytes"] is None


def test_broken_archives_are_told(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(foreign(random.Random(2))[1][:50_000])
    with pytest.raises(Exception, match="ends inside of record <r2>"):
        warc.read_records(spark, str(tmp_path)).collect()
