"""WARC archives as tables of chunks: payloads are cut into rows of (record, chunk), so that no task holds a whole record.

Writing: payloads become chunk rows that carry running digests; records with equal payloads become one response and revisits of
it; each chunk is a segment of its record (the first with the record's type, the others `continuation` records), so segments
are written in any order, by any task, through Spark's own writer. Reading: a file's lines stream through a task that cuts them
at record headers into chunk rows again; the segments of a record meet in a shuffle if it has several.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatlake.llm._shared import Scratch, join_hot, text_or_empty, trim

#: Bytes of a chunk, and of a record's header at most.
CHUNK, HEAD = 1 << 20, 1 << 16
DATE = "2000-01-01T00:00:00Z"
END = "\r\n"
CHUNKS = "record string, first boolean, last boolean, segment int, segmented boolean, chunk int, kind string, record_key string, uri string, digest string, refers string, body binary"


def chunked(rows: DataFrame, key: str, uri: str, payload: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the payloads (text or binary, null: empty): record (a number), record_key, uri, chunk, first, last and body.
    A record's chunks follow each other in one task, in order; an empty payload has one chunk."""
    body = F.coalesce(F.col(payload), F.lit(b"")) if dict(rows.dtypes)[payload] == "binary" else text_or_empty(payload).cast("binary")
    whole = rows.select(F.monotonically_increasing_id().alias("record"), F.col(key).alias("record_key"), F.col(uri).cast("string").alias("uri"), body.alias("body"))
    last = F.greatest(F.ceil(F.octet_length("body") / F.lit(chunk)), F.lit(1)) - 1
    each = whole.select("*", last.alias("n"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk"))
    return each.select("record", "record_key", "uri", "chunk", (F.col("chunk") == 0).alias("first"), (F.col("chunk") == F.col("n")).alias("last"), F.substring("body", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("body"))


def digested(chunks: DataFrame, skip: str | None = None) -> DataFrame:
    """Chunk rows, those of a record in order one after another, with n_bytes, sha1 (base32) and sha256 of the whole payload on
    each record's last row (null on the others, and on rows that the boolean column `skip` names, which are passed over). State
    between rows is two running digests and a length."""
    names = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha1 = sha256 = None
        n, record = 0, None
        for batch in batches:
            found: tuple[list, list, list] = ([], [], [])
            at = {c: batch.column(names.index(c)) for c in ("record", "first", "last", "body")}
            over = batch.column(names.index(skip)).to_pylist() if skip else [False] * batch.num_rows
            for passed, this, first, last, body in zip(over, *at.values()):
                if passed:
                    for out in found:
                        out.append(None)
                    continue
                if first.as_py():
                    if record is not None:
                        raise ValueError(f"record {record} ends early")
                    sha1, sha256, n, record = hashlib.sha1(), hashlib.sha256(), 0, this.as_py()
                elif this.as_py() != record:
                    raise ValueError(f"a chunk of record {this.as_py()} comes without its first")
                part = body.as_buffer()
                sha1.update(part)
                sha256.update(part)
                n += part.size
                done = last.as_py()
                for out, x in zip(found, (n, base64.b32encode(sha1.digest()).decode(), sha256.digest()) if done else (None, None, None)):
                    out.append(x)
                record = None if done else record
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.binary())], names=[*names, "n_bytes", "sha1", "sha256"])
        if record is not None:
            raise ValueError(f"record {record} ends early")
        trim()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{fields}, n_bytes long, sha1 string, sha256 binary")


def kinds(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """records (record, record_key, uri, n_bytes, sha1, sha256) with kind, refers and refers_uri: of records with equal payloads of at
    least `least_bytes` the one with the least key (a null key last, then by number) is a response and the others revisit it."""
    order = F.struct(F.col("record_key").isNull().alias("none"), "record_key", "record", "uri")
    groups = records.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("of"))
    known = join_hot(records, groups, "sha256", "n", records.count())
    own = (F.col("of.record") == F.col("record")) | (F.col("n_bytes") < least_bytes)
    return known.select(*records.columns, F.when(own, "response").otherwise("revisit").alias("kind"), F.when(~own, F.col("of.record")).alias("refers"), F.when(~own, F.col("of.uri")).alias("refers_uri"))


def _urn(record: Column) -> Column:
    """A record's identifier: a name made of a digest of its number."""
    h = F.md5(F.concat(F.lit("record "), record.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, nothing for null; line ends inside a value are escaped."""
    escaped = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), escaped, F.lit(END)), F.lit(""))


def segments(chunks: DataFrame, kind_of: DataFrame) -> DataFrame:
    """value (binary): a WARC record for each chunk of a response, and one without a body for each revisit, but for the line end
    that the writer adds."""
    headed = kind_of.select("record", "record_key", "uri", "kind", "refers", "refers_uri", F.col("n_bytes").alias("total"), F.col("sha1").alias("digest"))
    bodies = chunks.select("record", "chunk", "first", "last", "body").join(headed.filter("kind = 'response'"), "record")
    alone = headed.filter("kind = 'revisit'").select("record", F.lit(0).alias("chunk"), F.lit(True).alias("first"), F.lit(True).alias("last"), F.lit(b"").alias("body"), *headed.columns[1:])
    rows = bodies.unionByName(alone)
    first, whole = F.col("first"), F.col("first") & F.col("last")
    http = F.when(first, F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "), F.col("total").cast("string"), F.lit(END + END))).otherwise("")
    id_ = _urn(F.col("record"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _field("WARC-Type", F.when(first, F.col("kind")).otherwise("continuation")),
        _field("WARC-Record-ID", F.when(first, id_).otherwise(_urn(F.concat_ws(".", "record", "chunk")))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), F.col("digest")))),
        _field("X-Record-Key", F.when(first, F.col("record_key"))),
        _field("WARC-Profile", F.when(F.col("kind") == "revisit", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _field("WARC-Refers-To", F.when(F.col("kind") == "revisit", _urn(F.col("refers")))),
        _field("WARC-Refers-To-Target-URI", F.col("refers_uri")),
        _field("WARC-Segment-Number", F.when(~whole, F.col("chunk") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(~first, id_)),
        _field("WARC-Segment-Total-Length", F.when(F.col("last") & ~first, F.col("total"))),
        _field("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        _field("Content-Length", F.octet_length(http) + F.octet_length("body")),
        F.lit(END),
    )
    return rows.select(F.concat(head.cast("binary"), http.cast("binary"), F.col("body"), F.lit(END).cast("binary")).alias("value"))


def write_archives(rows: DataFrame, path: str, key: str, uri: str, payload: str, least_bytes: int = 0, chunk: int = CHUNK) -> None:
    """rows as gzipped WARC files under path, a record each.

    Null payloads are empty ones. Of equal payloads (by SHA-256) of at least `least_bytes` one is stored, that of the least key (null keys come
    last); rows that repeat a key and payload revisit it too. Null keys and URIs have no header field. Extra columns aren't read.
    An empty table gives files without records.
    """
    scratch = Scratch(rows.sparkSession, "warc")
    chunks = scratch.table(digested(chunked(rows, key, uri, payload, chunk)))
    records = scratch.table(kinds(chunks.filter("last").select("record", "record_key", "uri", "n_bytes", "sha1", "sha256"), least_bytes))
    segments(chunks, records).select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").text(path)
    scratch.drop(chunks, records)


class _Records:
    """Cuts a stream of bytes of one archive into chunk rows: the state is an open record's header and what isn't cut yet."""

    def __init__(self, chunk: int):
        self.rest, self.head, self.left, self.at, self.http, self.chunk = bytearray(), None, 0, 0, False, chunk

    def feed(self, data: bytes) -> Iterator[dict]:
        rest = self.rest
        rest += data
        while True:
            if self.head is None:
                start = next((k for k, b in enumerate(rest) if b not in b"\r\n"), len(rest))  # what ends a record
                del rest[:start]
                if (end := self._blank_line(len(rest))) is None:
                    return
                self._open(bytes(rest[:end]))
                del rest[: end + 4]
            if self.http:
                end = self._blank_line(self.left)
                if end is None and len(rest) < min(self.left, HEAD):
                    return
                if end is not None:
                    del rest[: end + 4]
                    self.left -= end + 4
                self.http = False
            take = min(self.left, self.chunk)
            if len(rest) < take:
                return
            self.left -= take
            yield {**self.head, "chunk": self.at, "first": self.head["segment"] == 1 and not self.at, "last": self.head["last"] and not self.left, "body": bytes(rest[:take])}
            del rest[:take]
            self.at += 1
            self.head = self.head if self.left else None

    def _blank_line(self, within: int) -> int | None:
        end = self.rest.find(b"\r\n\r\n", 0, min(within, HEAD))
        if end < 0 and self.head is None and len(self.rest) > HEAD:
            raise ValueError("not a WARC header")
        return None if end < 0 else end

    def _open(self, head: bytes) -> None:
        version, *lines = head.decode("utf-8", "replace").split(END)
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        if not version.startswith("WARC/") or "content-length" not in fields:
            raise ValueError(f"not a WARC header: {version[:40]!r}")
        number = fields.get("warc-segment-number")
        kind = fields.get("warc-type")
        self.left, self.at = int(fields["content-length"]), 0
        self.http = fields.get("content-type", "").startswith("application/http") and kind in ("response", "revisit")
        self.head = {
            "record": fields.get("warc-segment-origin-id") or fields.get("warc-record-id"), "segment": int(number or 1), "segmented": number is not None, "last": number is None or "warc-segment-total-length" in fields, "kind": kind,
            "record_key": fields.get("x-record-key"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"), "refers": fields.get("warc-refers-to"),
        }

    def close(self) -> None:
        if self.head is not None or bytes(self.rest).strip():
            raise ValueError(f"an archive ends inside of record {self.head and self.head['record']}")


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows (CHUNKS) of all archives under path, in their files' order. Any WARC files will do, gzipped or not.

    A file streams through one task by its lines, so memory is that of a batch and a chunk, whatever the records' lengths. Gzipped
    files come whole to a task; the parts of plain ones are first brought together again, in order.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    plain = [x for x in lines.inputFiles() if not x.endswith(".gz")]
    numbered = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary"))
    if plain:
        numbered = numbered.repartition("file").sortWithinPartitions("file", "start", "line")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, records = None, None
        kinds_ = {"first": pa.bool_(), "last": pa.bool_(), "segmented": pa.bool_(), "segment": pa.int32(), "chunk": pa.int32(), "body": pa.binary()}
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        for batch in batches:
            files, start = batch.column(0).to_numpy(), 0
            while start < batch.num_rows:
                stop = start + (int((files[start:] != files[start]).argmax()) or batch.num_rows - start)
                if file != files[start]:
                    if records is not None:
                        records.close()
                    file, records = files[start], _Records(chunk)
                found = list(records.feed(b"\n".join(batch.column(1).slice(start, stop - start).to_pylist()) + b"\n"))
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], kinds_.get(n, pa.string())) for n in names], names=names)
                start = stop
        if records is not None:
            records.close()
        trim()

    return numbered.select("file", "value").mapInArrow(cut, CHUNKS)


def read_records(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """The responses and revisits of all archives under path: record, record_key (text), uri, kind, payload_bytes and payload_digest
    (base32 SHA-1) of the payload as it is read, intact (it has the header's digest), and of revisits refers_to, the key of what they
    revisit, and that record's payload_bytes and payload_digest (null if it isn't in the archives, or not named)."""
    scratch = Scratch(spark, "warc-read")
    seen = digested(read_chunks(spark, path, chunk), skip="segmented").filter("segmented OR last")
    seen = scratch.table(seen.withColumn("body", F.when(F.col("segmented"), F.col("body"))))  # bodies of segmented records alone
    parts = seen.filter("segmented").drop("n_bytes", "sha1", "sha256").repartition("record").sortWithinPartitions("record", "segment", "chunk")
    of_first = [F.max(F.when(F.col("first"), F.col(c))).alias(c) for c in ("kind", "record_key", "uri", "digest", "refers")]
    joined = digested(parts).drop("body").groupBy("record").agg(*of_first, F.max("n_bytes").alias("n_bytes"), F.max("sha1").alias("sha1"))
    columns = ["record", "kind", "record_key", "uri", "digest", "refers", "n_bytes", "sha1"]
    found = scratch.table(seen.filter("NOT segmented").select(columns).unionByName(joined.select(columns)).filter("kind IN ('response', 'revisit')"))
    bare = F.regexp_replace("digest", "^sha1:", "")
    responses = found.filter("kind = 'response'").withColumns({"refers_to": F.lit(None).cast("string"), "payload_bytes": F.col("n_bytes"), "payload_digest": F.col("sha1"), "intact": F.coalesce(bare == F.col("sha1"), F.lit(True))})
    revisits = found.filter("kind = 'revisit'").drop("n_bytes", "sha1")
    named = revisits.groupBy("refers").agg(F.count(F.lit(1)).alias("n"))
    known = responses.select(F.col("record").alias("refers"), F.col("record_key").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers"])
    resolved = join_hot(revisits, named.join(known, "refers", "left"), "refers", "n", revisits.count())
    nameless = revisits.filter("refers IS NULL").withColumns({"refers_to": F.lit(None).cast("string"), "payload_bytes": F.lit(None).cast("long"), "payload_digest": F.lit(None).cast("string")})
    resolved = resolved.unionByName(nameless).withColumn("intact", bare.eqNullSafe(F.col("payload_digest")))
    out = ["record", "record_key", "uri", "kind", "payload_bytes", "payload_digest", "refers_to", "intact"]
    return responses.select(out).unionByName(resolved.select(out))


#: Base 32 by SQL: five hexadecimal digits are four of its letters.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST))
SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS INT) >> (15 - 5 * (k % 4))::INT) % 32, 1) for k in range(32)], '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM r"""
