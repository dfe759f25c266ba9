"""Suffix-array dedup: what is covered by a string of a fixed length that starts anywhere else too, over all documents.

Strings are of bytes (400 of them), or of words (51): then a word is a symbol, known by 32 bits of its hash. Lengths, places
and spans are in symbols.

Every string has an anchor, the gram in it whose hash is least (the leftmost of equals); equal
strings have equal anchors at equal places. A document's starts fall into runs with one anchor; the text of such a run (from
its first start to the end of its last string) is a region. So

1. each document gives its regions as rows (anchor, region hash, place), about two for a string's length;
2. regions that occur twice as a whole are repeated throughout: no text is looked at;
3. anchors that occur once have no repeated string: dropped;
4. what is left, anchors with different regions, goes to shards by anchor with one copy of each region's text. A shard's
   suffix array (Larsson-Sadakane) and common prefixes (Kasai) tell the starts whose string occurs again in the shard;
5. an anchor with many different regions is cut over several shards. These send the hashes of their distinct strings, sorted
   and cut at fixed values, to one merger for each cut, which finds strings of other shards by binary search.

Region and string hashes have 64 and 128 bits. Defined results: null is the empty text; texts shorter than a string lose
nothing; repeated rows are copies of each other; bytes are UTF-8 and their spans may cut characters; an empty table gives an
empty result; columns other than the id and the text are kept under their own names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm._shared import Scratch, free_name, mix64, slices, text_or_empty, trim, utf8_block, word_spans
from beatlake.llm.suffixes import common_prefixes, separator, suffix_array

#: Bytes of a repeated string, and of the gram that anchors it.
LENGTH, GRAM = 400, 32
#: Symbols that a shard takes before it is sorted, and bytes of text that a task works on at a time.
SHARD, BLOCK = 1 << 19, 1 << 19
#: Places of one region that a row holds; more of them in a block are several rows, so that rows can be dealt evenly.
PLACES = 16
#: Bits of a place in a block; a gram's hash keeps the others, whatever the block's size, so equal strings choose equal anchors.
PLACE = np.uint64(31)


@dataclass(frozen=True)
class Unit:
    """What strings are made of: `length` symbols of `kind`, anchored by grams of `gram` symbols."""

    length: int = LENGTH
    gram: int = GRAM
    kind: str = "u1"

    def coded(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each document's symbols begin (documents + 1), and the symbols of a block."""
        if self.kind == "u1":
            return offsets, data
        starts, ends, first = word_spans(offsets, data)
        if not len(starts):
            return first, np.zeros(0, np.uint32)
        return first, (stretch_hash(prefix_sums(data), starts, ends) % np.uint64(0xFFFFFFFF)).astype(np.uint32)  # one value is the separator's


BYTES, PASSAGES = Unit(), Unit(51, 8, "<u4")

_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_BYTES = mix64(np.arange(512, dtype=np.uint64) + np.uint64(9)).reshape(2, 256)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, at least n of each; kept per process."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_STEP, _BACK):
            x = np.full(max(n, BLOCK + 2), base, dtype=np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            made.append(x)
        _powers[:] = made
    return _powers


def prefix_sums(data: np.ndarray, table: int = 0) -> np.ndarray:
    """Sums from which the hash of any stretch of data can be read."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    value = _BYTES[table][data] if data.dtype == np.uint8 else mix64(data.astype(np.uint64) + _BYTES[table][0])
    value *= powers(len(data) + 1)[0][: len(data)]
    np.cumsum(value, out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from start to end."""
    return mix64((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def regions(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """By symbols: document, anchor hash, region hash, first and last start (in the document) of all regions of a block."""
    n, grams = len(data), len(data) - gram + 1
    sizes = np.diff(offsets)
    if n < length or not (sizes >= length).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    sums = prefix_sums(data)
    back = powers(n + 1)[1]
    hashes = (sums[gram:] - sums[:grams]) * back[:grams]
    hashes = mix64(hashes)
    least = (hashes >> PLACE << PLACE) | np.arange(grams, dtype=np.uint64)
    window, wide = length - gram + 1, 1
    while wide * 2 <= window:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if window > wide:
        least = np.minimum(least[: len(least) - (window - wide)], least[window - wide :])
    anchor = (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)  # of the string that starts here
    good = np.zeros(n + 1, dtype=np.int8)
    long_ = sizes >= length
    good[offsets[:-1][long_]] += 1
    good[offsets[1:][long_] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(good[: len(anchor)]))
    own = anchor[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi, at = starts[first], starts[np.append(first[1:], len(starts)) - 1], own[first]
    doc = np.searchsorted(offsets, lo, side="right") - 1
    whole = stretch_hash(sums, lo, hi + length) ^ mix64((at - lo).astype(np.uint64))
    return doc, hashes[at], whole, lo - offsets[doc], hi - offsets[doc]


def text_key(column: str = "text"):
    """128 bits of the text's SHA-256: its identity in the joins here."""
    return F.substring(F.unhex(F.sha2(text_or_empty(column), 256)), 1, 16)


def _rows(column_type: str, unit: Unit):
    """A row for each region of a block of texts, with all its places there: what many texts share is gathered before it is
    shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            doc, anchor, whole, lo, hi = regions(*unit.coded(*utf8_block(batch.column(2))), unit.length, unit.gram)
            order = np.lexsort((doc, whole, anchor))
            doc, anchor, whole, lo, hi = (x[order] for x in (doc, anchor, whole, lo, hi))
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
            group = np.flatnonzero(new)
            within = np.arange(len(doc)) - np.repeat(group, np.diff(np.append(group, len(doc))))
            first, take = np.flatnonzero(within % PLACES == 0), pa.array(doc)
            places = pa.StructArray.from_arrays([batch.column(0).take(take), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), batch.column(1).take(take)], names=["key", "lo", "hi", "doc_id"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), places)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(whole[first].view(np.int64)), lists], names=["anchor", "region", "places"])
        trim()

    return rows, f"anchor long, region long, places array<struct<key: binary, lo: int, hi: int, doc_id: {column_type}>>"


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of True."""
    edge = np.diff(np.concatenate([[0], marked.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_ENTRY = np.dtype([("f", "<u8"), ("g", "<u8"), ("region", "<u4"), ("start", "<u4")])
_NOBODY = 0xFFFFFFFF
_OUT = "key binary, lo int, hi int, anchor long, slice int, keys binary, body binary"


def _batch(spans: list[tuple], sent: list[tuple]) -> pa.RecordBatch:
    rows = [(*x, None, None, None, None) for x in spans] + [(None, None, None, *x) for x in sent]
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["key", "lo", "hi", "anchor", "slice", "keys", "body"])


def shard_repeats(parts: list[dict], length: int = LENGTH, kind: str = "u1") -> tuple[list[tuple], list[tuple]]:
    """Repeated starts of one shard as (key, lo, hi), and for the anchors that other shards have too, sorted hashes of the
    distinct strings as (anchor, slice, keys, body). parts: key, anchor, copies, lo, shards, body (the region's symbols)."""
    bodies = [np.frombuffer(p["body"], kind) for p in parts]
    edges = np.concatenate([[0], np.cumsum([len(x) + 1 for x in bodies])])
    text = np.full(edges[-1], separator(np.dtype(kind)), dtype=kind)
    real = np.zeros(len(text), dtype=bool)
    for x, at in zip(bodies, edges):
        text[at : at + len(x)] = x
        real[at : at + len(x) - length + 1] = True
    order = suffix_array(text)
    shared = common_prefixes(text, order, length)
    with_next = np.append(shared[1:] >= length, False)
    again = np.zeros(len(text), dtype=bool)
    again[order] = (shared >= length) | with_next
    again &= real
    spans = []
    for p, x, at in zip(parts, bodies, edges):
        if p["copies"] == 1:
            first, last = _runs(again[at : at + len(x)])
            spans += [(p["key"], int(p["lo"] + a), int(p["lo"] + b)) for a, b in zip(first, last)]
    sent: list[tuple] = []
    split: dict[int, list[int]] = {}
    for k, p in enumerate(parts):
        if p["shards"] > 1:
            split.setdefault(p["anchor"], []).append(k)
    if split:
        leads = np.zeros(len(text), dtype=bool)  # the first of each class of equal strings stands for it
        leads[order] = shared < length
        f, g = prefix_sums(text), prefix_sums(text, 1)
        for anchor, own in split.items():
            found = []
            for number, k in enumerate(own):
                at, p = edges[k], parts[k]
                to = at + len(bodies[k])
                starts = at + np.flatnonzero(leads[at:to] & real[at:to])
                x = np.empty(len(starts), dtype=_ENTRY)
                x["f"], x["g"] = stretch_hash(f, starts, starts + length), stretch_hash(g, starts, starts + length)
                x["region"] = np.where(again[starts] | (p["copies"] > 1), _NOBODY, number)
                x["start"] = starts - at + p["lo"]
                found.append(x)
            all_ = np.concatenate(found)
            all_.sort(order=("f", "g"))
            n = parts[own[0]]["shards"]
            cuts = np.searchsorted(all_["f"], np.array([(k << 64) // n for k in range(1, n)], dtype=np.uint64))
            keys = b"".join(parts[k]["key"] for k in own)
            sent += [(anchor, k, keys, x.tobytes()) for k, x in enumerate(np.split(all_, cuts)) if len(x)]
    return spans, sent


def _shards(unit: Unit):
    """Regions sorted by anchor and salt: whole anchors are gathered to a shard's size, then sorted."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.dtype(unit.kind).itemsize
        parts: list[dict] = []
        group: list[dict] = []
        size, own, last = 0, 0, None  # symbols of parts and of group
        for batch in batches:
            for row in batch.to_pylist():
                if last is not None and (row["anchor"], row["salt"]) != (last["anchor"], last["salt"]):
                    if parts and size + own > SHARD:  # a group never joins a shard that it would make too large
                        yield _batch(*shard_repeats(parts, unit.length, unit.kind))
                        parts, size = [], 0
                    parts, group, size, own = parts + group, [], size + own, 0
                elif last is not None and row["region"] == last["region"]:
                    continue  # a row that the table holds twice
                group.append(row)
                own += len(row["body"]) // wide + 1
                last = row
        if parts and size + own > SHARD:
            yield _batch(*shard_repeats(parts, unit.length, unit.kind))
            parts = []
        if parts or group:
            yield _batch(*shard_repeats(parts + group, unit.length, unit.kind))
        trim()

    return gather


def merged(runs: list[tuple[np.ndarray, bytes]]) -> list[tuple[bytes, int]]:
    """Starts (key, start) whose string another run holds too; runs are sorted, and met two by two by binary search."""
    out: list[tuple[bytes, int]] = []
    level = [(x, np.zeros(len(x), dtype=np.int64) + k) for k, (x, _) in enumerate(runs)]

    def told(x: np.ndarray, run: np.ndarray, which: np.ndarray) -> None:
        for k in which:
            if x["region"][k] != _NOBODY:
                at = 16 * int(x["region"][k])
                out.append((runs[run[k]][1][at : at + 16], int(x["start"][k])))

    while len(level) > 1:
        after = []
        for k in range(0, len(level) - 1, 2):
            (a, of_a), (b, of_b) = level[k], level[k + 1]
            at = np.searchsorted(a["f"], b["f"])
            near = np.minimum(at, max(len(a) - 1, 0))
            same = (a["f"][near] == b["f"]) & (a["g"][near] == b["g"]) if len(a) else np.zeros(len(b), bool)
            told(b, of_b, np.flatnonzero(same))
            told(a, of_a, near[same])
            a = a.copy()
            a["region"][near[same]] = _NOBODY  # known now; it still stands for its string
            after.append((np.insert(a, at[~same], b[~same]), np.insert(of_a, at[~same], of_b[~same])))
        if len(level) % 2:
            after.append(level[-1])
        level = after
    return out


def _mergers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: list[tuple[np.ndarray, bytes]] = []
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            if last is not None and (row["anchor"], row["slice"]) != last:
                yield _spans(merged(runs))
                runs = []
            last = row["anchor"], row["slice"]
            runs.append((np.frombuffer(row["body"], dtype=_ENTRY), row["keys"]))
    if runs:
        yield _spans(merged(runs))


def _spans(starts: list[tuple[bytes, int]]) -> pa.RecordBatch:
    at = pa.array([s for _, s in starts], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in starts], pa.binary()), at, at], names=["key", "lo", "hi"])


def _bodies(unit: Unit):
    """Rows (key, text, regions) as a row for each region, with the region's symbols."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            edges, data = unit.coded(*utf8_block(batch.column(1)))
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            x = lists.flatten()
            fields = [x.field(k) for k in range(x.type.num_fields)]
            lo, hi = (x.field(k).to_numpy() for k in ("lo", "hi"))
            body = [data[edges[r] + a : edges[r] + b + unit.length].tobytes() for r, a, b in zip(row, lo, hi)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *fields, pa.array(body, pa.binary())], names=["key", *(f.name for f in x.type), "body"])
        trim()

    return cut


def repeated_starts(documents: DataFrame, scratch: Scratch, unit: Unit = BYTES) -> DataFrame:
    """key (of the text), and lo and hi of runs of starts whose string starts somewhere else too; runs may overlap."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows, schema = _rows(kind, unit)
    keyed = documents.select(text_key().alias("key"), "doc_id", text_or_empty().alias("text"))
    least = unit.length if unit.kind == "u1" else 2 * unit.length - 1  # words have a byte at least, and one between them
    found = scratch.table(keyed.filter(F.octet_length("text") >= least).mapInArrow(rows, schema))
    # Equal regions are counted where they are read first; then an anchor's different regions are.
    each = scratch.table(found.groupBy("anchor", "region").agg(F.sum(F.size("places")).alias("copies"), F.min(F.col("places")[0]).alias("at")))
    size = F.sum(F.col("at.hi") - F.col("at.lo") + unit.length + 1)
    anchors = scratch.table(each.groupBy("anchor").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("different"), size.alias("symbols")).filter("n > 1"))
    met = scratch.table(each.join(anchors, "anchor"))
    scratch.drop(each, anchors)
    n_mixed = met.agg(F.count_if(F.col("different") > 1)).first()[0]
    whole = met.filter("copies > 1").select("anchor", "region")
    # What many texts share comes out of few tasks of the join: it is dealt evenly before its places become rows.
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = scratch.table(found.join(whole, ["anchor", "region"]).select("places").repartition(parts).select(F.explode("places").alias("x")).select("x.key", "x.lo", "x.hi").distinct())
    scratch.drop(found)
    if not n_mixed:
        return spans
    # Regions are dealt to an anchor's shards by a hash, so a shard gets half of its size on average.
    shards = F.ceil(2 * F.col("symbols") / SHARD).cast("int")
    wanted = met.filter("different > 1").select(F.col("at.key").alias("key"), F.col("at.doc_id").alias("doc_id"), F.struct("anchor", "region", "copies", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), shards.alias("shards")).alias("x"))
    by_text = scratch.table(wanted.groupBy("key", "doc_id").agg(F.collect_list("x").alias("regions")))  # a text's own regions
    scratch.drop(met)
    side = by_text.withColumnsRenamed({"key": "_key", "doc_id": "_doc_id"})
    texts = keyed.join(side, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")))
    if unit.kind == "u1":
        each_region = texts.select("key", F.encode("text", "utf-8").alias("bytes"), F.explode("regions").alias("x"))
        bodies = each_region.select("key", "x.*", F.expr(f"substring(bytes, x.lo + 1, x.hi - x.lo + {unit.length})").alias("body"))
    else:
        bodies = texts.select("key", "text", "regions").mapInArrow(_bodies(unit), "key binary, anchor long, region long, copies long, lo int, hi int, shards int, body binary")
    salted = bodies.withColumn("salt", F.pmod(F.hash("region"), F.col("shards")))
    dealt = salted.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "region")
    sorted_ = scratch.table(dealt.mapInArrow(_shards(unit), _OUT))
    scratch.drop(by_text)
    sent = sorted_.filter("key is null").select("anchor", "slice", "keys", "body")
    over = sent.repartition("anchor", "slice").sortWithinPartitions("anchor", "slice").mapInArrow(_mergers, "key binary, lo int, hi int")
    return spans.unionByName(sorted_.filter("key is not null").select("key", "lo", "hi")).unionByName(scratch.table(over))


def with_spans(documents: DataFrame, scratch: Scratch, unit: Unit = BYTES, text_column: str = "text") -> tuple[DataFrame, str]:
    """documents with the runs of repeated starts of their texts, under the name that is returned too."""
    spans = repeated_starts(documents.select("doc_id", F.col(text_column).alias("text")), scratch, unit)
    by_key = scratch.table(spans.groupBy("key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    key, spans_name = free_name(documents, "key"), free_name(documents, "spans")
    side = by_key.withColumnsRenamed({"key": key, "spans": spans_name})
    return documents.join(side, text_key(text_column) == F.col(key), "left").drop(key), spans_name


def covered(found: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Runs of starts as maximal spans [lo, hi) of what their strings cover, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((x["lo"], x["hi"] + length) for x in found or ()):
        if out and lo <= out[-1][1]:  # runs that touch are one
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def left_of(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is left of data without these spans."""
    edges = [0, *(x for span in spans for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if spans else data


def without_repeats(documents: DataFrame) -> DataFrame:
    """documents' columns plus kept (bytes left), n_bytes, n_removed and n_spans in a struct column `repeats`."""
    scratch = Scratch(documents.sparkSession, "repeats")
    name = free_name(documents, "repeats")
    found, spans_name = with_spans(documents, scratch)
    body_name = free_name(found, "bytes")
    n = len(documents.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body_name, 2 << 20):
            kept, sizes, removed, counts = [], [], [], []
            for body, starts in zip(batch.column(n), batch.column(n + 1).to_pylist()):
                data, spans = body.as_py() or b"", covered(starts, LENGTH)
                kept.append(left_of(data, spans))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                counts.append(len(spans))
            made = pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64())], names=["kept", "n_bytes", "n_removed", "n_spans"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], made], names=[*batch.schema.names[:n], name])

    made = T.StructType().add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    out = found.select(*documents.columns, F.encode(text_or_empty(), "utf-8").alias(body_name), spans_name)
    return out.mapInArrow(cut, T.StructType([*documents.schema.fields, T.StructField(name, made)]))


def without_passages(documents: DataFrame) -> DataFrame:
    """documents with a struct column `repeats`: kept (the text without passages of over 50 words that start elsewhere too),
    n_words and n_removed (words). Spans reach from a word's first byte to a word's last, so they cut no character."""
    scratch = Scratch(documents.sparkSession, "passages")
    name = free_name(documents, "repeats")
    found, spans_name = with_spans(documents, scratch, PASSAGES)
    body_name = free_name(found, "body")
    n = len(documents.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, body_name, BLOCK):
            offsets, data = utf8_block(batch.column(n))
            starts, ends, first = word_spans(offsets, data)
            kept, removed = [], []
            for k, runs in enumerate(batch.column(n + 1).to_pylist()):
                spans = covered(runs, PASSAGES.length)
                at = offsets[k]
                own = data[at : offsets[k + 1]].tobytes()
                kept.append(left_of(own, [(starts[first[k] + a] - at, ends[first[k] + b - 1] - at) for a, b in spans]).decode("utf-8", "replace"))
                removed.append(sum(b - a for a, b in spans))
            made = pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64())], names=["kept", "n_words", "n_removed"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], made], names=[*batch.schema.names[:n], name])

    made = T.StructType().add("kept", "string").add("n_words", "long").add("n_removed", "long")
    out = found.select(*documents.columns, text_or_empty().alias(body_name), spans_name)
    return out.mapInArrow(cut, T.StructType([*documents.schema.fields, T.StructField(name, made)]))


def kept_digest(kept: bytes) -> str:
    """The digest of what is left, as queries report it."""
    return hashlib.sha256(kept).hexdigest()
