"""N-gram Jaccard join: MinHash bands make candidates, full n-gram sets decide.

Texts become sets of hashed word 5-grams (a text of fewer words is one gram; a text without words has none and meets no
other). Texts with one set are one class from the start: a set is known by 128 bits of it, and stands for all its copies.

Bands: `choose_bands` takes the rows and the number of bands, under a bound on hashes, for which two sets at the threshold
meet in some band with the target probability and unlike ones do least.

Candidates: a bucket (sets with one band value) isn't turned into pairs. Its members carry sketches, two bits of each MinHash;
a task compares the sketches of a bucket and names the members with a likely partner (within SIGMAS of the threshold) that they
meet in no earlier band. Only these come again with full sets, and a task verifies each likely pair, once among all bands.
It tells the number of links of each set and as many links as join the same sets, so rows stay in proportion to members.
A bucket of more than MOST members, or of over FULL bytes of sets, is dealt to parts by a hash, and every two parts meet in a
task of their own.

Defined results: null is the empty text; repeated rows are copies; ties of ids are one id; the class is named by its least
doc_id (null if it has no other); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatlake.llm._shared import Scratch, free_name, mix64, slices, small_enough, text_or_empty, trim, utf8_block, word_spans
from beatlake.llm.links import components
from beatlake.llm.repeats import prefix_sums, stretch_hash

#: Words of a gram, least similarity of a link, wanted probability of a meeting at that similarity, and most hashes.
WORDS, LEAST, RECALL, HASHES = 5, 0.8, 0.9995, 256
#: Members and bytes of sets of a part of a bucket; margin of the sketch, in standard deviations.
MOST, FULL, SIGMAS = 2048, 8 << 20, 5.0

_GRAM = mix64(np.arange(16, dtype=np.uint64) + np.uint64(501)) | np.uint64(1)


def choose_bands(least: float = LEAST, recall: float = RECALL, most: int = HASHES, unlike: float = 0.4) -> tuple[int, int]:
    """(bands, rows): among those that reach the recall, the pair that meets unlike sets least."""
    best = None
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(least**rows))))
        if bands * rows > most:
            break
        chance = 1 - (1 - unlike**rows) ** bands
        if best is None or chance < best[0]:
            best = (chance, bands, rows)
    return best[1], best[2]


def gram_sets(offsets: np.ndarray, data: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word grams of each document of a block, sorted, and where each document's begin."""
    starts, ends, first = word_spans(offsets, data)
    n = np.diff(first)
    word = stretch_hash(prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    grams = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), grams)
    at = first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    left = first[1:][doc] - at  # words from here to the document's end
    total = np.zeros(len(doc), dtype=np.uint64)
    for k in range(words):
        total += np.where(left > k, word[np.minimum(at + k, max(len(word) - 1, 0))] * _GRAM[k] if len(word) else np.uint64(0), np.uint64(0))
    total = mix64(total)
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    total, doc = total[keep], doc[keep]
    return total, np.searchsorted(doc, np.arange(len(n) + 1))


def band_values(grams: np.ndarray, edges: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each band of each non-empty set (sets x bands), and the sets' sketches: two bits of each MinHash in
    eight words, the low bits first."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    h = mix64(np.arange(2 * bands * rows, dtype=np.uint64) + np.uint64(1000))
    factor, shift = (h[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (h[1::2] >> np.uint64(32)).astype(np.uint32)
    out, sketch = np.empty((len(edges) - 1, bands), dtype=np.uint64), np.zeros((len(edges) - 1, 8), dtype=np.uint64)
    for band in range(bands):
        value = np.full(len(edges) - 1, band, dtype=np.uint64)
        for k in range(band * rows, band * rows + rows):
            least = mix64(np.minimum.reduceat(low * factor[k] + shift[k], edges[:-1]))
            value = mix64(value ^ (least << np.uint64(1)))
            for bit in range(2):
                sketch[:, 4 * bit + k // 64] |= (least >> np.uint64(bit) & np.uint64(1)) << np.uint64(k % 64)
        out[:, band] = value
    return out, sketch


def signatures(documents: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """doc_id, set_id (128 bits of the text's set; null without grams), grams (their number), the bands' values and sketch."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            grams, edges = gram_sets(*utf8_block(batch.column(1)), words)
            size = np.diff(edges)
            full = np.flatnonzero(size)
            keys, values, sketch = np.zeros((len(full), 2), dtype=np.uint64), np.zeros((len(full), bands), dtype=np.uint64), np.zeros((len(full), 8), dtype=np.uint64)
            if len(full):
                at = np.append(edges[full], len(grams))
                keys[:, 0] = np.add.reduceat(grams, at[:-1]) + size[full].astype(np.uint64)
                keys[:, 1] = np.add.reduceat(mix64(grams), at[:-1])
                values, sketch = band_values(grams, at, bands, rows)
            ids, bits = np.full(len(size), None, dtype=object), np.full(len(size), None, dtype=object)
            ids[full], bits[full] = [x.tobytes() for x in keys], [x.tobytes() for x in sketch]
            lists = np.zeros(len(size) + 1, dtype=np.int32)
            np.cumsum(np.where(size > 0, bands, 0), out=lists[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(size, pa.int64()), pa.ListArray.from_arrays(pa.array(lists), pa.array(values.ravel().view(np.int64))), pa.array(bits, pa.binary())], names=["doc_id", "set_id", "grams", "bands", "sketch"])

    slim = documents.select("doc_id", text_or_empty().alias("text"))
    return slim.mapInArrow(sign, f"doc_id {kind}, set_id binary, grams long, bands array<long>, sketch binary")


def full_sets(documents: DataFrame, wanted: DataFrame, n_wanted: int, words: int = WORDS) -> DataFrame:
    """set_id and all gram hashes of the documents in wanted (doc_id, set_id)."""
    side = wanted.withColumnsRenamed({"doc_id": "_doc_id", "set_id": "_set_id"})
    side = F.broadcast(side) if small_enough(n_wanted, 64) else side
    texts = documents.join(side, F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select("_set_id", text_or_empty().alias("text"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            grams, edges = gram_sets(*utf8_block(batch.column(1)), words)
            size = np.diff(edges)
            good = np.flatnonzero(size)
            at = np.append(edges[good], len(grams))
            if not len(good):
                continue
            keys = np.stack([np.add.reduceat(grams, at[:-1]) + size[good].astype(np.uint64), np.add.reduceat(mix64(grams), at[:-1])], axis=1)
            mine = np.array([x.tobytes() == y for x, y in zip(keys, batch.column(0).take(pa.array(good)).to_pylist())])  # ids may be repeated with other texts
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), lists], names=["set_id", "set"]).filter(pa.array(mine))

    return texts.mapInArrow(collect, "set_id binary, set array<long>").dropDuplicates(["set_id"])


def members_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of rows in order of (bucket, lo, hi): the bucket, its band, whether two parts meet, and the members' parts, ids, sketches,
    bands and, where the rows have them, sets."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, band, lo, hi, part = (batch.column(k).to_numpy() for k in range(5))
        ids = utf8_block(batch.column(5))[1].reshape(-1, 16)
        sketch = np.frombuffer(utf8_block(batch.column(6))[1].tobytes(), dtype=np.uint64).reshape(-1, 8)
        bands = batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1)
        sets = np.empty(batch.num_rows, dtype=object)
        if batch.num_columns > 8:
            edges = np.append(0, np.cumsum(batch.column(8).value_lengths().to_numpy()))
            grams = batch.column(8).flatten().to_numpy()
            for k in range(batch.num_rows):
                sets[k] = grams[edges[k] : edges[k + 1]]
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            now = (bucket[start], band[start], lo[start], hi[start])
            if held and now != last:
                yield last[0], last[1], last[2] != last[3], *map(np.concatenate, zip(*held))
                held = []
            last = now
            held.append((part[start:stop], ids[start:stop], sketch[start:stop], bands[start:stop], sets[start:stop]))
    if held:
        yield last[0], last[1], last[2] != last[3], *map(np.concatenate, zip(*held))
    trim()


def likely(band: int, two: bool, part: np.ndarray, sketch: np.ndarray, bands: np.ndarray, hashes: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of all likely pairs of a bucket that meet in no earlier band, a < b, in order; of two parts, pairs across them
    only. The sketch agrees in a hash with probability (1 + 3 J) / 4."""
    chance = (1 + 3 * least) / 4
    apart_most = int(np.ceil(hashes * (1 - chance) + SIGMAS * np.sqrt(hashes * chance * (1 - chance))))
    n, cut = len(part), int(np.searchsorted(part, part[-1])) if two else 0
    if two and part[0] == part[-1]:
        return  # the other part has no members
    step = max(1, (1 << 17) // n)
    for start in range(0, cut if two else n - 1, step):
        stop, first = min(start + step, cut if two else n - 1), cut if two else start + 1
        block = sketch[start:stop, None, :] ^ sketch[None, first:, :]
        near = np.bitwise_count(block[:, :, :4] | block[:, :, 4:]).sum(axis=2, dtype=np.int32) <= apart_most
        a, b = np.nonzero(near)
        a, b = a + start, b + first
        if not two:
            a, b = a[a < b], b[a < b]
        for k in range(0, band, 1 if len(a) > 1000 else band or 1):
            width = 1 if len(a) > 1000 else band - k
            new = (bands[a, k : k + width] != bands[b, k : k + width]).all(axis=1)
            a, b = a[new], b[new]
        if len(a):
            yield a, b


def verified(pairs: Iterator[tuple[np.ndarray, np.ndarray]], sets: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each a of the pairs, the places b whose full sets have at least this Jaccard similarity with its own."""
    size = np.array([len(x) for x in sets])
    edges = np.append(0, np.cumsum(size))
    grams, words = None, None
    for left, right in pairs:
        if grams is None:
            words, grams = np.unique(np.concatenate(sets), return_inverse=True)
            mine = np.zeros(len(words), dtype=bool)
        cuts = np.flatnonzero(left[1:] != left[:-1]) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(left)]):
            a, at = left[start], right[start:stop]
            own = grams[edges[a] : edges[a + 1]]
            mine[own] = True
            if 4 * len(at) > len(sets) - at[0]:
                both = np.add.reduceat(mine[grams[edges[at[0]] :]], edges[at[0] : -1] - edges[at[0]], dtype=np.int64)[at - at[0]]
            else:
                both = np.array([np.count_nonzero(mine[grams[edges[b] : edges[b + 1]]]) for b in at])
            mine[own] = False
            yield a, at[both / (size[a] + size[at] - both) >= least]


def dealt(members: DataFrame, *columns: str) -> DataFrame:
    """Members (bucket, band, set_id, parts, ...) by bucket and two of its parts, so that every two parts meet in one task."""
    part = members.withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int"))
    each = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    keyed = each.select("bucket", "band", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "set_id", *columns)
    return keyed.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "part", "set_id")


def linked(documents: DataFrame, scratch: Scratch, least: float = LEAST, recall: float = RECALL, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all documents; the number of verified links of each set (set_id, n_links); and set components (node, component)."""
    bands, rows = choose_bands(least, recall)
    hashes = bands * rows
    signed = scratch.table(signatures(documents, bands, rows, words))
    sets = signed.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("grams").alias("grams"), F.min(F.struct("bands", "sketch")).alias("x"))
    sets = scratch.table(sets.select("set_id", "doc_id", "grams", "x.sketch", "x.bands"))
    spread = sets.select("set_id", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "band", "set_id")
    # Buckets of one set drop out; what stays is in proportion to near duplicates.
    shared = spread.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / MOST).alias("parts"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = spread.join(shared, "bucket").join(sets.drop("doc_id"), "set_id")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for bucket, band, two, part, ids, sketch, values, _ in members_of(batches):
            found = np.zeros(len(ids), dtype=bool)
            for a, b in likely(band, two, part, sketch, values, hashes, least):
                found[a], found[b] = True, True
            rows += [(bucket, band, x.tobytes()) for x in ids[found]]
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "band", "set_id"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "band", "set_id"])

    # Full sets go only to buckets where their likely pairs meet first.
    needed = scratch.table(dealt(members, "sketch", "bands").mapInArrow(look, "bucket long, band int, set_id binary").distinct())
    wanted = scratch.table(needed.select("set_id").distinct().join(sets.select("set_id", "doc_id"), "set_id").select("set_id", "doc_id"))
    sets_table = scratch.table(full_sets(documents, wanted, wanted.count(), words))
    load = needed.join(sets.select("set_id", "grams"), "set_id").groupBy("bucket").agg(F.greatest(F.ceil(F.count(F.lit(1)) / MOST), F.ceil(8 * F.sum("grams") / FULL)).alias("parts"))
    meeting = needed.join(load, "bucket").join(sets.select("set_id", "sketch", "bands"), "set_id").join(sets_table, "set_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for _, band, two, part, ids, sketch, values, full in members_of(batches):
            count, tree, names = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), [x.tobytes() for x in ids]
            for a, at in verified(likely(band, two, part, sketch, values, hashes, least), full, least):
                count[a] += len(at)
                count[at] += 1
                new = at[tree[at] != tree[a]]
                while len(new):
                    rows.append((names[a], names[new[0]], 0))
                    tree[tree == tree[new[0]]] = tree[a]
                    new = new[tree[new] != tree[a]]
            rows += [(names[k], None, int(count[k])) for k in np.flatnonzero(count)]
            if len(rows) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "n"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "n"])

    # Of its links a task tells each set's number and as many as join the same sets.
    found = scratch.table(dealt(meeting, "sketch", "bands", "set").mapInArrow(verify, "a binary, b binary, n long"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("n_links"))
    return signed, counts, scratch.table(components(found.filter("b is not null").select("a", "b"), scratch))


def near_duplicates(documents: DataFrame, least: float = LEAST, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """doc_id, class_id (the least doc_id among all documents linked to this one, directly or not), n_links (all verified links
    of its set to other sets), n_copies (documents with the same set) and set_id (hexadecimal, null without grams); a row per document."""
    scratch = Scratch(documents.sparkSession, "jaccard")
    documents = documents.select("doc_id", "text")
    signed, ends, whole = linked(documents, scratch, least, recall, words)
    own = signed.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("n_copies"))
    own = scratch.table(own.join(ends, "set_id", "left").join(whole.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id")))
    classes = own.groupBy("component").agg(F.min("_least").alias("class_id"))
    named = own.join(classes, "component").select("set_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return signed.select("doc_id", "set_id").join(named, "set_id", "left").select(
        "doc_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.hex("set_id").alias("set_id")
    )


def one_of_each(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """documents without those that another one of their class stands for: the row with the least doc_id stays (a null id comes
    last; of rows that share it any one, but one alone).

    Rows are told apart by a number of their own, so rows that share an id, or have none, stay or go each for its own text. Texts
    without words stay. All columns are kept under their own names.
    """
    scratch = Scratch(documents.sparkSession, "classes")
    row = free_name(documents, "_row")
    rows = scratch.table(documents.withColumn(row, F.monotonically_increasing_id()))
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), least).filter("set_id IS NOT NULL").select(F.col("doc_id").alias("_of"), F.col("class_id").alias("_class"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("at"))
    classed = scratch.table(rows.select(F.col(row).alias("_of"), order.alias("_order")).join(found, "_of"))
    stay = classed.groupBy("_class").agg(F.min("_order").alias("_first")).select(F.col("_first.at").alias("_of"))
    extra = scratch.table(classed.select("_of").join(stay, "_of", "left_anti"))
    side = F.broadcast(extra) if small_enough(extra.count(), 32) else extra
    return rows.join(side.withColumnRenamed("_of", f"_{row}"), F.col(row) == F.col(f"_{row}"), "left_anti").drop(row)
