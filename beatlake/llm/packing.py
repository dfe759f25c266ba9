"""Best-fit packing of tokenised documents into fixed-length sequences by linear grouping.

The plan depends on the histogram of piece lengths only (at most `max_length` counts), so the driver's share is bounded
whatever the number of documents. Long lengths are rounded up within groups of equal cardinality, configurations of these
few sizes fill sequences, the real (shorter) pieces take the places of the rounded ones, and short pieces go by best fit
into what is left. The plan is a list of ranges "pieces of this length with ranks a to b go to sequences c to d at offset
o"; a piece finds its place by its length and its rank among pieces of that length.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are packed once each; an
empty table gives no pieces; a document longer than a sequence is cut from its end so that its first piece is the short
one; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatlake.llm._shared import Scratch, slices, utf8_block

#: Pieces longer than this share of a sequence are grouped; shorter ones go by best fit.
SMALL_SHARE = 4
#: Groups of equal cardinality (sizes that configurations are made of).
GROUPS = 256
#: Bytes of pieces of a length that are ranked together: blocks of the common and long lengths are many, of rare ones few.
RANK_BYTES = 4 << 20

_encoders: dict[str, tuple] = {}
_exact: dict = {}
_widths: dict[str, np.ndarray] = {}


def encoder(path: str) -> tuple:
    """(fast encoder, strings of added tokens) of a byte-level BPE file; loaded once per process.

    The fast one applies the file's own ranks; it is taken only if the file's merges are in the order of its ids and its
    pre-tokeniser is the standard byte-level pattern, for then both give the same ids.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        added = [x["content"] for x in model["added_tokens"]]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]  # bytes that stand for themselves
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ordered = all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges))
        splitter = model.get("pre_tokenizer") or {}
        fast = None
        if ordered and splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space", True) and splitter.get("use_regex", True) and not model.get("normalizer"):
            ranks = {bytes(letters[c] for c in word): k for word, k in vocab.items() if word not in added}
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # the byte-level pre-tokeniser's fixed pattern
            fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _encoders[path] = fast, added
    return _encoders[path]


def exact_encoder(path: str):
    """The tokenizers library's own encoder, for files and texts that the fast one isn't for; loaded when first needed."""
    if path not in _exact:
        from tokenizers import Tokenizer

        _exact[path] = Tokenizer.from_file(path)
    return _exact[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text, without special tokens being added."""
    fast, added = encoder(path)
    if fast is None or any(x in text for x in added):
        return np.asarray(exact_encoder(path).encode(text, add_special_tokens=False).ids, dtype="<u4")
    return np.array(fast.encode_ordinary(text), dtype="<u4")


#: Lead bytes of the characters beyond ASCII that may be white space (fixed by UTF-8: U+0085, U+00A0, U+1680, U+2000..., U+3000).
_SPACE_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_PLAIN = np.array([not (b == 0x20 or 9 <= b <= 13 or 0x1C <= b <= 0x1F) for b in range(256)]) & ~_SPACE_LEADS
def _unit_starts(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Where texts may be cut without a change of ids: at document starts, and at a lone space between two characters
    that surely aren't white space, for there the byte-level pattern always begins a new piece."""
    cut = np.zeros(len(data) + 1, dtype=bool)
    if len(data) > 4:
        before = _PLAIN[data[2:-2]] & ~_SPACE_LEADS[data[1:-3]] & ~_SPACE_LEADS[data[:-4]]
        cut[3:-2] = (data[3:-1] == 0x20) & before & _PLAIN[data[4:]]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def block_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of an Arrow column on end, and where each text's begin (texts + 1).

    Distinct units between safe cuts are encoded once per block.
    """
    fast, added = encoder(path)
    odd = np.zeros(len(texts), dtype=bool)
    for x in added:
        odd |= pc.match_substring(texts, x).fill_null(False).to_numpy(zero_copy_only=False)
    if fast is None or odd.any():
        each = [token_ids(x or "", path) for x in texts.to_pylist()]
        return np.concatenate([*each, np.zeros(0, "<u4")]).astype("<u4"), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    offsets, data = utf8_block(texts)
    starts = _unit_starts(offsets, data)
    units = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = units.dictionary_encode()
    words = coded.dictionary
    edges, raw = utf8_block(words)
    # A unit that starts with a lone space and ends in a plain byte is cut safely from any neighbour of its kind: these
    # are encoded on end, and the bytes that each id stands for tell where the next unit begins.
    sizes = np.diff(edges)
    padded = np.concatenate([[0, 0], raw, [0, 0]])
    joint = (sizes > 1) & (padded[edges[:-1] + 2] == 0x20) & _PLAIN[padded[edges[:-1] + 3]] & _PLAIN[padded[edges[1:] + 1]] & ~_SPACE_LEADS[padded[edges[1:]]] & ~_SPACE_LEADS[padded[edges[1:] - 1]]
    lengths = np.zeros(len(words), dtype=np.int64)
    many = np.array(fast.encode_ordinary(raw[np.repeat(joint, sizes)].tobytes().decode()), dtype="<u4")
    lengths[joint] = np.diff(np.searchsorted(np.cumsum(_id_bytes(path)[many]), np.cumsum(sizes[joint]), side="left") + 1, prepend=0)
    lone = np.flatnonzero(~joint)
    each = [np.array(fast.encode_ordinary(x), dtype="<u4") for x in words.take(pa.array(lone)).to_pylist()]
    lengths[lone] = [len(x) for x in each]
    flat = np.concatenate([many, *each]).astype("<u4")
    first = np.empty(len(words), dtype=np.int64)
    first[joint] = np.cumsum(lengths[joint]) - lengths[joint]
    first[lone] = len(many) + np.cumsum(lengths[lone]) - lengths[lone]
    order = coded.indices.to_numpy()
    n = lengths[order]
    ends = np.cumsum(n)
    out = flat[np.repeat(first[order] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
    return out, np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]


def _id_bytes(path: str) -> np.ndarray:
    """How many bytes each id stands for."""
    if path not in _widths:
        fast = encoder(path)[0]
        _widths[path] = np.array([len(fast.decode_single_token_bytes(k)) for k in range(fast.max_token_value + 1)], dtype=np.int64)
    return _widths[path]


def tokenised_pieces(documents: DataFrame, path: str, max_length: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of the pieces of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype="<u4")
        for batch in slices(batches, "text", 3 << 20):
            ids, edges = block_ids(batch.column(1), path)
            total = np.diff(edges) + 1  # with the end id
            pieces = -(-total // max_length)
            row = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = total - (pieces - 1) * max_length
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * max_length)
            length = np.where(piece == 0, first[row], max_length)
            full = np.insert(ids, edges[1:], end)
            begin = edges[:-1][row] + row + start
            bodies = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.append(begin, len(full)).astype(np.int64) * 4), pa.py_buffer(full)])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), bodies.cast(pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    slim = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return slim.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


class _Bins:
    """Runs of sequences with the same fill: (first sequence, how many) by free tokens; and the places given so far."""

    def __init__(self, capacity: int):
        self.capacity, self.next, self.free = capacity, 0, defaultdict(list)
        self.levels: list[int] = []
        self.places: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset

    def add(self, room: int, first: int, n: int) -> None:
        if not self.free[room] and room:
            insort(self.levels, room)
        self.free[room].append((first, n))

    def take(self, room: int, n: int) -> tuple[int, int]:
        """A run of at most n sequences with this room."""
        first, count = self.free[room].pop()
        if count > n:
            self.free[room].append((first + n, count - n))
        if not self.free[room]:
            self.levels.pop(bisect_left(self.levels, room))
        return first, min(n, count)

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n

    def put(self, length: int, rank: int, first: int, n: int, room: int) -> None:
        self.places.append((length, rank, n, first, self.capacity - room))


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places (length, first rank, count, first sequence, offset) for counted lengths, and the number of sequences."""
    bins = _Bins(capacity)
    if counts.get(capacity):
        bins.put(capacity, 0, bins.open(counts[capacity]), counts[capacity], capacity)
    small = capacity // small_share
    large = [(x, counts[x]) for x in sorted(counts, reverse=True) if small < x < capacity and counts[x]]
    total = sum(n for _, n in large)
    size = -(-total // groups) if total else 1
    # Linear grouping: pieces in descending length, dealt to groups of equal cardinality; a group's size is its longest.
    queues: list[list[list[int]]] = []  # per group, ranges [length, next rank, left]
    sizes: list[int] = []
    left = 0
    for length, n in large:
        rank = 0
        while n:
            if not left:
                queues.append([])
                sizes.append(length)
                left = size
            k = min(n, left)
            queues[-1].append([length, rank, k])
            rank, n, left = rank + k, n - k, left - k
    available = [sum(r[2] for r in q) for q in queues]
    while any(available):
        uses = _configuration(sizes, available, capacity)
        times = min(available[g] // m for g, m in uses.items())
        runs = [(bins.open(times), times, capacity)]  # first sequence, how many, room
        for g in sorted(uses):
            available[g] -= uses[g] * times
            for _ in range(uses[g]):
                after = []
                for first, n, room in runs:
                    while n:
                        r = queues[g][0]
                        k = min(n, r[2])
                        bins.put(r[0], r[1], first, k, room)
                        after.append((first, k, room - r[0]))
                        first, n, r[1], r[2] = first + k, n - k, r[1] + k, r[2] - k
                        if not r[2]:
                            queues[g].pop(0)
                runs = after
        for first, n, room in runs:
            bins.add(room, first, n)
    for length in sorted((x for x in counts if 0 < x <= small and x < capacity), reverse=True):
        rank, n = 0, counts[length]
        while n:
            at = bisect_left(bins.levels, length)
            if at == len(bins.levels):  # no room anywhere: open as many as these pieces need
                new = -(-n // (capacity // length))
                bins.add(capacity, bins.open(new), new)
                continue
            room = bins.levels[at]
            first, k = bins.take(room, n if room < 2 * length else max(1, -(-n // (room // length))))
            bins.put(length, rank, first, k, room)
            bins.add(room - length, first, k)
            rank, n = rank + k, n - k
    return bins.places, bins.next


def _configuration(sizes: list[int], available: list[int], capacity: int) -> dict[int, int]:
    """Uses per group of the fullest sequence that holds the longest size left (subset sums as bits)."""
    first = next(g for g, n in enumerate(available) if n)
    room = capacity - sizes[first]
    mask = (1 << (room + 1)) - 1
    steps, reach = [], 1
    for g in range(first, len(sizes)):
        most = min(available[g] - (g == first), room // sizes[g])
        before = reach
        for _ in range(most):
            reach |= (before << sizes[g]) & mask if _ == 0 else (reach << sizes[g]) & mask
        steps.append((g, before, most))
    rest, uses = reach.bit_length() - 1, defaultdict(int, {first: 1})
    for g, before, most in reversed(steps):
        k = 0
        while not before >> (rest - k * sizes[g]) & 1:
            k += 1
        uses[g] += k
        rest -= k * sizes[g]
    return {g: m for g, m in uses.items() if m}


def packed(pieces: DataFrame, max_length: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset. Reads pieces twice: give it a written table."""
    lengths = pieces.groupBy("length").count()
    counts = {int(r["length"]): int(r["count"]) for r in lengths.collect()}  # at most max_length rows
    places, _ = plan(counts, max_length)
    blocks = F.array(*(F.lit(max(1, -(-4 * k * counts.get(k, 0) // RANK_BYTES))) for k in range(1, max_length + 1)))
    salted = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", "ids"), F.element_at(blocks, F.col("length").cast("int"))).cast("int"))
    starts = salted.groupBy("length", "_block").count().select("length", "_block", (F.sum("count").over(Window.partitionBy("length").orderBy("_block")) - F.col("count")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(starts, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)
    key = table[:, 0] << 44 | table[:, 1]  # ranks stay below 2^44
    shared = pieces.sparkSession.sparkContext.broadcast((key, table))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = shared.value
        at = rows[np.searchsorted(keys, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1]
        return pd.DataFrame({"sequence_id": at[:, 3] + rank.to_numpy() - at[:, 1], "offset": at[:, 4]})

    return ranked.withColumn("_place", place("length", "_rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """One row per sequence: its length, its token ids as one binary, and the documents in it, in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most max_length pieces
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("_parts")).select("sequence_id", "length", F.aggregate("_parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"), F.col("_parts.doc_id").alias("doc_ids"))


def pack_documents(documents: DataFrame, path: str, max_length: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their ids and places; the pieces are written once to the shared folder."""
    scratch = Scratch(documents.sparkSession, "pieces")
    return packed(scratch.table(tokenised_pieces(documents, path, max_length, end_id)), max_length)
