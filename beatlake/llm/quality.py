"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated output.

1. Word vectors. Texts are cut into runs of letters, digits or one symbol; a run of letters gives a token for its shape
   (case and length) and one for its letters. Tokens are hashed to a fixed number of rows. Every row has a sparse random
   index vector; its context vector is the sum of the index vectors of the tokens beside it over all texts (counted by all
   tasks, summed by slices). A word vector is the index vector beside the normalised context vector.
2. Documents are the mean of their tokens' vectors, with the logarithm of their number of tokens.
3. A network of one hidden layer is fitted in numpy on a bounded sample of labelled rows (SAMPLE), and a temperature on a
   part of that sample makes its output a probability.

As pooling and the first layer are both linear, scoring sums one row of the hidden layer's width per token.

Defined results: a null text is the empty text and gets the network's score for no token; a document with several labels
counts as good if their mean is at least 1/2; null labels and ids teach nothing; ids may be of any type; of documents that
repeat an id one teaches; without labels of both kinds all scores are the share of good labels (1/2 without any); repeated
rows get one score each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatlake.llm._shared import collect_model, cut_model, free_name, is_fold, mix64, model_rows, slices, sum_models, text_or_empty, trim, utf8_block

#: Rows of word vectors (tokens are hashed to them), width of a vector, and tokens on either side that count as context.
ROWS, WIDTH, WINDOW = 1 << 14, 64, 2
#: Labelled documents that the network is fitted on, about (all of them, if fewer); every fifth sets the temperature.
SAMPLE, CALIBRATION = 20_000, 5
HIDDEN, EPOCHS, RATE, DECAY = 16, 150, 0.01, 1e-4
#: Scores from here on predict good quality.
THRESHOLD = 0.7
SLICE = 1 << 16
#: Bytes of text that a task works on at a time, and word vectors that it adds up at a time.
BLOCK, ADDED = 1 << 19, 1 << 15

_SHAPES = 64  # the first rows are shapes
_CLASS = np.array([0 if b <= 0x20 or b == 0x7F else 1 if b >= 0x80 or chr(b).isalpha() else 2 if chr(b).isdigit() else b for b in range(256)], dtype=np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], dtype=np.uint8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_BYTE = mix64(np.arange(256, dtype=np.uint64))
_BYTE_LOWER = _BYTE[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse, at least n of each; kept per process."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (_STEP, _BACK):
            x = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            made.append(x)
        _powers[:] = made
    return _powers


def index_vectors(rows: int = ROWS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The places of the +1 and of the -1 in each row's index vector."""
    h = mix64(np.arange(rows, dtype=np.uint64) + np.uint64(77))
    plus = (h % np.uint64(width)).astype(np.int64)
    return plus, (plus + 1 + (h >> np.uint64(32)).astype(np.int64) % (width - 1)) % width


def tokens(offsets: np.ndarray, data: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Token rows of all documents of a block, and where each document's begin (documents + 1)."""
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    first = np.ones(len(data), dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    edges = offsets[:-1]
    first[edges[edges < len(data)]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(data))
    what = kind[starts]
    keep = what > 0
    starts, ends, what = starts[keep], ends[keep], what[keep]
    step, back = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    value = _BYTE_LOWER[data]
    value *= step[: len(data)]
    np.cumsum(value, out=sums[1:])
    del value
    letters = what == 1
    size = ends - starts
    symbol = mix64((what.astype(np.uint64) << np.uint64(8)) + np.minimum(size, 4).astype(np.uint64))
    own = np.where(letters, mix64((sums[ends] - sums[starts]) * back[starts]), symbol)
    own = (_SHAPES + own % np.uint64(rows - _SHAPES)).astype(np.int32)
    upper = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(_UPPER[data], out=upper[1:])
    capitals = upper[ends] - upper[starts]
    case = np.where(capitals == 0, 0, np.where(capitals * 2 > size, np.where(size == 1, 1, 2), np.where((capitals == 1) & _UPPER[data[starts]], 1, 3)))
    shape = (case * 8 + np.minimum(7, np.searchsorted([2, 4, 6, 8, 11, 15, 24], size, side="right"))).astype(np.int32)
    place = np.cumsum(np.where(letters, 2, 1))
    out = np.empty(place[-1] if len(place) else 0, dtype=np.int32)
    out[place - 1] = own
    out[place[letters] - 2] = shape[letters]
    return out, np.concatenate([[0], place])[np.searchsorted(starts, offsets)]


def context_sums(documents: DataFrame, text_column: str = "text", rows: int = ROWS, width: int = WIDTH) -> np.ndarray:
    """Context vectors of all rows over all texts. Tasks send slices of whole numbers; the driver gets the sum alone."""
    size = rows * width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = index_vectors(rows, width)
        total = np.zeros(size, dtype=np.int64)
        for batch in slices(batches, text_column, BLOCK):
            ids, edges = tokens(*utf8_block(batch.column(0)), rows)
            doc = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
            for apart in range(1, WINDOW + 1):
                both = doc[apart:] == doc[:-apart]
                a, b = ids[:-apart][both].astype(np.int64), ids[apart:][both].astype(np.int64)
                for of, by in ((a, b), (b, a)):
                    total += np.bincount(of * width + plus[by], minlength=size)
                    total -= np.bincount(of * width + minus[by], minlength=size)
        yield model_rows(cut_model(total.astype(np.float64), SLICE))

    slim = documents.select(F.col(text_column).cast("string").alias(text_column))
    found = sum_models(slim.mapInArrow(count, "slice int, body binary"), size // SLICE)
    return collect_model(found, size, SLICE).reshape(rows, width)


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Index vectors beside context vectors, these centred and of length 1 (rows without context stay 0)."""
    rows, width = contexts.shape
    plus, minus = index_vectors(rows, width)
    out = np.zeros((rows, 2 * width), dtype=np.float32)
    out[np.arange(rows), plus] += 1
    out[np.arange(rows), minus] -= 1
    norm = np.linalg.norm(contexts, axis=1, keepdims=True)
    unit = np.divide(contexts, norm, out=np.zeros_like(contexts), where=norm > 0)
    seen = norm[:, 0] > 0
    if seen.any():
        unit[seen] -= unit[seen].mean(axis=0)
        length = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, length, out=np.zeros_like(unit), where=length > 0)
    out[:, width:] = unit
    return out


def pooled(ids: np.ndarray, edges: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean of the vectors of each document's tokens; documents without tokens get 0."""
    out = np.zeros((len(edges) - 1, vectors.shape[1]))
    for at in range(0, len(ids), ADDED):  # a document may lie in several of these
        stop = min(at + ADDED, len(ids))
        some = np.arange(np.searchsorted(edges, at, side="right") - 1, np.searchsorted(edges, stop, side="left"))
        some = some[np.minimum(edges[some + 1], stop) > np.maximum(edges[some], at)]
        out[some] += np.add.reduceat(vectors[ids[at:stop]], np.maximum(edges[some], at) - at, axis=0, dtype=np.float64)
    return out / np.maximum(np.diff(edges), 1)[:, None]


@dataclass
class Model:
    """What scoring needs: a row of the hidden layer for each token row, and the rest of the network."""

    rows: np.ndarray
    length: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float
    constant: float | None = None

    def scores(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(edges) - 1, self.constant)
        hidden = np.tanh(pooled(ids, edges, self.rows) + np.log1p(np.diff(edges))[:, None] * self.length + self.bias)
        return 1 / (1 + np.exp(-np.clip((hidden @ self.out + self.out_bias) / self.temperature, -30, 30)))


def fit_network(features: np.ndarray, labels: np.ndarray, calibrate: np.ndarray, seed: int = 3) -> dict:
    """Weights and temperature of the two-layer network, by Adam over mini-batches. calibrate marks the rows kept for the
    temperature; the last feature is the logarithm of the number of tokens."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x, y = ((features - mean) / scale)[~calibrate], labels[~calibrate].astype(float)
    rng = np.random.default_rng(seed)
    w = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.tanh(x[at] @ w["w1"] + w["b1"])
            error = (1 / (1 + np.exp(-np.clip(h @ w["w2"] + w["b2"], -30, 30))) - y[at]) / len(at)
            back = np.outer(error, w["w2"]) * (1 - h * h)
            grads = {"w1": x[at].T @ back + DECAY * w["w1"], "b1": back.sum(axis=0), "w2": h.T @ error + DECAY * w["w2"], "b2": error.sum(keepdims=True)}
            t += 1
            for k, g in grads.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    held, truth = ((features - mean) / scale)[calibrate], labels[calibrate].astype(float)
    temperature = 1.0
    if len(held):
        z = np.tanh(held @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.mean(np.logaddexp(0, -np.where(truth > 0, z, -z) / c)) for c in grid]
        temperature = float(grid[int(np.argmin(loss))])
    inner = w["w1"] / scale[:, None]
    return {"inner": inner, "bias": w["b1"] - mean @ inner, "out": w["w2"], "out_bias": float(w["b2"][0]), "temperature": temperature}


def fitted(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, divisor: int = 4, remainder: int = 2) -> Model:
    """Learn from the labels whose id leaves another remainder; word vectors come from all texts."""
    spark = documents.sparkSession
    good = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~is_fold("doc_id", divisor, remainder))
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    )
    n, share = good.agg(F.count(F.lit(1)), F.avg("quality")).first()
    if not n or share in (0.0, 1.0):
        return Model(np.zeros((ROWS, 1), np.float32), np.zeros(1), np.zeros(1), np.zeros(1), 0.0, 1.0, constant=0.5 if not n else float(share))
    chance = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < min(1 << 20, -(-(sample << 20) // n))
    # The sample's ids are bounded by its size (and a fifth, for chance), so they may be broadcast.
    chosen = F.broadcast(good.filter(chance).limit(sample + sample // 5))
    vectors = word_vectors(context_sums(documents))
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BLOCK):
            ids, edges = tokens(*utf8_block(batch.column(2)))
            x = np.hstack([pooled(ids, edges, shared.value), np.log1p(np.diff(edges))[:, None]]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["key", "quality", "x"])

    key = F.col("doc_id").cast("long") if isinstance(documents.schema["doc_id"].dataType, T.IntegralType) else F.xxhash64("doc_id")
    slim = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").select(key.alias("key"), "quality", "text")
    # One row for each id, so what comes to the driver is bounded by the sample.
    one = slim.mapInArrow(features, "key long, quality int, x binary").groupBy("key").agg(F.min(F.struct("quality", "x")).alias("r")).select("key", "r.*")
    rows = sorted(one.collect(), key=lambda r: r["key"])
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows], dtype=np.float64)
    y = np.array([r["quality"] for r in rows])
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((ROWS, 1), np.float32), np.zeros(1), np.zeros(1), np.zeros(1), 0.0, 1.0, constant=float(share))
    fold = mix64(np.array([r["key"] for r in rows], dtype=np.int64).astype(np.uint64)) % np.uint64(CALIBRATION) == 0
    net = fit_network(x, y, fold)
    return Model((vectors.astype(np.float64) @ net["inner"][:-1]).astype(np.float32), net["inner"][-1], net["bias"], net["out"], net["out_bias"], net["temperature"])


def score_of(spark: SparkSession, model: Model, text_column: str = "text") -> Column:
    """The score of a text: tasks send texts to Python and get a number back."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [shared.value.scores(*tokens(*utf8_block(x.column(0)))) for x in slices(iter([pa.record_batch([column], names=["text"])]), "text", BLOCK)]
            yield pa.array(np.concatenate([*parts, np.zeros(0)]), pa.float64())
        trim()

    return score(text_or_empty(text_column))


def scored(documents: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """documents (or the columns `keep`) with a quality score, under `score` or a free name."""
    name = free_name(documents, "score") if keep is None else "score"
    kept = documents.columns if keep is None else keep
    return documents.select(*kept, score_of(documents.sparkSession, model, text_column).alias(name))


def good_only(documents: DataFrame, model: Model, least: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of documents whose score reaches `least`, as they are."""
    return documents.filter(score_of(documents.sparkSession, model, text_column) >= least)
