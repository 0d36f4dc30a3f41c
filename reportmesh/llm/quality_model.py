"""Quality classifier: a factorisation machine over hashed words and structure statistics of a text.

Score of features x: sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]);
the sum-of-squares identity makes the pairwise part linear in the features. Features are lower-cased
words hashed to ``BUCKETS`` (log counts, unit length), and structure statistics of the whole text: shares
of capitals, digits, symbols, blanks, lines that repeat, words that repeat, word and line lengths.
Neither labels nor language, source or id are inputs of a score.

The model is fitted on at most ``MAX_TRAIN`` labelled rows (those with the smallest hash of their id), in
one task of bounded size; scoring covers all rows. A null text is empty; an empty text has structure
statistics only and gets a score like any other. Labels that are null, or whose id has two labels, are
left out. Without labels of both kinds the score is the share of ones, or 1 without any label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import NOT_SPACE, byte_class, counts_of, flat_blocks, fold, hash_spans, lower_ascii, mix, sums_between, words
from .frames import documents, held_out, map_arrow, read

BUCKETS = 1 << 15
#: Metadata of the query; lang, source and doc_id are barred.
METADATA = ("n_chars",)
FACTORS = 6
#: Bound of the training sample, in labelled documents.
MAX_TRAIN = 8000
EPOCHS = 6
THRESHOLD = 0.3

_UPPER = ~byte_class((0x41, 0x5A))
_LOWER = ~byte_class((0x61, 0x7A))
_DIGIT = ~byte_class((0x30, 0x39))
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>|^~=_+\\@{}[]", np.uint8))
_BANG = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
_STOP = np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8))
_LINE = byte_class((0x0A, 0x0A))
STATISTICS = 14


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Structure statistics of each row, between 0 and about 1."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, rows = words(data, offsets, NOT_SPACE)
    n_words = counts_of(rows, n)
    many = np.maximum(n_words, 1)
    share = lambda flags: sums_between(flags[data], offsets) / size
    h = hash_spans(data, starts, ends)
    word = mix(h ^ rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    three = fold([word[:-2], word[1:-1], word[2:]]) if len(word) > 2 else word[:0]
    repeated = lambda keys, at, base: counts_of(at[_again(keys)], n) / np.maximum(base, 1)
    same = np.flatnonzero(word[1:] == word[:-1])
    ls, le, lr = words(data, offsets, _LINE)
    lines = mix(hash_spans(data, ls, le) ^ lr.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n_lines = counts_of(lr, n)
    upper, lower = share(_UPPER), share(_LOWER)
    return np.stack(
        [
            np.ones(n),
            upper / np.maximum(upper + lower, 1e-9),
            np.minimum(share(_SYMBOL) * 5, 1),
            np.minimum(sums_between(data == 0x7C, offsets) / many * 2, 1),
            np.minimum(share(_BANG) * 10, 1),
            np.minimum(share(_DIGIT) * 5, 1),
            np.minimum(share(_STOP) * 10, 1),
            np.minimum(size / many / 20, 1),
            np.log1p(n_words) / 12,
            np.minimum(n_lines / many, 1),
            repeated(lines, lr, n_lines),
            repeated(three, rows[: len(three)], n_words),
            counts_of(rows[same], n) / many,
            repeated(word, rows, n_words) / 2,
        ],
        1,
    ).astype(np.float32)


def _again(keys: np.ndarray) -> np.ndarray:
    """Positions of keys that stand earlier already."""
    order = np.argsort(keys, kind="stable")
    return order[1:][keys[order][1:] == keys[order][:-1]]


def metadata_ids(columns: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashed feature ids of metadata: name and value, of a number its sign and power of two. A
    null has no feature."""
    rows, ids = [], []
    for name, column in columns.items():
        for k, value in enumerate(column.to_pylist()):
            if value is None:
                continue
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                value = (value < 0, math.frexp(value)[1])
            rows.append(k)
            ids.append(xxhash.xxh64_intdigest(f"{name}={value}") % BUCKETS)
    return np.array(rows, np.int64), np.array(ids, np.int64)


def _metadata(metadata: tuple[str, ...]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"metadata_{c}") for c in metadata]


def _of_batch(batch: pa.RecordBatch, metadata: tuple[str, ...], i: int, j: int, prefix: str = "metadata_") -> tuple[np.ndarray, np.ndarray]:
    return metadata_ids({c: batch.column(prefix + c).slice(i, j - i) for c in metadata})


def features(data: np.ndarray, offsets: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, feature ids and values of each row: hashed words, the statistics, then metadata."""
    n = len(offsets) - 1
    low = lower_ascii(data)
    starts, ends, rows = words(low, offsets, NOT_SPACE)
    bucket = (hash_spans(low, starts, ends) % np.uint64(BUCKETS)).astype(np.int64)
    cells, counts = np.unique(rows * BUCKETS + bucket, return_counts=True)
    row, value = cells // BUCKETS, 1 + np.log(counts)
    norm = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
    value = value / np.maximum(norm, 1e-9)[row]
    stats = statistics(data, offsets)
    all_rows = np.r_[row, np.repeat(np.arange(n), STATISTICS)]
    ids = np.r_[cells % BUCKETS, np.tile(BUCKETS + np.arange(STATISTICS), n)]
    values = np.r_[value, stats.ravel()].astype(np.float32)
    if more is not None:
        all_rows, ids = np.r_[all_rows, more[0]], np.r_[ids, more[1]]
        values = np.r_[values, np.ones(len(more[0]), np.float32)]
    order = np.argsort(all_rows, kind="stable")
    return np.r_[0, np.cumsum(np.bincount(all_rows, minlength=n))], ids[order], values[order]


class Machine:
    """Parameters of a factorisation machine."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def raw(self, ends: np.ndarray, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linear score of each row, and its sums over factors. Every row has a feature."""
        first = ends[:-1]
        linear = np.add.reduceat(self.weights[ids] * values, first)
        v = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(v, first, axis=0)
        squares = np.add.reduceat((v * v).sum(1), first)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, ends: np.ndarray, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        if len(ends) == 1:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(ends, ids, values)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = 0.1, batch: int = 64) -> Machine:
    """AdaGrad on the logistic loss, in a fixed order of batches."""
    rng = np.random.default_rng(3)
    size = BUCKETS + STATISTICS
    model = Machine(0.0, np.zeros(size, np.float32), (rng.standard_normal((size, FACTORS)) * 0.05).astype(np.float32))
    ones = float(labels.mean()) if len(labels) else 1.0
    if not len(labels) or ones in (0.0, 1.0):
        model.factors[:] = 0
        model.bias = float(np.clip(np.log(max(ones, 1e-9) / max(1 - ones, 1e-9)), -20, 20))
        return model
    model.bias = float(np.log(ones / (1 - ones)))
    g_w, g_v, g_b = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            lengths = np.array([len(rows[i][0]) for i in some])
            ends = np.r_[0, np.cumsum(lengths)]
            ids, values = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            raw, sums = model.raw(ends, ids, values)
            error = (1 / (1 + np.exp(-raw)) - labels[some]).astype(np.float32) / len(some)
            e = np.repeat(error, lengths)
            used, place = np.unique(ids, return_inverse=True)
            ev = e * values
            d_w = np.bincount(place, weights=ev).astype(np.float32) + 1e-6 * model.weights[used]
            grad = ev[:, None] * (np.repeat(sums, lengths, axis=0) - model.factors[ids] * values[:, None])
            d_v = np.stack([np.bincount(place, weights=grad[:, f]) for f in range(FACTORS)], 1).astype(np.float32)
            d_v += 1e-5 * model.factors[used]
            g_w[used] += d_w * d_w
            g_v[used] += d_v * d_v
            model.weights[used] -= rate * d_w / np.sqrt(g_w[used])
            model.factors[used] -= rate * d_v / np.sqrt(g_v[used])
            d_b = float(error.sum())
            g_b += d_b * d_b
            model.bias -= rate * d_b / g_b**0.5
    return model


def train(docs: DataFrame, labels: DataFrame, teaches: Column, *, max_train: int = MAX_TRAIN, metadata: tuple[str, ...] = ()) -> Machine:
    """Fit on a bounded sample of labelled documents. ``labels`` has doc_id and label (0 or 1);
    ``metadata`` names columns of ``docs`` that are features too, here and in scoring."""
    spark = docs.sparkSession
    sample = (
        labels.filter(teaches & F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .filter("label = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
        .select("doc_id", F.col("label").cast("int"))
    )
    # the sample is bounded by max_train rows of two numbers
    rows = documents(docs, *_metadata(metadata)).join(F.broadcast(sample), "doc_id")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in flat_blocks(batch.column("text")):
            ends, ids, values = features(data, offsets, _of_batch(batch, metadata, i, j))
            cut = list(zip(ends, ends[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    batch.column("label").slice(i, j - i),
                    pa.array([ids[a:b].astype("<u4").tobytes() for a, b in cut], pa.binary()),
                    pa.array([values[a:b].astype("<f4").tobytes() for a, b in cut], pa.binary()),
                ],
                ["doc_id", "label", "ids", "feature_values"],
            )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "ids"]).drop_duplicates("doc_id")
        pairs = [(np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<f4")) for a, b in zip(group["ids"], group["feature_values"])]
        model = fit(pairs, group["label"].to_numpy(np.float32))
        return pd.DataFrame([{"bias": model.bias, "weights": model.weights.tobytes(), "factors": model.factors.tobytes()}])

    featured = map_arrow(rows, one, "doc_id long, label int, ids binary, feature_values binary")
    found = featured.groupBy().applyInPandas(learn, "bias double, weights binary, factors binary").collect()
    if not found:
        return fit([], np.zeros(0, np.float32))
    return Machine(found[0]["bias"], np.frombuffer(found[0]["weights"], np.float32), np.frombuffer(found[0]["factors"], np.float32).reshape(-1, FACTORS))


def score(docs: DataFrame, model: Machine, metadata: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) of every text. The model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in flat_blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, j - i), pa.array(shared.value.score(*features(data, offsets, _of_batch(batch, metadata, i, j))), pa.float64())],
                ["doc_id", "score"],
            )

    return map_arrow(documents(docs, *_metadata(metadata)), one, "doc_id long, score double")


def accepted(docs: DataFrame, model: Machine, threshold: float = THRESHOLD, metadata: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose text scores at least the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in flat_blocks(batch.column("text")):
            keep = shared.value.score(*features(data, offsets, _of_batch(batch, metadata, i, j, ""))) >= threshold
            yield batch.slice(i, j - i).filter(pa.array(keep))

    return map_arrow(docs, one, docs.schema)


def labelled(labels: DataFrame, column: str = "quality") -> DataFrame:
    return labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, labelled(read(spark, sf_dir, "labels")), ~held_out(), metadata=METADATA)
    return score(docs, model, METADATA).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op9_quality_model": op9_quality_model}
