"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct lower-cased words and their beginnings of four and five bytes, hashed into buckets.
Of the buckets those that tell the labels apart best (chi-square over the labelled sample) are features. The machine adds
linear weights and, through a short vector per feature, a weight for each pair of features: an insult beside a mention of
a group can weigh more than both alone.

Defined cases: null and empty texts have no terms and get the machine's bias as score; without usable labels every score
is 0.5; repeated terms count once; rows repeat as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.learn import labelled_sample
from logweave.llm.text import LOWER, byte_class, flat, map_arrow, prefix_hashes, record, slice_hashes, word_bounds
from logweave.session import materialize

# Labelled documents the machine is fitted on, at most about; buckets of the hash; features kept; length of a vector.
SAMPLE_ROWS = 20_000
BUCKET_BITS = 18
FEATURES = 4096
FACTORS = 8
EPOCHS, BATCH, RATE, RIDGE = 40, 256, 0.1, 1e-4
THRESHOLD = 0.7
_LOWER = np.frombuffer(LOWER, np.uint8)
_WORD = byte_class(lambda b: 97 <= b <= 122 or 48 <= b <= 57 or b >= 128)


def term_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text, bucket)`` of the distinct terms of all texts, in order."""
    data, offsets = flat(column)
    low = _LOWER[data]
    starts, ends, first = word_bounds(_WORD[low], offsets)
    hashes, down = prefix_hashes(low)
    owner = np.repeat(np.arange(len(column)), np.diff(first))
    parts, owners = [slice_hashes(hashes, down, starts, ends)], [owner]
    for length in (4, 5):
        longer = ends - starts > length
        begin = starts[longer]
        parts.append(slice_hashes(hashes, down, begin, begin + length) ^ np.uint64(length))
        owners.append(owner[longer])
    bucket = np.concatenate(parts) & np.uint64((1 << BUCKET_BITS) - 1)
    keys = np.unique(np.concatenate(owners).astype(np.int64) << BUCKET_BITS | bucket.astype(np.int64))
    return keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)


class Machine:
    """Bias, weights and vectors of the features, and the feature of each bucket (-1: none)."""

    def __init__(self, bias: float, weights: np.ndarray, vectors: np.ndarray, feature: np.ndarray):
        self.bias, self.weights, self.vectors, self.feature = bias, weights, vectors, feature

    def score(self, text: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        feature = self.feature[bucket]
        known = feature >= 0
        text, feature = text[known], feature[known]
        margin = self.bias + np.bincount(text, self.weights[feature], texts)
        for column in self.vectors.T:
            values = column[feature]
            margin += (np.bincount(text, values, texts) ** 2 - np.bincount(text, values**2, texts)) / 2
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def fit(rows: list[np.ndarray], labels: np.ndarray, feature: np.ndarray, width: int) -> Machine:
    """Adagrad on the logistic loss; ``rows`` are feature numbers of each labelled text."""
    rng = np.random.default_rng(7)
    weights, vectors = np.zeros(width), rng.normal(0, 0.02, (width, FACTORS))
    n = len(rows)
    mean = (labels.sum() + 0.5) / (n + 1) if n else 0.5
    bias = float(np.log(mean / (1 - mean)))
    if n == 0 or width == 0:
        return Machine(bias, weights, vectors, feature)
    seen_w, seen_v, seen_b = np.full(width, 1e-2), np.full((width, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            batch = order[low : low + BATCH]
            sizes = [len(rows[i]) for i in batch]
            f = np.concatenate([rows[i] for i in batch])
            t = np.repeat(np.arange(len(batch)), sizes)
            sums = np.zeros((len(batch), FACTORS))
            np.add.at(sums, t, vectors[f])
            squares = np.bincount(t, (vectors[f] ** 2).sum(axis=1), len(batch))
            margin = bias + np.bincount(t, weights[f], len(batch)) + ((sums**2).sum(axis=1) - squares) / 2
            error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels[batch]) / len(batch) * 16
            used, place = np.unique(f, return_inverse=True)
            g_w = np.bincount(place, error[t], len(used)) + RIDGE * weights[used]
            g_v = np.zeros((len(used), FACTORS))
            np.add.at(g_v, place, error[t][:, None] * (sums[t] - vectors[f]))
            g_v += RIDGE * vectors[used]
            seen_w[used] += g_w**2
            seen_v[used] += g_v**2
            weights[used] -= RATE * g_w / np.sqrt(seen_w[used])
            vectors[used] -= RATE / 2 * g_v / np.sqrt(seen_v[used])
            g_b = error.mean()
            seen_b += g_b**2
            bias -= RATE * g_b / np.sqrt(seen_b)
    return Machine(float(bias), weights, vectors, feature)


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    held_out: Column,
    text: str = "text",
    key: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
) -> Machine:
    """A machine from about ``sample_rows`` labelled documents outside ``held_out``.

    Bucket counts are summed by Spark; the driver gets one row per bucket and the chosen features of the sample.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, bucket = term_buckets(batch.column(1))
        ends = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        buckets = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
        return record(key=batch.column(0), buckets=buckets)

    schema = f"key {dict(docs.dtypes)[key]}, buckets array<int>"
    sample = materialize(
        labelled_sample(docs, labels, label, held_out, sample_rows, run, schema, "buckets", text, key), "terms"
    )
    counts = sample.select("label", F.explode("buckets").alias("bucket")).groupBy("bucket")
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).toPandas().sort_values("bucket")
    sizes = sample.groupBy("label").count().toPandas().set_index("label")["count"]
    positives, total = float(sizes.get(1, 0)), float(sizes.sum())
    n, pos, bucket = (counts[c].to_numpy(float) for c in ("n", "pos", "bucket"))
    share = positives / max(total, 1)
    spread = n * share * (1 - share) * (1 - n / max(total + 1, 1))
    chi = np.where((n >= 3) & (spread > 0), (pos - n * share) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    best = best[chi[best] > 4]
    feature = np.full(1 << BUCKET_BITS, -1, np.int64)
    feature[bucket[best].astype(np.int64)] = np.arange(len(best))
    shared = docs.sparkSession.sparkContext.broadcast(feature)

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2).to_pylist()
        picked = [(f := shared.value[np.array(x or [], np.int64)])[f >= 0].tolist() for x in lists]
        return record(key=batch.column(0), label=batch.column(1), features=pa.array(picked, pa.list_(pa.int32())))

    chosen = map_arrow(sample, choose, f"key {dict(docs.dtypes)[key]}, label int, features array<int>")
    found = chosen.toPandas().sort_values(["key", "label"])
    rows = [np.array(x, np.int64) for x in found["features"]]
    return fit(rows, found["label"].to_numpy(float), feature, len(best))


def score(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, bucket = term_buckets(batch.column(1))
        return record(key=batch.column(0), score=shared.value.score(owner, bucket, batch.num_rows))

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_arrow(source, run, f"key {dict(docs.dtypes)[key]}, score double").withColumnRenamed("key", key)


def drop_toxic(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, unchanged; each batch is filtered where it is read."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, bucket = term_buckets(batch.column(batch.schema.names.index(text)))
        return batch.filter(pa.array(shared.value.score(owner, bucket, batch.num_rows) < threshold))

    return map_arrow(docs, run, docs.schema, column=text)
