"""Text quality by histogram gradient-boosted trees over document statistics.

Statistics of a text are counts of byte classes, words and lines, all from whole texts in numpy. Trees are grown on binned
statistics of a bounded labelled sample: per level one histogram of gradients for all nodes, statistics and bins. The
finished forest is a complete binary tree per row of three arrays (statistic, threshold, leaf), so that scoring walks all
trees of all texts at once, level by level.

Defined cases: null and empty texts have all-zero statistics and get the score of such a text; without usable labels
every score is 0.5; rows repeat as they come; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.learn import labelled_sample
from logweave.llm.text import SPACES, byte_class, flat, map_arrow, prefix_hashes, record, slice_hashes, word_bounds

# Labelled documents the trees are fitted on, at most about.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, RIDGE = 60, 4, 64, 0.2, 5.0, 1.0
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes log_words mean_word upper digits spaces lines_share high_bytes marks exclaims bars symbols stops commas "
    "top_mark entropy distinct_words long_words short_words plain_words mean_line distinct_lines"
).split()
_SPACE = byte_class(lambda b: b in SPACES)
_CLASSES = {
    "upper": byte_class(lambda b: 65 <= b <= 90),
    "lower": byte_class(lambda b: 97 <= b <= 122),
    "digits": byte_class(lambda b: 48 <= b <= 57),
    "spaces": _SPACE,
    "lines": byte_class(lambda b: b == 10),
    "high": byte_class(lambda b: b >= 128),
    "marks": byte_class(lambda b: 33 <= b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 127),
    "exclaims": byte_class(lambda b: b in b"!?"),
    "bars": byte_class(lambda b: b in b"|/\\<>{}[]"),
    "symbols": byte_class(lambda b: b in b"#$%&*+=@^_~"),
    "stops": byte_class(lambda b: b in b".:;"),
    "commas": byte_class(lambda b: b == 44),
}


def _distinct(owner: np.ndarray, hashes: np.ndarray, owners: int) -> np.ndarray:
    """Number of different hashes per owner; 40 bits of a hash are compared."""
    keys = np.unique(owner.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    return np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=owners)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS per text."""
    data, offsets = flat(column)
    n = len(column)
    size = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    total = {name: counts @ chosen for name, chosen in _CLASSES.items()}
    per_byte = 1 / np.maximum(size, 1)
    share = counts * per_byte[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    hashes, down = prefix_hashes(data)
    starts, ends, first = word_bounds(~_SPACE[data], offsets)
    words = np.diff(first).astype(float)
    per_word = 1 / np.maximum(words, 1)
    word_owner = np.repeat(np.arange(n), np.diff(first))
    lengths = ends - starts
    letters = np.append(0, np.cumsum(_CLASSES["marks"][data]))
    plain = letters[ends] == letters[starts]
    line_starts, line_ends, line_first = word_bounds(data != 10, offsets)
    lines = np.diff(line_first).astype(float)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))
    columns = [
        np.log1p(size),
        np.log1p(words),
        np.bincount(word_owner, lengths, n) * per_word,
        total["upper"] / np.maximum(total["upper"] + total["lower"], 1),
        *(total[c] * per_byte for c in ("digits", "spaces", "lines", "high", "marks", "exclaims", "bars", "symbols")),
        total["stops"] * per_word,
        total["commas"] * per_word,
        (counts * _CLASSES["marks"]).max(axis=1, initial=0) * per_byte,
        entropy,
        _distinct(word_owner, slice_hashes(hashes, down, starts, ends), n) * per_word,
        np.bincount(word_owner, lengths > 12, n) * per_word,
        np.bincount(word_owner, lengths <= 3, n) * per_word,
        np.bincount(word_owner, plain, n) * per_word,
        np.log1p(np.bincount(line_owner, line_ends - line_starts, n) / np.maximum(lines, 1)),
        _distinct(line_owner, slice_hashes(hashes, down, line_starts, line_ends), n) / np.maximum(lines, 1),
    ]
    return np.column_stack(columns) if n else np.zeros((0, len(STATISTICS)))


class Forest:
    """Boosted trees as three arrays: statistic and threshold per inner node, value per leaf."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, rows: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(rows), trees), np.int64)
        each, tree = np.arange(len(rows))[:, None], np.arange(trees)
        while inner:
            right = rows[each, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
            inner //= 2
        margin = self.base + self.leaf[tree, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Grow the forest level by level on binned statistics (logistic loss, second order)."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature = np.zeros((TREES, inner), np.int64)
    threshold = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, leaves))
    n, width = rows.shape if len(rows) else (0, len(STATISTICS))
    mean = labels.mean() if n else 0.5
    if n == 0 or mean in (0.0, 1.0):
        return Forest(float(np.log((n * mean + 1) / (n * (1 - mean) + 1))), feature, threshold, leaf)
    edges = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    bins = np.column_stack([np.searchsorted(edges[:, j], rows[:, j], side="left") for j in range(width)])
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    cells = np.arange(width) * BINS + bins
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = p - labels, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            count = 1 << level
            at = ((node - count + 1)[:, None] * (width * BINS) + cells).ravel()
            shape, size = (count, width, BINS), count * width * BINS
            g = np.bincount(at, np.repeat(gradient, width), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(at, np.repeat(weight, width), size).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[..., -1:], h[..., -1:]
            gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
            allowed = (h >= LEAST_WEIGHT) & (all_h - h >= LEAST_WEIGHT)
            allowed[..., -1] = False
            gain = np.where(allowed, gain, 0).reshape(count, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(count), best] > 1e-6
            f, b = best // BINS, best % BINS
            places = np.arange(count) + count - 1
            feature[t, places] = f
            # A node without a useful split sends everything to the left.
            threshold[t, places] = np.where(split, edges[np.minimum(b, BINS - 2), f], np.inf)
            right = rows[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right
        node -= inner
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
        leaf[t] = -RATE * g / (h + RIDGE)
        margin += leaf[t][node]
    return Forest(base, feature, threshold, leaf)


def _key_text(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    held_out: Column,
    text: str = "text",
    key: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
) -> Forest:
    """A forest from about ``sample_rows`` labelled documents outside ``held_out``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = statistics(batch.column(1))
        ends = pa.array(np.arange(len(made) + 1) * made.shape[1], pa.int32())
        return record(key=batch.column(0), stats=pa.ListArray.from_arrays(ends, pa.array(made.ravel())))

    schema = f"key {dict(docs.dtypes)[key]}, stats array<double>"
    sample = labelled_sample(docs, labels, label, held_out, sample_rows, run, schema, "stats", text, key)
    found = sample.select("key", "label", "stats").toPandas().sort_values(["key", "label"])
    rows = np.array(found["stats"].tolist(), float).reshape(len(found), len(STATISTICS))
    return fit(rows, found["label"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return record(key=batch.column(0), score=shared.value.score(statistics(batch.column(1))))

    made = map_arrow(_key_text(docs, text, key), run, f"key {dict(docs.dtypes)[key]}, score double")
    return made.withColumnRenamed("key", key)
