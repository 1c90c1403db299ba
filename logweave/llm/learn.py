"""Labelled samples of bounded size for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.text import map_arrow

_BUCKETS = 1 << 30


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    held_out: Column,
    rows: int,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    features: str,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``function`` (from ``key, text`` to ``key, features``) on about ``rows`` labelled documents, with their ``label``.

    Which ids are taken depends on a hash of the id alone; below ``rows`` labelled ids all are taken. ``held_out`` is an
    expression over the id. Labels other than 0 and 1, null labels and null ids are left out; an id with both labels
    counts once for each, and documents of the same id count once.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out)
    usable = usable.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    share = min(1.0, rows / max(1, usable.count()))
    taken = usable.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(_BUCKETS)) < int(share * _BUCKETS))
    # About ``rows`` pairs of id and label: the bound of this broadcast.
    joined = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(
        F.broadcast(taken.select("key").distinct()), "key"
    )
    made = map_arrow(joined, function, schema).groupBy("key").agg(F.max(features).alias(features))
    return made.join(F.broadcast(taken), "key").select("key", "label", features)
