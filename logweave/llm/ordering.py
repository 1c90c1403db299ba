"""Rows numbered in a global order without a window over all of them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import materialize

_PART = 33  # monotonically_increasing_id: the partition stands above this many bits


def number_rows(df: DataFrame, order: Sequence[str], number: str, label: str) -> DataFrame:
    """``df`` with ``number``: 0, 1, ... in the order of columns, nulls first.

    One range shuffle; what is written fixes the order. The offsets are one row per partition. The order must part rows
    finely enough for ranges of even size; give it a row id last where keys may be hot.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn(number, F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned(number, _PART)
    offsets, passed = [], 0
    for row in ordered.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect():
        offsets.append({"part": row["p"], "offset": passed})
        passed += row["n"]
    table = df.sparkSession.range(1).select(
        F.inline(F.from_json(F.lit(json.dumps(offsets)), "array<struct<part bigint, offset bigint>>"))
    )
    joined = ordered.join(F.broadcast(table), part == F.col("part"))
    rank = F.col(number).bitwiseAND(F.lit((1 << _PART) - 1))
    return joined.withColumn(number, F.col("offset") + rank).drop("part", "offset")
