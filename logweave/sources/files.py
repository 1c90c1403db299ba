"""Log files as DataFrames: listing, lines and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.session import materialize, sized_broadcast


def relative_to(root: str, path: Column) -> Column:
    """The part of a path below ``root``, with or without a scheme in front."""
    tail = root.rstrip("/").split("://", 1)[-1]
    return F.regexp_replace(path, r"^.*?\Q" + tail + r"\E/+", "")


def scan_log_files(
    spark: SparkSession, root: str, suffix: str = ".log", exclude_prefix: str | None = None
) -> DataFrame:
    """Recursive listing by suffix; contents are never read."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(root)
        .select(
            "path",
            relative_to(root, F.col("path")).alias("rel_path"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("mtime"),
        )
    )
    if exclude_prefix:
        listing = listing.filter(~F.col("rel_path").startswith(exclude_prefix))
    return listing


def read_log_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``(file_path, line_no, value)``, split at newlines only, numbered from 1 within each file.

    A file may be cut into many splits, and where it is cut is decided anew for each scan. So the files are scanned once:
    the rows are written with the split they came from and their order in it, and numbers come from that copy. A row's
    number is its distance to the split's first row plus the rows of the file's earlier splits: one small table of splits
    replaces a shuffle of all lines.
    """
    # The reader knows the byte range of each split; ids grow by one per row within a task.
    rows = materialize(
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row_id"),
            "value",
        ),
        "scanned-lines",
    )
    splits = rows.groupBy("file_path", "split_start").agg(
        F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")
    )
    earlier = W.partitionBy("file_path").orderBy("split_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select(
        "file_path", "split_start", "first_id", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("before")
    )
    line_no = F.col("before") + F.col("row_id") - F.col("first_id") + 1
    return rows.join(sized_broadcast(offsets, "line-splits"), ["file_path", "split_start"]).select(
        "file_path", line_no.alias("line_no"), "value"
    )


def sample_lines(lines: DataFrame, n: int = 500, seed: int | None = None) -> DataFrame:
    """``n`` random non-blank lines; with a seed the choice depends on the lines alone and can be repeated."""
    filled = lines.filter(F.trim("value") != "")
    if seed is None:
        return filled.orderBy(F.rand()).limit(n)
    keys = [c for c in ("file_path", "file", "line_no") if c in lines.columns]
    return filled.orderBy(F.xxhash64(F.lit(seed), "value", *keys), *keys).limit(n)
