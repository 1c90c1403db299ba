"""Incremental parsing of growing files, with the day store as sink."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.enrich import enrich_records
from logweave.operators.events import parse_lines
from logweave.operators.storage import read_if_there, write_daily
from logweave.functions.regex import java_regex
from logweave.rules.origins import Origin
from logweave.session import materialize, sized_broadcast
from logweave.streaming.tail import backlog, consumed_offsets, listed_sizes, stream_log_tail

_LINES = "file_path string, line_no bigint, value string, held_since timestamp"


def split_open_events(lines: DataFrame, origin: Origin) -> tuple[DataFrame, DataFrame]:
    """(closed, open): from a file's last header on, lines may still belong to a growing event.

    Formats whose messages end with the header line have nothing to wait for.
    """
    if not origin.multiline or origin.body == "none":
        return lines, lines.limit(0)
    header = java_regex("|".join(f"(?:{p})" for _, p in origin.headers))
    last = lines.filter(F.col("value").rlike(header)).groupBy("file_path").agg(F.max("line_no").alias("__last"))
    marked = lines.join(sized_broadcast(last, "open-events"), "file_path", "left").withColumn("__open", F.coalesce(F.col("line_no") >= F.col("__last"), F.lit(False)))
    return marked.filter(~F.col("__open")).select(lines.columns), marked.filter("__open").select(lines.columns)


def _held(spark: SparkSession, state: str, batch_id: int) -> DataFrame | None:
    return read_if_there(spark, f"{state}/open/batch={batch_id}", "parquet", _LINES)


def to_records(lines: DataFrame, origin: Origin, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Enriched records and unmatched lines of one origin."""
    parsed = parse_lines(lines, origin)
    records = enrich_records(parsed.records, origin, year).withColumn("source_file", F.col("file_path"))
    return records, parsed.unmatched


def batch_writer(
    origin: Origin,
    store: str,
    state: str,
    year: int | None = None,
    queue: str | None = None,
    flush_after: float | None = None,
) -> Callable:
    """A ``foreachBatch`` function: hold the open event of each file, parse the rest, merge into the day store.

    What is held lies in the state folder under the batch's number, so repeating a batch reads the same input and
    writes the same output; the store's merge drops what is already there. Held lines are not consumed twice. Only the
    last two batches' folders are kept.

    ``flush_after`` seconds without a new line close a held event; lines that still follow have no header then.

    Held lines are a table and no keyed state on purpose: a keyed operator would bring all lines of a file to one task,
    while here they are parsed in ranges and only the last event of each file is carried.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        held = _held(spark, state, batch_id - 1)
        lines = materialize(batch.select("file_path", "line_no", "value"), "stream-lines")
        closed, still_open = [], None
        if held is None:
            waiting, lines_now = None, lines
        else:
            # Files without a new line keep their event as it is, with the time it was last seen growing.
            grown = lines.select("file_path").distinct()
            waiting = held.join(grown, "file_path", "left_anti")
            # What was held is little; the new lines are stored already and not written again beside it.
            lines_now = materialize(held.join(grown, "file_path", "left_semi").select(lines.columns), "stream-held").unionByName(lines)
        done, still_open = split_open_events(lines_now, origin)
        closed.append(done)
        still_open = still_open.withColumn("held_since", F.current_timestamp())
        if waiting is not None:
            if flush_after is not None:
                idle = F.col("held_since") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(flush_after)))
                closed.append(waiting.where(idle).select(lines.columns))
                waiting = waiting.where(~idle)
            still_open = still_open.unionByName(waiting)
        records, unmatched = to_records(materialize(reduce(DataFrame.unionByName, closed), "stream-closed"), origin, year)
        write_daily(materialize(records, "stream-records"), store)
        if queue is not None:
            unmatched.write.mode("overwrite").parquet(f"{queue}/batch={batch_id}")
        still_open.write.mode("overwrite").parquet(f"{state}/open/batch={batch_id}")
        _forget(spark, state, batch_id - 1)

    return run


def _forget(spark: SparkSession, state: str, before: int) -> None:
    """Remove what batches before one have held: a batch that is repeated needs the one before it only."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/open")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch=") and int(name.removeprefix("batch=")) < before:
            files.delete(status.getPath(), True)


def flush_open(spark: SparkSession, origin: Origin, store: str, state: str, batch_id: int, year: int | None = None) -> None:
    """Write the events still held after a batch, for files known to be complete."""
    held = _held(spark, state, batch_id)
    if held is not None:
        write_daily(materialize(to_records(held.drop("held_since"), origin, year)[0], "flushed-records"), store)


def start_incremental(
    stream: DataFrame,
    origin: Origin,
    store: str,
    state: str,
    checkpoint: str,
    year: int | None = None,
    queue: str | None = None,
    flush_after: float | None = None,
):
    """Run over what is available now and stop; call again for what was appended since."""
    return (
        stream.writeStream.foreachBatch(batch_writer(origin, store, state, year, queue, flush_after))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow_tail(
    spark: SparkSession,
    root: str,
    origin: Origin,
    store: str,
    state: str,
    suffix: str = ".log",
    only: Sequence[str] | None = None,
    max_bytes: int = 0,
    **options,
) -> int:
    """Read all that files of one format have grown by, in batches of ``max_bytes``; returns how many batches ran.

    The query's checkpoint and what it holds lie below ``state``.
    """
    place, batches = state.rstrip("/"), 0
    while True:
        stream = stream_log_tail(spark, root, suffix, only=only, max_bytes=max_bytes, checkpoint=f"{place}/checkpoint")
        query = start_incremental(stream, origin, store, f"{place}/held", f"{place}/checkpoint", **options)
        query.awaitTermination()
        batches += len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
        sizes = listed_sizes(root, suffix, only)
        if not max_bytes or backlog(sizes, consumed_offsets(spark, f"{place}/checkpoint")) == 0:
            return batches
