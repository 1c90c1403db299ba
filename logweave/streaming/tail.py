"""A streaming source over growing text files.

Spark's own file source reads a file once, when it appears. This one follows files: each batch holds the lines completed
since the last one. Offsets are sizes and live in the query's checkpoint; the driver lists files and opens none, executors
do the reading, in byte ranges. A line belongs to the range its newline is in, so what is incomplete waits by itself.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_SCHEMA = "file_path string, line_no bigint, value string"
_TAIL_BYTES = 1 << 16
_RANGE_BYTES = 64 << 20
_BATCH = 10_000


class _Files:
    """Listing and seeking on local paths and on whatever pyarrow has a file system for."""

    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix
        scheme = urlparse(root).scheme
        self.filesystem, self.inner = None, urlparse(root).path if scheme == "file" else root
        if scheme not in ("", "file"):
            from pyarrow import fs

            self.filesystem, self.inner = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))

    def sizes(self) -> dict[str, int]:
        if self.filesystem is None:
            found = glob.glob(os.path.join(glob.escape(self.inner), "**", f"*{self.suffix}"), recursive=True)
            return {path: os.path.getsize(path) for path in sorted(found)}
        from pyarrow import fs

        infos = self.filesystem.get_file_info(fs.FileSelector(self.inner, recursive=True))
        return {i.path: i.size for i in infos if i.is_file and i.path.endswith(self.suffix)}

    def open(self, path: str):
        return open(path, "rb") if self.filesystem is None else self.filesystem.open_input_file(path)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int):
        self.path, self.first, self.start, self.end = path, first, start, end


class TailReader(DataSourceStreamReader):
    """Offset: ``{path: bytes seen}``.

    ``only`` names the files to follow, others are not opened. ``maxbytes`` bounds what one batch adds to the offsets
    in ``consumed``, those of the query's last batch: small backlogs first, so that no file waits behind a large one.
    """

    def __init__(self, options: dict[str, str]):
        self.files = _Files(options["path"], options.get("suffix", ".log"))
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", _RANGE_BYTES)))
        only = options.get("only")
        self.only = None if only is None else set(json.loads(only))
        self.max_bytes = int(options.get("maxbytes", options.get("maxBytes", 0)))
        self.consumed = json.loads(options.get("consumed", "{}"))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        sizes = {p: n for p, n in self.files.sizes().items() if self.only is None or p in self.only}
        if not self.max_bytes:
            return sizes
        left, offset = self.max_bytes, {}
        # A file that shrank is read anew.
        new = {p: n - (self.consumed.get(p, 0) if self.consumed.get(p, 0) <= n else 0) for p, n in sizes.items()}
        for path in sorted(new, key=lambda p: (new[p], p)):
            take = min(new[path], left)
            left -= take
            reached = sizes[path] - new[path] + take
            if reached or path in self.consumed:
                offset[path] = reached
        return offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for path, stop in end.items():
            first = start.get(path, 0)
            if stop < first:
                first = 0  # the file was replaced by a shorter one
            for begin in range(first, stop, self.range_bytes):
                ranges.append(_Range(path, first, begin, min(begin + self.range_bytes, stop)))
        return ranges

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_path", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])
        with self.files.open(partition.path) as handle:
            position = _line_start(handle, partition.start)
            handle.seek(position)
            starts, values = [], []
            while True:
                line = handle.readline()
                # The newline decides: it must be there, and inside the range.
                if not line.endswith(b"\n") or position + len(line) > partition.end:
                    break
                starts.append(position)
                values.append(line.decode("utf-8", errors="replace").removesuffix("\n"))
                position += len(line)
                if len(values) >= _BATCH:
                    yield pa.record_batch([[partition.path] * len(values), starts, values], schema=schema)
                    starts, values = [], []
            if values:
                yield pa.record_batch([[partition.path] * len(values), starts, values], schema=schema)

    def commit(self, end: dict) -> None:
        return None


def _line_start(handle, position: int) -> int:
    """Where the line that holds the byte at ``position`` begins."""
    while position > 0:
        start = max(0, position - _TAIL_BYTES)
        handle.seek(start)
        at = handle.read(position - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        position = start
    return 0


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


def stream_log_tail(
    spark: SparkSession,
    root: str,
    suffix: str = ".log",
    range_bytes: int = _RANGE_BYTES,
    only: Sequence[str] | None = None,
    max_bytes: int = 0,
    checkpoint: str | None = None,
):
    """``(file_path, line_no, value)`` of new complete lines; ``line_no`` is the byte a line starts at.

    ``only`` are paths as the listing gives them. With ``max_bytes`` a batch adds no more than so many bytes to what the
    query of ``checkpoint`` has seen; start the query again for the next ones (``start_incremental`` does).
    """
    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("log_tail").option("path", root).option("suffix", suffix).option("rangeBytes", str(range_bytes))
    if only is not None:
        reader = reader.option("only", json.dumps(sorted(only)))
    if max_bytes:
        reader = reader.option("maxBytes", str(max_bytes)).option("consumed", json.dumps(consumed_offsets(spark, checkpoint)))
    return reader.load()


def consumed_offsets(spark: SparkSession, checkpoint: str) -> dict[str, int]:
    """Offsets of the last batch a query has planned, from its checkpoint."""
    try:
        logged = spark.read.text(f"{checkpoint}/offsets").select(
            F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)$", 1).cast("bigint").alias("batch"), "value"
        )
        last = logged.where(F.col("value").startswith("{") & ~F.col("value").contains("batchWatermarkMs")).agg(F.max_by("value", "batch")).first()[0]
    except AnalysisException:
        return {}
    return json.loads(last) if last else {}


def backlog(files: dict[str, int], consumed: dict[str, int]) -> int:
    """Bytes that a query has not seen."""
    return sum(n - (consumed.get(p, 0) if consumed.get(p, 0) <= n else 0) for p, n in files.items())


def listed_sizes(root: str, suffix: str = ".log", only: Sequence[str] | None = None) -> dict[str, int]:
    """Files the source would follow, with their sizes."""
    wanted = None if only is None else set(only)
    return {p: n for p, n in _Files(root, suffix).sizes().items() if wanted is None or p in wanted}
