"""Lines of log files packed in tar archives."""

from __future__ import annotations

import posixpath
import tarfile
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import materialize, sized_broadcast
from logweave.sources.files import relative_to

SUFFIXES = (".tbz2", ".tar.bz2", ".tar.gz", ".tgz")
_BATCH = 50_000
TASKS_PER_CORE = 16
_SCHEMA = "archive string, rel_path string, line_no bigint, value string"


def _open(path: str):
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return open(parsed.path if parsed.scheme else path, "rb")
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return filesystem.open_input_stream(inner)


def _members(archive: str, rel_path: str) -> Iterator[tuple[str, int, str]]:
    folder = posixpath.dirname(rel_path)
    with _open(archive) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for member in tar:
            if not member.isfile():
                continue
            target = posixpath.join(folder, posixpath.basename(member.name))
            for number, line in enumerate(tar.extractfile(member), start=1):
                yield target, number, line.decode("utf-8", errors="replace").removesuffix("\n")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "rel_path", "line_no", "value"]
    for batch in batches:
        for archive, rel_path in zip(batch["path"], batch["rel_path"], strict=True):
            rows = []
            for target, number, line in _members(archive, rel_path):
                rows.append((archive, target, number, line))
                if len(rows) >= _BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def _archives(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{tbz2,tar.bz2,tar.gz,tgz}")
        .load(root)
        .select("path", relative_to(root, F.col("path")).alias("rel_path"))
    )


def has_archives(spark: SparkSession, root: str) -> bool:
    return not _archives(spark, root).isEmpty()


def read_archived_logs(spark: SparkSession, root: str, existing: DataFrame | None = None) -> DataFrame:
    """Lines of every regular archive member, named after the archive's folder.

    Archives are streamed, one task each (a compressed stream cannot be split); nothing is held whole. Members whose
    ``rel_path`` is in ``existing`` are left out; of equal names within the archives the first archive's member counts.
    """
    # Unpacked once into the shared folder: a compressed stream is not read again for every use.
    archives = _archives(spark, root)
    # A given number of tasks: paths are so few bytes that adaptive execution would unpack all archives in one.
    tasks = max(1, min(archives.count(), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    lines = materialize(archives.repartition(tasks, "path").mapInPandas(_unpack, _SCHEMA), "archive-lines")
    # Names are made distinct first, by hash: the least of texts sorts what it reads, and these are all lines.
    members = materialize(lines.select("archive", "rel_path").distinct(), "archive-members")
    owners = members.groupBy("rel_path").agg(F.min("archive").alias("archive"))
    lines = lines.join(sized_broadcast(owners, "archive-owners"), ["archive", "rel_path"], "left_semi")
    if existing is not None:
        lines = lines.join(existing.select("rel_path").distinct(), "rel_path", "left_anti")
    return lines
