"""Helpers the text operators share: Arrow batches as flat bytes, words as hashes, folds of labelled rows.

Texts reach numpy as one byte array with offsets, so that work on words costs no Python object per word. A batch is cut
into pieces of bounded size; a single text longer than a piece is a piece of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PIECE_BYTES = 1 << 19
# Rows of an Arrow batch, where the session has Spark's default: 10,000 whole texts at once need much memory beside the heap.
BATCH_ROWS, _BATCH_KEY, _DEFAULT_ROWS = 500, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
# Words of more bytes are hashed whole.
LONG_WORD = 256
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER, np.uint8)


def fold(column: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``; rows without an id are in no such fold."""
    rest = F.crc32(F.col(column).cast("string").cast("binary")) % modulus
    return F.coalesce(rest == remainder, F.lit(False))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS, where the session has Spark's default size."""
    if spark.conf.get(_BATCH_KEY) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The allocator's own way to return free pages, where the C library has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Free memory goes back to the system: a Python worker lives on beside the heap and other stages' workers."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def map_arrow(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str | StructType,
    limit: int = PIECE_BYTES,
    column: str = "text",
) -> DataFrame:
    """``function`` on every Arrow batch, cut into pieces of ``limit`` bytes of ``column`` where it has one.

    A session with Spark's default batch size is set to BATCH_ROWS; another size stays as it is.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, limit):
                made = function(piece)
                if made is not None and made.num_rows:
                    yield made
            pa.default_memory_pool().release_unused()
        batch = piece = made = None
        give_back()

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have ``limit`` bytes at most, or one row each."""
    if column not in batch.schema.names or not batch.num_rows:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(low, high - low)
        low = high


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offset of each text in them; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of word bytes, and the first word of each text (with the number of words at the end).

    Words never cross from one text into the next.
    """
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:]
    starts = np.flatnonzero(opens)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


@lru_cache(maxsize=1)
def _hash_tables() -> tuple[np.ndarray, np.uint64, np.uint64]:
    table = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15
    return table, np.uint64(base), np.uint64(pow(base, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, base, inverse = _hash_tables()
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative polynomial hashes of a byte array and the inverse powers that shift a slice to its start."""
    table, _, _ = _hash_tables()
    n = max(PIECE_BYTES, 1 << int(len(data)).bit_length())
    up, down = _powers(n + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return total, down


def slice_hashes(total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices; equal slices have equal hashes wherever they stand."""
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def safe_hashes(data: np.ndarray, total: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``slice_hashes``, but of long slices the hash of their bytes: texts can be made on which a polynomial agrees."""
    hashes = slice_hashes(total, down, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return hashes


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and the first word of each text."""
    low = _LOWER[data]
    starts, ends, first = word_bounds(is_word[low], offsets)
    total, down = prefix_hashes(low)
    return safe_hashes(low, total, down, starts, ends), first


def byte_class(text_class: Callable[[int], bool]) -> np.ndarray:
    """A table over the 256 bytes."""
    return np.array([text_class(b) for b in range(256)])


def record(**columns) -> pa.RecordBatch:
    """A batch of the given arrays, in order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
