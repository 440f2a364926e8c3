"""What the operators share: staged tables, and words and hashes of whole batches of texts.

Texts are tokenised with numpy over the UTF-8 buffer of an Arrow batch, a few
megabytes at a time, so that a worker's memory follows one slice (or the longest
single text), never its partition.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are tokenised at once.
SLICE_BYTES = 2 << 20

#: ASCII white space that ends a word.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="plinth-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plinth/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: a lost executor costs no earlier stage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trimmed(run):
    """A function for mapInArrow that gives its free memory back when a task ends: Python workers live on for other tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


# --- words and hashes -------------------------------------------------------------------------


@dataclass
class Words:
    """The words of consecutive texts: byte ranges in ``data``; ``first[i]:first[i + 1]`` are text i's words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.first[i], self.first[i + 1]
        return self.starts[lo:hi], self.ends[lo:hi]


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for runs of rows of about ``size`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lookup(separators: bytes) -> np.ndarray:
    """For each byte, whether it is part of a word."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    return inside


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of word bytes, never across two texts."""
    mask = inside[data]
    if not len(mask):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[edge] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return Words(data, starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers and a seed of the hashes below.
_ODD, _LENGTH, _SEED = np.uint64(0x9E3779B97F4A7C17), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x5851F42D4C957F2D)
#: Words of more bytes are hashed by hashlib, one by one.
LONG_WORD = 1024
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of what x is a hash of, followed by what y is a hash of. Every step is mixed, so regular texts don't cancel out."""
    return mix(x * _ODD + y)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash for each word: its bytes by eights, each mixed into those before."""
    size = words.ends - words.starts
    out = mix(size.astype(np.uint64) * _LENGTH + _SEED)
    if not len(size):
        return out
    padded = np.zeros(len(words.data) + 8, np.uint8)
    padded[: len(words.data)] = words.data
    eight = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))
    at, todo = 0, np.flatnonzero(size <= LONG_WORD)
    while len(todo):
        chunk = eight[words.starts[todo] + at] & _KEEP[np.minimum(size[todo] - at, 8)]
        out[todo] = joined(out[todo], chunk)
        at += 8
        todo = todo[size[todo] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(words.data[words.starts[i] : words.ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values, from runs of powers of two."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, size, out, done = values, 1, None, 0
    while True:
        if width & size:
            part = level[done : done + n]
            out = part if out is None else joined(out, part)
            done += size
        size *= 2
        if size > width:
            return mix(out ^ np.uint64(width))
        level = joined(level[: -size // 2], level[size // 2 :])


def normal_text(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the same words with one blank after each."""
    size = words.ends - words.starts
    starts = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    inside = np.repeat(words.starts - starts, size + 1) + np.arange(len(out))
    blank = starts + size
    inside[blank] = 0
    out[:] = words.data[inside] if len(out) else 0
    out[blank] = 0x20
    return out, starts, starts + size
