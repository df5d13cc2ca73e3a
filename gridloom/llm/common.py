"""Shared pieces of the text operators: the workspace of an operator run and numpy kernels over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Largest table, in bytes, that is sent to every executor; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def fold_remainder(doc_id: Column, k: int = 5) -> Column:
    """crc32 of the id as text, modulo ``k``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(k)


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint behind a size check; ``rows`` is the counted number of rows of ``df``."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: Rows of whole texts that travel to a Python worker at a time; Spark's own default fits short rows.
TEXT_ROWS = 1000


def to_workers(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` over rows with whole texts, in small batches; memory goes back to the system at a task's end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(key)) > TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give freed memory back: Python workers outlive their task and share the executor's memory with the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Workspace:
    """Intermediate tables of one operator run, in the shared folder; dropped when no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch(spark, name), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once as Parquet and read it back: no recomputation, no lineage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this workspace that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._workspace_path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --- numpy kernels -------------------------------------------------------------------------------

LOW = np.arange(256, dtype=np.uint8)
LOW[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of letter words: every ASCII byte that is no letter.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64, at least ``n`` of them."""
    global _powers
    while len(_powers) < n:
        step = np.array([pow(int(BASE), len(_powers), 2**64)], dtype=np.uint64)
        _powers = np.concatenate([_powers, _powers * step])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19, docs: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes; nulls are empty.

    The bytes are views of the batch.
    """
    col = batch.column(batch.schema.get_field_index(column))
    col = pc.fill_null(col, "") if col.null_count else col
    n, width = len(col), np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=width)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + docs, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_hashes(b: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE, prefixes: tuple[int, ...] = (), fold: bool = True) -> tuple[np.ndarray, ...]:
    """Hashes of the words between separators, A-Z lower-cased if ``fold``, and where each text's words begin (one more at the end).

    Then, for each of ``prefixes``, the hashes of the words' first so many bytes, told apart from whole words.
    """
    none = np.zeros(0, np.uint64)
    if not len(b):
        return (none, np.zeros(len(offs), np.int64)) + (none,) * len(prefixes)
    gap = separators[b]
    edge = np.zeros(len(b) + 1, dtype=bool)
    edge[offs] = True
    word = ~gap
    before = edge[:-1].copy()
    before[0] = True
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[-1] = True
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(word & before)
    lens = np.flatnonzero(word & after) + 1 - starts
    first = np.searchsorted(starts, offs)
    if not len(starts):
        return (none, first) + (none,) * len(prefixes)
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    each = BYTE_VALUE[LOW[b[word]] if fold else b[word]] * powers(int(lens.max()))[place]
    h = mix(np.add.reduceat(each, at))
    cut = (mix(np.add.reduceat(np.where(place < k, each, np.uint64(0)), at) + np.uint64(k)) for k in prefixes)
    return h, first, *cut


class HashTable:
    """Open addressing over uint64 keys with vectorised look-ups."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2 + 1)))))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.used, self.values = np.zeros(size, np.uint64), np.zeros(size, bool), np.zeros(size, values.dtype)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            s = slot[left]
            free = ~self.used[s]
            _, one = np.unique(s[free], return_index=True)
            put = left[free][one]
            self.keys[slot[put]], self.used[slot[put]], self.values[slot[put]] = keys[put], True, values[put]
            left = left[(self.keys[s] != keys[left]) | ~self.used[s]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray, missing) -> np.ndarray:
        """Values of ``keys``; ``missing`` for those that are not there."""
        slot = self._slot(keys)
        found = self.keys[slot] == keys
        hit = found & self.used[slot]
        out = np.where(hit, self.values[slot], missing)
        left = np.flatnonzero(~hit & self.used[slot])
        at = slot[left]
        while len(left):
            at = (at + 1) & self.mask
            used, same = self.used[at], self.keys[at] == keys[left]
            got = used & same
            out[left[got]] = self.values[at[got]]
            go = used & ~same
            left, at = left[go], at[go]
        return out
