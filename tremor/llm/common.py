"""Shared helpers: stable byte-level hashing in numpy, folds, checkpoints.

Operators read only the columns they name, so extra columns (whatever they
are called) never reach them; temporary columns live in frames of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import cut_lineage

HELD_OUT_REMAINDER = 2          # fixed by the task: crc32(doc_id as text) mod 4
PIECE_BYTES = 1 << 20           # text handled at once inside a task
SLICE_ROWS = 1024               # rows held as Python objects at once
BROADCAST_ROWS = 1_000_000      # rows of a few longs sent to all tasks at most

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1     # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)

# words: [^\x20\x09-\x0D]+ after A-Z -> a-z
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SYMBOL = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from (crc32 of the id's text mod 4 is 2)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def reliable(df: DataFrame) -> DataFrame:
    """Write once into the shared checkpoint folder and read it from there."""
    return cut_lineage(df)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted),
    else as it is, for a shuffled join.  For narrow frames of ids only."""
    return F.broadcast(df) if df.count() <= rows else df


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(19, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            p = np.full(size, _P, np.uint64)
            p[0] = 1
            q = np.full(size, _PINV, np.uint64)
            q[0] = 1
            _powers[size] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers[size]


def narrow_batches(spark: SparkSession, rows: int = SLICE_ROWS) -> None:
    """Arrow batches of at most that many rows from here on in the session,
    unless it asks for fewer: whole texts make Spark's default of 10,000 rows
    tens of megabytes a task, in the JVM and again in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows (views), so that a task holds few texts as
    Python objects and hands its results on in small batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def pieces(texts: list[str | None], limit: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) in runs of about ``limit`` bytes;
    a text longer than that is a run of its own.  Lone surrogates cannot come
    from Parquet; they would be replaced."""
    start, out, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if out and size + len(b) > limit:
            yield start, out
            start, out, size = i, [], 0
        out.append(b)
        size += len(b)
    if out:
        yield start, out


class WordStream:
    """Words of many texts as one normalised byte stream with prefix hashes.

    ``start``/``end`` are word bounds in the stream, ``first`` the index of
    each text's first word (with a final total).  ``hash_spans`` hashes any
    run of words in O(1) from the prefix table, white space counting as one
    blank, so equal word sequences have equal hashes whatever separates them.
    """

    def __init__(self, texts: list[bytes], lower: bool = True):
        joined = np.frombuffer(b" " + b"\n".join(texts) + b" ", np.uint8)
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
        space = SPACE[joined]
        keep = ~space
        keep[1:] |= ~space[:-1]
        place = np.cumsum(keep)                     # stream position after each byte
        body = np.where(space, np.uint8(32), LOWER[joined] if lower else joined)[keep]
        blank = body == 32
        edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
        self.start = np.flatnonzero(edge[:-1] < 0)
        self.end = np.flatnonzero(edge[1:] > 0) + 1
        self.first = np.searchsorted(self.start, place[bounds - 1])
        up, down = _power_tables(len(body) + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_SYMBOL[body] * up[:len(body)], dtype=np.uint64)])
        self.down = down
        self.body = body

    def hash_spans(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """64-bit hashes of the word runs i..j (both inclusive)."""
        a, b = self.start[i], self.end[j]
        with np.errstate(over="ignore"):
            return mix64((self.prefix[b] - self.prefix[a]) * self.down[a])

    def words(self, k: int) -> tuple[int, int]:
        """First and one past the last word of text k."""
        return int(self.first[k]), int(self.first[k + 1])
