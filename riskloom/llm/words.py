"""Words, word hashes and shingles of whole text columns, computed by array arithmetic.

Texts stay in the UTF-8 buffer of an Arrow column.  Words are runs of bytes of a byte class;
since all separators used here are ASCII, byte runs and code point runs are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: bytes of text worked on at a time; one longer text is worked on alone
SLICE_BYTES = 2 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: byte class of words separated by white space: [^\x20\x09-\x0D]+
PLAIN = ~SPACE

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, size: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, kept for the next slice."""
    have = _powers.get(name)
    if have is None or len(have) < size:
        steps = np.full(max(1 << 16, 1 << (size - 1).bit_length()), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs run inside hand texts to Python workers in batches of at most so many rows, so both sides hold less of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of ``batch`` with at most ``most`` bytes of text, one row at least."""
    sizes = batch.column(column).fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset:][: len(sizes) + 1]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text begins and ends; null counts as empty."""
    plain = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(plain.buffers()[1], dtype=np.int64)[plain.offset:][: len(plain) + 1]
    data = plain.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; everything else stays."""
    return raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))


def word_bounds(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and text number of every word, in order."""
    within = inside[raw]
    after = np.zeros(len(raw) + 1, dtype=bool)
    after[1:] = within
    after[offsets] = False  # a text never goes on into the next one
    starts = np.flatnonzero(within & ~after[:-1])
    before = np.zeros(len(raw) + 1, dtype=bool)
    before[:-1] = within
    before[offsets] = False
    ends = np.flatnonzero(within & ~before[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every word."""
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table("up", _BASE, len(raw) + 1)[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table("down", _INVERSE, len(raw) + 1)[starts])


def shingles(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of ``k`` words within a text; a shorter text is one shingle."""
    n = len(hashes)
    out = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        out = mix(out * _BASE + hashes[j: j + len(out)])
    if n == 0:
        return out, owner
    whole = owner[: len(out)] == owner[k - 1:] if n >= k else np.zeros(0, dtype=bool)
    firsts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    sizes = np.diff(np.r_[firsts, n])
    short_hash, short_owner = [], []
    for first, size in zip(firsts[sizes < k], sizes[sizes < k], strict=True):
        h = np.full(1, size, dtype=np.uint64)
        for j in range(size):
            h = mix(h * _BASE + hashes[first + j: first + j + 1])
        short_hash.append(h[0])
        short_owner.append(owner[first])
    hashed = np.r_[out[whole], np.array(short_hash, dtype=np.uint64)]
    return hashed, np.r_[owner[: len(out)][whole], np.array(short_owner, dtype=owner.dtype)]
