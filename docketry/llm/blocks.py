"""Texts as arrays: cut Arrow batches into blocks of bounded size and hash their words.

All texts of a block lie in one byte buffer. Words, their hashes and the hashes of
word windows are arrays over that buffer, so no step works word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from docketry.functions.process import per_process, release

# Bytes of text in a block. One text may be longer; it is then a block of its own.
BLOCK_BYTES = 2 << 20

_WORD_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xD6E8FEB86659FD93
_U64 = (1 << 64) - 1


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """`base**i` and `base**-i` modulo 2**64 for at least `i <= n`."""
    kept = per_process(("powers", base), dict)
    if len(kept.get("up", ())) <= n:
        size = max(n + 1, SEGMENT + 1)
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            kept[name] = np.multiply.accumulate(table)
    return kept["up"], kept["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a new array)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """One 64-bit code per byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed * 2 + 1))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions `start .. start + length - 1` of every pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


@dataclass
class Block:
    """Texts in one buffer: text `i` is `data[offsets[i]:offsets[i + 1]]`; rows of the batch it came from."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """A string column in blocks of about `size` bytes; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(ends, ends[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Block(raw[ends[at]:ends[to]], ends[at:to + 1] - ends[at], at)
        at = to
    release()


@dataclass
class Words:
    """Words of a block: byte range, row within the block, and a 64-bit hash each."""

    block: Block
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    counts: np.ndarray  # words of each row
    first: np.ndarray  # first word of each row

    def text(self, i: int, j: int) -> bytes:
        """Words `i .. j - 1`, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i:j], self.ends[i:j]))


def class_table(word_bytes: Callable[[int], bool]) -> np.ndarray:
    return np.array([word_bytes(b) for b in range(256)], bool)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


# Word classes of the contracts, as bytes of UTF-8: a byte of 128 and over belongs to a word.
NOT_SPACE = class_table(lambda b: b != 32 and not 9 <= b <= 13)
ALPHANUMERIC = class_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


def words(block: Block, kind: np.ndarray = NOT_SPACE, lower: bool = False, seed: int = 0) -> Words:
    """Cut the texts of a block into maximal runs of the bytes in `kind`."""
    data = lower_table()[block.data] if lower else block.data
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    edges = inside[1:] != inside[:-1]
    cut = block.offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    joined = cut[inside[cut] & inside[cut + 1]]  # two words that touch where texts meet
    starts = np.flatnonzero(edges & inside[1:])
    ends = np.flatnonzero(edges & ~inside[1:])
    if len(joined):
        starts = np.sort(np.concatenate([starts, joined]))
        ends = np.sort(np.concatenate([ends, joined]))
    hashed = span_hash(data, starts, ends, seed)
    bounds = np.searchsorted(starts, block.offsets)
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(block)), counts)
    return Words(block, data, starts, ends, row, hashed, counts, bounds[:-1])


# Bytes that are hashed at once, so that the numbers of a step stay in the processor's cache.
SEGMENT = 1 << 18


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, by prefix sums of a polynomial; ranges are sorted and do not overlap."""
    out, codes = np.empty(len(starts), np.uint64), byte_codes(seed)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        piece = data[base:ends[to - 1]]
        up, down = powers(_WORD_BASE, len(piece))
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(codes[piece] * up[: len(piece)], out=sums[1:])
        own = sums[ends[at:to] - base]
        own -= sums[starts[at:to] - base]
        own *= down[starts[at:to] - base]
        out[at:to] = own
        at = to
    return mix(out)


def windows(hashed: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of `k` consecutive words; `len(hashed) - k + 1` of them, across rows too."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(_WINDOW_BASE, len(hashed))
    sums = np.zeros(len(hashed) + 1, np.uint64)
    np.cumsum(hashed * up[: len(hashed)], out=sums[1:])
    out = sums[k:] - sums[:-k]
    out *= down[:n]
    return mix(out)


def window_starts(w: Words, k: int) -> np.ndarray:
    """The words at which a run of `k` words of one row starts."""
    n = len(w.hash) - k + 1
    return np.flatnonzero(w.row[:n] == w.row[k - 1:]) if n > 0 else np.empty(0, np.int64)


def spread_marks(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of `n` positions lie in one of the ranges."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


def map_rows(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`step` over whole rows of any column names; it sees the columns as `c0`, `c1` and so on."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(step, plain.schema).toDF(*df.columns)
