"""Numpy kernels on the byte buffers of Arrow string columns.

They run inside Spark tasks (mapInArrow); a batch is cut into slices of whole rows, so that memory follows the
slice and not the batch.  A single very long text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20
#: The white space of all contracts here: [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs without white space), and each row's first word number."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))  # fmt: skip  # the fixed primes of XXH64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges at once: ranges of one length are hashed together; lengths over 256 one by one."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    four = np.ndarray((len(buf) + 1,), "<u4", padded.data, strides=(1,))
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, 257).astype(np.uint16), kind="stable")
    sizes = np.bincount(np.minimum(lengths, 257))
    done = 0
    with np.errstate(over="ignore"):
        for size in np.flatnonzero(sizes):
            rows = order[done : done + sizes[size]]
            done += sizes[size]
            if size == 257:
                raw = buf.tobytes()
                out[rows] = [xxhash.xxh64_intdigest(raw[starts[i] : ends[i]], seed) for i in rows]
                continue
            at, size = starts[rows], int(size)
            left = size
            s = np.uint64(seed)
            if size >= 32:
                v = [np.full(len(rows), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
                while left >= 32:
                    v = [_round(x, eight[at + 8 * k]) for k, x in enumerate(v)]
                    at, left = at + 32, left - 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _round(np.uint64(0), x)) * _P1 + _P4
            else:
                h = np.full(len(rows), s + _P5, np.uint64)
            h += np.uint64(size)
            while left >= 8:
                h = _rotl(h ^ _round(np.uint64(0), eight[at]), 27) * _P1 + _P4
                at, left = at + 8, left - 8
            if left >= 4:
                h = _rotl(h ^ (four[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
                at, left = at + 4, left - 4
            while left:
                h = _rotl(h ^ (padded[at].astype(np.uint64) * _P5), 11) * _P1
                at, left = at + 1, left - 1
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
            out[rows] = h
    return out


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def squeeze(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space between neighbours, and where they start and end there."""
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - (lengths + 1)
    total = int(lengths.sum() + len(lengths))
    if total == 0:
        return np.zeros(0, np.uint8), to, to
    src = np.arange(total) + np.repeat(starts - to, lengths + 1)
    out = np.concatenate([buf, [np.uint8(32)]])[np.minimum(src, len(buf))]
    out[to + lengths] = 32
    return out, to, to + lengths


def bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row (``first``: its first hash and the end), how often each of the 64 bits is set.

    Eight bits at a time are added in the byte lanes of one word, over pieces of at most 255 hashes.
    """
    n = np.diff(first)
    out = np.zeros((len(n), 64), np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)
    piece_row = np.cumsum(pieces) - pieces
    nth = np.arange(pieces.sum()) - np.repeat(piece_row, pieces)
    piece_at = np.repeat(first[full], pieces) + 255 * nth
    h, lanes = h[: first[-1]], np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((h >> np.uint64(k)) & lanes, piece_at).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[full, k::8] = np.add.reduceat(sums, piece_row, axis=0, dtype=np.int64)
    return out


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """[n, 64] booleans to uint64; bit k of the word is column k."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)
