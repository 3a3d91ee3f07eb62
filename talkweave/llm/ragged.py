"""Words and shingles of whole Arrow columns as flat numpy arrays.

Words are runs of bytes other than space and 9-13, with A-Z lower-cased. They are named by 64-bit hashes, so equality
of words, shingles and sets below is equality of 64-bit hashes: the chance that two given different ones meet is 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20          # bytes of text worked on at once; a longer document is a slice of its own
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 5)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_GOLD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _GOLD)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if n <= SLICE:
        if kind not in _powers:
            _powers[kind] = np.concatenate([np.ones(1, U), np.full(SLICE, base)]).cumprod(dtype=U)
        return _powers[kind][:n]
    return np.concatenate([np.ones(1, U), np.full(n - 1, base)]).cumprod(dtype=U)


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) of runs of whole texts; row r of a run is ``bytes[bounds[r]:bounds[r + 1]]``. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield i, raw[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


class Words:
    """The words of a slice, in order: ``doc`` (row in the slice), ``start``, ``end`` (bytes), ``hash``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, punctuation: bool = True):
        """Without ``punctuation``, ASCII bytes other than letters and digits separate words too."""
        low = data.copy()
        low[(low >= 65) & (low <= 90)] += 32
        n = len(low)
        inside = ~((low == 32) | ((low >= 9) & (low <= 13)))
        if not punctuation:
            inside &= (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1] if n else inside
        after = np.concatenate([inside[1:], [False]]) & ~edge[1:] if n else inside
        self.low, self.bounds, self.docs = low, bounds, len(bounds) - 1
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(bounds, self.start, "right") - 1
        run = np.concatenate([np.zeros(1, U), (_BYTE[low] * _power("up", _BASE, n)).cumsum(dtype=U)])
        self.hash = mix((run[self.end] - run[self.start]) * _power("down", _INVERSE, n)[self.start] if n else np.empty(0, U))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.docs)

    def text(self, i: int) -> bytes:
        return self.low[self.start[i]:self.end[i]].tobytes()


def fold(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours."""
    n = max(0, len(hashes) - width + 1)
    out = mix(hashes[:n] + _GOLD)
    for j in range(1, width):
        out = mix(out * U(3) + hashes[j:j + n])
    return out


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of each document's distinct shingles, ordered by both. Fewer words than ``width`` make one shingle."""
    count = words.counts()
    full = fold(words.hash, width)
    home = words.doc[:len(full)]
    keep = home == words.doc[width - 1:] if len(full) else np.empty(0, bool)
    docs, hashes = [home[keep]], [full[keep]]
    first = np.concatenate([[0], count.cumsum()])
    for k in range(1, width):
        few = np.flatnonzero(count == k)
        if len(few):
            grid = words.hash[first[few][:, None] + np.arange(k)]
            out = mix(grid[:, 0] + _GOLD)
            for j in range(1, k):
                out = mix(out * U(3) + grid[:, j])
            docs.append(few)
            hashes.append(mix(out + U(k)))
    doc, value = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(value)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def sum_by(doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Wrapping sums of 64-bit values by document; ``doc`` ascends."""
    run = np.concatenate([np.zeros(1, U), value.cumsum(dtype=U)])
    at = np.searchsorted(doc, np.arange(docs + 1))
    return run[at[1:]] - run[at[:-1]]


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers as byte planes of the narrowest kind, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    if kind == bool:
        kind = np.dtype(np.uint8)
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T).tobytes()
    return bytes([kind.itemsize]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    """What ``packed`` took, as signed 64-bit integers (unsigned where they need all bits)."""
    size, n = data[0], int.from_bytes(data[1:9], "little")
    planes = pa.decompress(data[9:], n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).reshape(-1).view(f"u{size}").astype(np.int64)
