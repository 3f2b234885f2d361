"""Vectorised word splitting and hashing over Arrow columns of UTF-8 bytes.

Everything here works on one slice of a task's rows at a time, so memory follows the slice
(``SLICE_BYTES``) or the longest single text, never the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about this many bytes.
SLICE_BYTES = 1 << 20

#: Words of more bytes are hashed one by one with BLAKE2b.
LONG = 256

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first i bytes of eight.
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of some texts: byte offsets into ``data``; text i owns words first[i] to first[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def texts(self) -> int:
        return len(self.first) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def eights(self, lower: bool = False) -> np.ndarray:
        """The eight bytes from each byte on as one number (zeros behind the end)."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = _LOWER[self.data] if lower else self.data
        return np.ndarray(len(self.data) + 1, "<u8", data, strides=(1,))

    def hashes(self, most: int | None = None, lower: bool = False, seed: int = 0, eights: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``most`` bytes: every eight bytes are mixed in by a nonlinear step."""
        eights = self.eights(lower) if eights is None else eights
        size = self.end - self.start if most is None else np.minimum(self.end - self.start, most)
        out = mix(size.astype(_U) * _BASE + _U(seed))
        large, left, at = np.flatnonzero(size > LONG), np.flatnonzero(size <= LONG), 0
        while len(left):
            part = eights[self.start[left] + at] & _HEAD[np.minimum(size[left] - at, 8)]
            out[left] = mix(out[left] ^ part)
            at += 8
            left = left[size[left] > at]
        for i in large.tolist():
            word = self.data[self.start[i] : self.start[i] + size[i]]
            out[i] = int.from_bytes(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
        return out


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large binary; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    return column.fill_null(b"") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a large binary array, without copying."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(rows: int, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes, a longer text alone."""
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, rows)
        at = min(to, rows)


def split(column: pa.Array, separators: np.ndarray = _SPACE) -> Words:
    """Words of each text: the longest runs of bytes that are no separators."""
    data, offsets = raw(column)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(separators[data], out=inside[1:-1])
    bound = np.zeros(len(data) + 1, bool)  # a text starts at byte i
    bound[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | bound[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | bound[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, offsets).astype(np.int64), offsets)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a ^ _U(0xD6E8FEB86659FD93)) * _BASE + b)


def runs(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive hashes, from hashes of runs of 1, 2, 4, ... of them."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, at, size, power = None, 0, 1, values
    while True:
        if length & size:
            out = power[at : at + n] if out is None else _joined(out, power[at : at + n])
            at += size
        if 2 * size > length:
            return out if length > 1 else mix(out)
        power = _joined(power[:-size], power[size:])
        size *= 2


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each given range of hashes; in as many steps as the longest range is long."""
    out = mix((end - start).astype(_U))
    left, at = np.flatnonzero(end > start), 0
    while len(left):
        out[left] = _joined(out[left], values[start[left] + at])
        at += 1
        left = left[end[left] - start[left] > at]
    return out


class Table:
    """Values by 64-bit key, for keys that are all known: open addressing over arrays (no key is all ones)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift = _U(64 - bits)
        self.keys, self.values = np.full(1 << bits, ~_U(0), _U), np.zeros(1 << bits, values.dtype)
        place, left = self._place(keys), np.arange(len(keys))
        while len(left):
            at = place[left]
            free = self.keys[at] == ~_U(0)
            self.keys[at[free]] = keys[left[free]]
            own = self.keys[at] == keys[left]
            self.values[at[own]] = values[left[own]]
            left = left[~own]
            place[left] = (place[left] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _BASE >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        place = self._place(keys)
        found = self.values[place]
        left = np.flatnonzero(self.keys[place] != keys)
        while len(left):
            place[left] = (place[left] + 1) & (len(self.keys) - 1)
            own = self.keys[place[left]] == keys[left]
            found[left[own]] = self.values[place[left[own]]]
            left = left[~own]
        return found
