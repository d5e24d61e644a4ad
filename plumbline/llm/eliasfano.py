"""Elias-Fano sequences over plain arrays, with vectorised access and successor search, and array files to map."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

U = np.uint64
#: Words of the upper bits between two counts of zeros (a power of two).
STRIDE = 8


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of whole numbers below universe."""
    n = len(values)
    width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    v = values.astype(U)
    high = (v >> U(width)).astype(np.int64)
    bits = high + np.arange(n)
    words = (n + (universe >> width) + 2 + 63) // 64 + 1
    upper = np.zeros(words, U)
    np.bitwise_or.at(upper, bits >> 6, U(1) << (bits & 63).astype(U))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper).astype(np.int64))])
    low = np.zeros((n * width + 63) // 64 + 2, U)
    if width and n:
        part = v & U((1 << width) - 1)
        at = np.arange(n, dtype=np.int64) * width
        shift = (at & 63).astype(U)
        np.bitwise_or.at(low, at >> 6, part << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (U(64) - shift[over]))
    return {"upper": upper, "ones": ones, "low": low, "shape": np.array([n, width], np.int64)}


#: Place of a byte's set bit by rank << 8 | byte.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[rank] for rank in range(8) for byte in range(256)], U)
_EACH_BYTE, _TOP_BITS = U(0x0101010101010101), U(0x8080808080808080)


def _select_in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit with this rank (from 0) in each word."""
    rank = rank.astype(U)
    # ones of each byte and of all bytes below it, in that byte
    ones = word - ((word >> U(1)) & U(0x5555555555555555))
    ones = (ones & U(0x3333333333333333)) + ((ones >> U(2)) & U(0x3333333333333333))
    ones = ((ones + (ones >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * _EACH_BYTE
    shift = np.bitwise_count((((rank * _EACH_BYTE) | _TOP_BITS) - ones) & _TOP_BITS).astype(U) << U(3)
    rank -= ((ones << U(8)) >> shift) & U(255)
    return (shift + _IN_BYTE[(rank << U(8)) | ((word >> shift) & U(255))]).astype(np.int64)


class EliasFano:
    """A sequence in its arrays, which may be mapped from a file."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.upper, self.ones, self.low = arrays["upper"], arrays["ones"], arrays["low"]
        self.n, self.width = (int(x) for x in arrays["shape"])
        #: Zeros before every STRIDE-th word: all that is held beside the mapped arrays.
        self.zeros = np.arange(0, len(self.upper), STRIDE, dtype=np.int64) * 64 - self.ones[:-1:STRIDE]

    def _word_of_zero(self, k: np.ndarray) -> np.ndarray:
        """The word of the upper bits that holds the k-th zero: zeros before a word are its bits less its ones."""
        if len(k) * 8 > len(self.upper):  # nearly all words are met: number the zeros before each
            return np.searchsorted(np.arange(0, len(self.upper) * 64, 64) - self.ones[:-1], k, side="right") - 1
        word, last = (np.searchsorted(self.zeros, k, side="right") - 1) * STRIDE, len(self.upper) - 1
        step = STRIDE >> 1
        while step:
            on = np.minimum(word + step, last)
            word = np.where(on * 64 - self.ones[on] <= k, on, word)
            step >>= 1
        return word

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the upper bits."""
        word = self._word_of_zero(k)
        return word * 64 + _select_in_word(~self.upper[word], k - (word * 64 - self.ones[word]))

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the first values whose high part is at least high, and more than that: the ones before zeros
        number high - 1 and high. Between these two there are only ones.
        """
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)
        shift = start & 63
        rest = self.upper[start >> 6] >> shift.astype(U)
        run = np.bitwise_count(rest & ~(rest + U(1))).astype(np.int64)
        first = start - high
        end = first + run
        on = np.flatnonzero(shift + run == 64)  # the ones go on in the next word
        if len(on):
            end[on] = self._zero(high[on]) - high[on]
        return first, end

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i * self.width
        word, shift = at >> 6, at.view(U) & U(63)
        value = self.low[word] >> shift
        word += 1
        over = self.low[word] << U(1)  # by 64 bits less the shift in all, of which none may be 64
        shift ^= U(63)
        over <<= shift
        value |= over
        value &= U((1 << self.width) - 1)
        return value

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at places: the i-th one of the upper bits, and the low bits."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.upper[word], i - self.ones[word])
        return ((place - i).astype(U) << U(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value >= x, and whether it equals x. Each value is searched once, in order."""
        x = x.astype(U)
        order = np.argsort(x)
        x = x[order]
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        place, equal = self._search(x[new])
        which = np.empty(len(x), np.int64)
        which[order] = np.cumsum(new) - 1
        return place[which], equal[which]

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = (x >> U(self.width)).astype(np.int64)
        want = x & U((1 << self.width) - 1)
        lo, end = self._bucket(high)
        hi = end.copy()
        rows = np.flatnonzero(lo < hi)
        while len(rows):  # binary search within buckets, over the rows that are still open
            a, b = lo[rows], hi[rows]
            middle = (a + b) >> 1
            less = self._low(middle) < want[rows]
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            lo[rows], hi[rows] = a, b
            rows = rows[a < b]
        equal = lo < end
        equal[equal] = self._low(lo[equal]) == want[equal]
        return lo, equal


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One file of named arrays, each at a multiple of 64 bytes."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = (a.dtype.str, a.shape, at)
        data = a.tobytes()
        data += b"\0" * (-len(data) % 64)
        parts.append(data)
        at += len(data)
    said = json.dumps(head).encode()
    said += b" " * (-(len(said) + 8) % 64)
    return b"".join([len(said).to_bytes(8, "little"), said, *parts])


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if path.startswith("/") else None


def put(path: str, data: bytes) -> None:
    """Write a whole file or nothing: a task that runs twice leaves the same file."""
    local = _local(path)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    with system.open_output_stream(where) as f:
        f.write(data)


def drop(path: str) -> None:
    """Delete a file that has been put."""
    local = _local(path)
    if local:
        os.unlink(local)
        return
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    system.delete_file(where)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; read into memory from a store that can't be mapped."""
    local = _local(path)
    if not local:
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path)
        with system.open_input_stream(where) as f:
            return _views(np.frombuffer(f.read(), np.uint8))
    return _views(np.memmap(local, np.uint8, "r"))


def _views(data: np.ndarray) -> dict[str, np.ndarray]:
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    out = {}
    for name, (kind, shape, at) in head.items():
        kind = np.dtype(kind)
        count = int(np.prod(shape))
        begin = 8 + size + at
        # a plain array over the same mapped pages: cheaper to index
        out[name] = data[begin : begin + count * kind.itemsize].view(np.ndarray).view(kind).reshape(shape)
    return out
