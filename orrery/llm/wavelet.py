"""A wavelet matrix: symbols as bit planes, most significant first, with rank and select on each."""

from __future__ import annotations

import functools
import struct

import numpy as np
import zstandard

BLOCK = 64  # bits of a rank block
HEAD = "<4sBQ"
MAGIC = b"WVM2"


class BitPlane:
    """Bits with counts of ones before each block of 64, counted when first asked for."""

    def __init__(self, packed: np.ndarray, size: int, zeros: int | None = None):
        pad = -len(packed) % 8
        self.words = np.concatenate([packed, np.zeros(pad + 8, np.uint8)]).view("<u8")
        self.size = size
        self.zeros = size - int(np.bitwise_count(self.words).sum()) if zeros is None else zeros

    @functools.cached_property
    def before(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def bools(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), bitorder="little", count=self.size).view(bool)

    def bit(self, i):
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank1(self, i):
        """Ones before i, for an array of places."""
        i = np.asarray(i, np.int64)
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def select(self, bit: int, k):
        """Place of the k-th (from 0) one or zero, for an array of k."""
        k = np.asarray(k, np.int64)
        counts = self.before if bit else np.arange(len(self.before)) * BLOCK - self.before
        word = np.searchsorted(counts, k, side="right") - 1
        rest = k - counts[word]
        bits = np.unpackbits((self.words[word] if bit else ~self.words[word])[:, None].view(np.uint8), axis=1, bitorder="little")
        inside = (np.cumsum(bits, axis=1) <= rest[:, None]).sum(1)
        return word * BLOCK + inside


class WaveletMatrix:
    """Access, rank, select and counts over symbols below 2**bits; places and symbols may be arrays."""

    def __init__(self, planes: list[BitPlane], size: int):
        self.planes, self.size = planes, size

    @classmethod
    def build(cls, symbols: np.ndarray, bits: int) -> WaveletMatrix:
        now = np.asarray(symbols, np.uint16 if bits <= 16 else np.uint32)
        planes, size = [], len(now)
        for b in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << b)) != 0
            zero = np.compress(~ones, now)
            planes.append(BitPlane(np.packbits(ones, bitorder="little"), size, len(zero)))
            if b:
                now = np.concatenate([zero, np.compress(ones, now)])
        return cls(planes, size)

    def access(self, i) -> np.ndarray:
        i = np.asarray(i, np.int64).copy()
        out = np.zeros(i.shape, np.uint32)
        for p in self.planes:
            one = p.bit(i).astype(bool)
            r = p.rank1(i)
            out = out << np.uint32(1) | one.astype(np.uint32)
            i = np.where(one, p.zeros + r, i - r)
        return out

    def rank(self, symbol, i) -> np.ndarray:
        """Places before i that hold the symbol."""
        lo, hi = self._walk(symbol, np.zeros_like(np.asarray(i, np.int64)), np.asarray(i, np.int64))
        return hi - lo

    def _walk(self, symbol, lo, hi):
        symbol = np.asarray(symbol, np.int64)
        for k, p in enumerate(self.planes):
            one = (symbol >> (len(self.planes) - 1 - k)) & 1 == 1
            l1, h1 = p.rank1(lo), p.rank1(hi)
            lo, hi = np.where(one, p.zeros + l1, lo - l1), np.where(one, p.zeros + h1, hi - h1)
        return lo, hi

    def first(self, symbol) -> np.ndarray:
        """Where the symbol's run starts behind the last plane."""
        zero = np.zeros_like(np.asarray(symbol, np.int64))
        return self._walk(symbol, zero, zero)[0]

    def count(self, symbol: int) -> int:
        return int(self.rank(np.array([symbol]), np.array([self.size]))[0])

    def select(self, symbol: int, k) -> np.ndarray:
        """Place of the k-th (from 0) occurrence."""
        place = self.first(np.array([symbol]))[0] + np.asarray(k, np.int64)
        for level in range(len(self.planes) - 1, -1, -1):
            p = self.planes[level]
            one = (symbol >> (len(self.planes) - 1 - level)) & 1
            place = p.select(1, place - p.zeros) if one else p.select(0, place)
        return place

    def occurrences(self, symbol: int) -> np.ndarray:
        return self.select(symbol, np.arange(self.count(symbol)))

    def symbols(self) -> np.ndarray:
        """All symbols in order: each plane, from the last, puts its zeros and ones back in place."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.size, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            p = self.planes[level]
            ones = p.bools()
            now[p.zeros:] |= kind(1 << (len(self.planes) - 1 - level))
            out = np.empty_like(now)
            out[np.flatnonzero(~ones)] = now[:p.zeros]
            out[np.flatnonzero(ones)] = now[p.zeros:]
            now = out
        return now

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1)
        parts = [struct.pack(HEAD, MAGIC, len(self.planes), self.size)]
        for p in self.planes:
            packed = squeeze.compress(p.words.view(np.uint8)[:(self.size + 7) // 8].tobytes())
            parts += [struct.pack("<QI", p.zeros, len(packed)), packed]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        magic, bits, size = struct.unpack_from(HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at, planes, open_ = struct.calcsize(HEAD), [], zstandard.ZstdDecompressor()
        for _ in range(bits):
            zeros, n = struct.unpack_from("<QI", blob, at)
            at += struct.calcsize("<QI")
            planes.append(BitPlane(np.frombuffer(open_.decompress(blob[at:at + n]), np.uint8), size, zeros))
            at += n
        return cls(planes, size)
