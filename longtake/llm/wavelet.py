"""A wavelet matrix of token ids in one compressed file, with its directory of documents."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"WVMX0001"
HEAD = struct.Struct("<8sIIQQQ")  # magic, levels, block bytes, ids, documents, bytes of the directory
BLOCK = 1 << 15  # bytes of a plane that are packed together
ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.int64)


def pack(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, levels: int) -> bytes:
    """One shard. ``lengths`` are the ids of each document; ``known`` is false for a null doc_id.

    Plane k holds bit (levels - 1 - k) of every id; before the next plane the ids with a zero bit
    come first, both halves in order. Planes are cut into blocks, each packed on its own; from the
    first block on that packing does not help, those of a plane are kept as they are.
    """
    planes, zeros = [], []
    row = ids.astype(np.uint32 if levels > 16 else np.uint16)
    for level in range(levels):
        bits = (row >> (levels - 1 - level)) & 1
        mask = bits.astype(bool)
        planes.append(np.packbits(mask, bitorder="little"))
        low = row[~mask]
        zeros.append(len(low))
        row = np.concatenate([low, row[mask]])
    bodies, sizes, ranks = [], [], []
    for plane in planes:
        worth = True
        for at in range(0, len(plane), BLOCK):
            piece = plane[at : at + BLOCK]
            ranks.append(int(np.bitwise_count(piece).sum()))
            raw = piece.tobytes()
            tight = zlib.compress(raw, 1) if worth else raw
            worth = len(tight) < 0.97 * len(raw)  # the next blocks of a plane are like this one
            bodies.append(tight if worth else raw)
            sizes.append(len(bodies[-1]))
    directory = zlib.compress(
        b"".join(
            [
                np.asarray(zeros, "<u8").tobytes(),
                np.asarray(sizes, "<u4").tobytes(),
                np.asarray(ranks, "<u4").tobytes(),
                np.asarray(doc_ids, "<i8").tobytes(),
                np.asarray(lengths, "<u4").tobytes(),
                np.asarray(known, "u1").tobytes(),
            ]
        )
    )
    head = HEAD.pack(MAGIC, levels, BLOCK, len(ids), len(doc_ids), len(directory))
    return b"".join([head, directory, *bodies])


class WaveletShard:
    """Reads a packed shard: token access, counting, occurrence lookup and whole decoding.

    Only the blocks that a question touches are unpacked.
    """

    def __init__(self, data: bytes | memoryview):
        self.data = memoryview(data)
        magic, self.levels, self.block, self.n, docs, size = HEAD.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        directory = zlib.decompress(self.data[HEAD.size : HEAD.size + size])
        self.plane_bytes = -(-self.n // 8)
        self.per_plane = -(-self.plane_bytes // self.block)
        at = 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(directory, kind, count, at)
            at += part.nbytes
            return part

        self.zeros = take("<u8", self.levels).astype(np.int64)
        blocks = self.levels * self.per_plane
        sizes = take("<u4", blocks).astype(np.int64)
        ranks = take("<u4", blocks).astype(np.int64).reshape(self.levels, self.per_plane)
        self.doc_ids, self.lengths, self.known = take("<i8", docs), take("<u4", docs).astype(np.int64), take("u1", docs)
        self.offsets = HEAD.size + size + np.concatenate([[0], np.cumsum(sizes)])
        self.before = np.concatenate([np.zeros((self.levels, 1), np.int64), np.cumsum(ranks, axis=1)], axis=1)
        self._open: dict[tuple[int, int], np.ndarray] = {}

    def _block(self, level: int, k: int, keep: bool = True) -> np.ndarray:
        if (level, k) in self._open:
            return self._open[level, k]
        i = level * self.per_plane + k
        raw = self.data[self.offsets[i] : self.offsets[i + 1]]
        full = min(self.block, self.plane_bytes - k * self.block)
        piece = np.frombuffer(raw if len(raw) == full else zlib.decompress(raw), np.uint8)
        if keep:
            if len(self._open) > 64:
                self._open.clear()
            self._open[level, k] = piece
        return piece

    def _bit(self, level: int, i: int) -> int:
        byte = i >> 3
        return int(self._block(level, byte // self.block)[byte % self.block] >> (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        if i <= 0:
            return 0
        byte, rest = i >> 3, i & 7
        k, inside = divmod(byte, self.block)
        if k == self.per_plane:
            return int(self.before[level, k])
        piece = self._block(level, k)
        ones = int(self.before[level, k] + ONES[piece[:inside]].sum())
        return ones + (bin(int(piece[inside]) & ((1 << rest) - 1)).count("1") if rest else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (self.levels - 1 - level) & 1:
                low, high = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        """How often the id occurs before position ``end``."""
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def occurrence(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0) of the id; -1 where there is none."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            return -1
        i = low + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            rank = i - int(self.zeros[level]) if bit else i
            i = self._select(level, bit, rank)
        return i

    def _select(self, level: int, bit: int, rank: int) -> int:
        left, right = 0, self.n - 1
        while left < right:
            mid = (left + right) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > rank:
                right = mid
            else:
                left = mid + 1
        return left

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        kind = np.uint32 if self.levels > 16 else np.uint16
        below = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            plane = np.concatenate([self._block(level, k, keep=False) for k in range(self.per_plane)] or [np.zeros(0, np.uint8)])
            mask = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            z = int(self.zeros[level])
            out = np.empty(self.n, kind)
            out[~mask] = below[:z]
            out[mask] = below[z:] | kind(1 << (self.levels - 1 - level))
            below = out
        return below
