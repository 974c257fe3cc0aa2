"""Counting quotient filters of packed n-grams: exact, compact counters that merge in sorted order.

An n-gram of word ids is packed into a key of two halves, and the key is permuted by a network of
four rounds that can be run backwards, so nothing is lost. The permuted key's first bits name the
bucket, the next ones the slot (with the bucket, the quotient), and all others are the remainder,
kept in full. A filter holds, for one bucket, the slots' run lengths as a string of bits (a one for every
entry, a zero at every slot's end), the remainders in as few bytes as they need, and a counter of a
byte for each entry, with larger ones apart.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from lumenvec.llm._bytes import mix

_ROUND = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_FULL = 255


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


@dataclass(frozen=True)
class Packing:
    """How n-grams of n words become keys: ids of `width` bits (1 to 31; 0 is no id), and 2^bucket_bits buckets."""

    n: int
    width: int
    bucket_bits: int

    @property
    def left(self) -> int:
        return self.width * (1 if self.n == 2 else 2)

    @property
    def right(self) -> int:
        return self.width * self.n - self.left

    def pack(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Halves of the keys of n-grams given as n arrays of ids."""
        w, at = np.uint64(self.width), self.left // self.width
        halves = []
        for part in (ids[:at], ids[at:]):
            x = part[0].astype(np.uint64)
            for y in part[1:]:
                x = (x << w) | y.astype(np.uint64)
            halves.append(x)
        return halves[0], halves[1]

    def unpack(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        at, out = self.left // self.width, []
        for x, n in ((left, at), (right, self.n - at)):
            out += [((x >> np.uint64(self.width * (n - 1 - k))) & _mask(self.width)).astype(np.int64) for k in range(n)]
        return out

    def permuted(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ml, mr = _mask(self.left), _mask(self.right)
        for k, c in enumerate(_ROUND):
            if k % 2:
                right = right ^ (mix(left + c) & mr)
            else:
                left = left ^ (mix(right + c) & ml)
        return left, right

    def restored(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ml, mr = _mask(self.left), _mask(self.right)
        for k, c in reversed(list(enumerate(_ROUND))):
            if k % 2:
                right = right ^ (mix(left + c) & mr)
            else:
                left = left ^ (mix(right + c) & ml)
        return left, right

    @property
    def shift(self) -> int:
        """Bits of the left half below those that name the bucket."""
        return max(self.left - self.bucket_bits, 0)


def summed(left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of their keys, the counts of equal ones added up."""
    if not len(left):
        return left, right, counts
    # both sorts are stable, and take sorted runs as they are, so sorted filters are merged
    order = np.argsort(right, kind="stable")
    order = order[np.argsort(left[order], kind="stable")]
    left, right, counts = left[order], right[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])]))
    return left[first], right[first], np.add.reduceat(counts, first)


def counted(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for keys that count one each."""
    return summed(left, right, np.ones(len(left), np.int64))


def encode(p: Packing, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter of one bucket's entries: permuted keys in order, each once."""
    n = len(left)
    slot_bits = min(max(n, 1).bit_length() - 1, p.shift)
    rest = p.shift - slot_bits
    low = left & _mask(p.shift)
    slot = (low >> np.uint64(rest)).astype(np.int64)
    bits = np.zeros(n + (1 << slot_bits), np.uint8)
    bits[np.arange(n) + slot] = 1
    parts = [struct.pack("<IBI", n, slot_bits, int((counts >= _FULL).sum())), np.packbits(bits).tobytes()]
    for x, size in ((low & _mask(rest), rest), (right, p.right)):
        bytes_ = -(-size // 8)
        parts.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(n, 8)[:, :bytes_]).tobytes())
    parts += [np.minimum(counts, _FULL).astype(np.uint8).tobytes(), counts[counts >= _FULL].astype("<i8").tobytes()]
    return b"".join(parts)


def decode(p: Packing, bucket: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, counts) of a filter, permuted keys in order."""
    n, slot_bits, large = struct.unpack_from("<IBI", raw)
    at = struct.calcsize("<IBI")
    size = -(-(n + (1 << slot_bits)) // 8)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n + (1 << slot_bits)))
    at += size
    rest = p.shift - slot_bits
    halves = []
    for bits in (rest, p.right):
        bytes_ = -(-bits // 8)
        x = np.zeros((n, 8), np.uint8)
        x[:, :bytes_] = np.frombuffer(raw, np.uint8, n * bytes_, at).reshape(n, bytes_)
        halves.append(x.view("<u8").ravel())
        at += n * bytes_
    slot = (ones - np.arange(n)).astype(np.uint64)
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == _FULL] = np.frombuffer(raw, "<i8", large, at + n)
    return (np.uint64(bucket) << np.uint64(p.shift)) | (slot << np.uint64(rest)) | halves[0], halves[1], counts


def filters(p: Packing, ids: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """(bucket, entries, filter) for every bucket that these n-grams fall in."""
    left, right, counts = counted(*p.permuted(*p.pack(ids)))
    if not len(left):
        return []
    bucket = (left >> np.uint64(p.shift)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]).tolist()
    return [(int(bucket[a]), b - a, encode(p, left[a:b], right[a:b], counts[a:b])) for a, b in zip(edges, edges[1:])]


def merged(p: Packing, bucket: int, raws: list[bytes], least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all these filters of one bucket, those that count `least` or more together."""
    parts = [decode(p, bucket, x) for x in raws]
    left, right, counts = summed(*map(np.concatenate, zip(*parts)))
    keep = counts >= least
    return left[keep], right[keep], counts[keep]


def within(p: Packing, left: np.ndarray, right: np.ndarray, some_left: np.ndarray, some_right: np.ndarray) -> np.ndarray:
    """Which of the sorted, distinct keys are among the others, sorted and distinct too."""
    both_left, both_right, n = summed(np.concatenate([left, some_left]), np.concatenate([right, some_right]), np.concatenate([np.full(len(left), 1), np.full(len(some_left), 2)]))
    return n[n != 2] == 3
