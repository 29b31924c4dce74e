"""Cuckoo filter: approximate membership with insertion and deletion, two candidate buckets per key."""

from __future__ import annotations

from array import array

_MASK = (1 << 64) - 1


class Overflow(Exception):
    """No free slot was found within the allowed number of moves."""


class CuckooFilter:
    """16-bit fingerprints in buckets of four; the second bucket follows from the first and the fingerprint.

    Keys are 64-bit hashes. A key that was inserted is always found; another key is found by chance in about
    8 of 65,536 lookups of a full filter. `delete` removes one insertion and must only be given inserted keys.
    """

    SLOTS = 4
    MOVES = 400

    def __init__(self, n_buckets: int, slots: array | None = None, used: int = 0):
        if n_buckets < 1 or n_buckets & (n_buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self.n_buckets = n_buckets
        self.used = used
        self._slots = slots if slots is not None else array("H", bytes(2 * self.SLOTS * n_buckets))

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        """A filter that n keys fill to 80 % at most."""
        buckets = 1
        while buckets * cls.SLOTS * 0.8 < n:
            buckets *= 2
        return cls(buckets)

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) or 1
        first = key & (self.n_buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ ((mark * 0x9E3779B97F4A7C15 & _MASK) >> 32)) & (self.n_buckets - 1)

    def _put(self, bucket: int, mark: int) -> bool:
        slots, at = self._slots, bucket * self.SLOTS
        for i in range(at, at + self.SLOTS):
            if not slots[i]:
                slots[i] = mark
                return True
        return False

    def __contains__(self, key: int) -> bool:
        mark, a, b = self._places(key)
        slots, n = self._slots, self.SLOTS
        return mark in slots[a * n:a * n + n] or mark in slots[b * n:b * n + n]

    def insert(self, key: int) -> None:
        """Add one occurrence of the key. Raises Overflow, after which the filter must be rebuilt from its keys."""
        mark, a, b = self._places(key)
        if not (self._put(a, mark) or self._put(b, mark)):
            bucket = b
            for move in range(self.MOVES):
                at = bucket * self.SLOTS + (move + mark) % self.SLOTS
                mark, self._slots[at] = self._slots[at], mark
                bucket = self._other(bucket, mark)
                if self._put(bucket, mark):
                    break
            else:
                raise Overflow
        self.used += 1

    def delete(self, key: int) -> bool:
        """Remove one occurrence of the key; False if there is none."""
        mark, a, b = self._places(key)
        for bucket in (a, b):
            for i in range(bucket * self.SLOTS, (bucket + 1) * self.SLOTS):
                if self._slots[i] == mark:
                    self._slots[i] = 0
                    self.used -= 1
                    return True
        return False

    def to_bytes(self) -> bytes:
        return self._slots.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, used: int) -> CuckooFilter:
        slots = array("H", data)
        return cls(len(slots) // cls.SLOTS, slots, used)
