"""A cuckoo filter over 128-bit keys: vectorised lookups, single insertions and deletions.

A key sits in one of two buckets of four 16-bit fingerprints; the second bucket is the first xor a
hash of the fingerprint, so an entry can move without its key. A key for which moving finds no room is kept
in full in a stash, so no key is ever refused and deletion stays exact for keys that were inserted.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
MAX_KICKS = 400
#: Share of the slots beyond which a filter counts as full.
FULL = 0.9
#: Multiplier that spreads a fingerprint over the buckets (odd, 32 bits).
_SPREAD = 0x5BD1E995


def _split(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First hash and nonzero fingerprint of each 16-byte digest, given as an array of shape (n, 2) of uint64."""
    prints = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
    return (digests[:, 0] >> np.uint64(16)).astype(np.int64), np.where(prints == 0, 1, prints)


def as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


class CuckooFilter:
    def __init__(self, buckets: int, cells: np.ndarray | None = None, stash: set[bytes] | None = None):
        assert buckets & (buckets - 1) == 0
        self.mask = buckets - 1
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells
        self.stash = stash or set()

    @classmethod
    def sized_for(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8))))))

    @classmethod
    def from_bytes(cls, data: bytes, stash: bytes = b"") -> CuckooFilter:
        cells = np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(cells), cells, {stash[i : i + 16] for i in range(0, len(stash), 16)})

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.cells.tobytes(), b"".join(sorted(self.stash))

    def contains(self, digests: np.ndarray) -> np.ndarray:
        first, prints = _split(digests)
        one = first & self.mask
        two = one ^ ((prints * _SPREAD) & self.mask)
        hit = ((self.cells[one] == prints[:, None]) | (self.cells[two] == prints[:, None])).any(axis=1)
        if self.stash:
            hit |= np.array([d.tobytes() in self.stash for d in digests], bool)
        return hit

    def insert(self, *digests: bytes) -> None:
        first, prints = _split(as_words(list(digests)))
        for digest, at, mark in zip(digests, (first & self.mask).tolist(), prints.tolist(), strict=True):
            if not self._place(at, mark):
                self.stash.add(digest)

    def _free(self, bucket: int) -> int:
        row = self.cells[bucket].tolist()
        return row.index(0) if 0 in row else -1

    def _place(self, at: int, mark: int) -> bool:
        """False when no room is found; the filter is then as it was before."""
        other = at ^ ((mark * _SPREAD) & self.mask)
        for bucket in (at, other):
            if (slot := self._free(bucket)) >= 0:
                self.cells[bucket, slot] = mark
                return True
        moved, bucket = [], other
        for kick in range(MAX_KICKS):
            slot = (mark + kick) % SLOTS
            moved.append((bucket, slot, int(self.cells[bucket, slot])))
            self.cells[bucket, slot], mark = mark, moved[-1][2]
            bucket ^= (mark * _SPREAD) & self.mask
            if (free := self._free(bucket)) >= 0:
                self.cells[bucket, free] = mark
                return True
        for bucket, slot, old in reversed(moved):
            self.cells[bucket, slot] = old
        return False

    def delete(self, *digests: bytes) -> None:
        """Removes one entry of each key; all must have been inserted before."""
        first, prints = _split(as_words(list(digests)))
        for digest, at, mark in zip(digests, (first & self.mask).tolist(), prints.tolist(), strict=True):
            if digest in self.stash:
                self.stash.remove(digest)
                continue
            for bucket in (at, at ^ ((mark * _SPREAD) & self.mask)):
                row = self.cells[bucket].tolist()
                if mark in row:
                    self.cells[bucket, row.index(mark)] = 0
                    break
            else:
                raise KeyError("a key was deleted that the filter does not hold")
