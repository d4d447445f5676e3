"""Word handling in Python workers: bounded memo tables over words."""

from __future__ import annotations

import zlib


class Memo(dict):
    """A dict that computes missing values and forgets everything beyond `bound` keys, so a
    worker's memory stays bounded whatever vocabulary passes through it."""

    def __init__(self, compute, bound: int = 100_000):
        super().__init__()
        self.compute, self.bound = compute, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        v = self[key] = self.compute(key)
        return v


def crc(data: bytes) -> int:
    return zlib.crc32(data)
