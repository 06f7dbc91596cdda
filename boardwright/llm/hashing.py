"""64-bit hashes of the words of texts."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_PART = bytes(i if chr(i).isalnum() and i < 128 else 32 for i in range(256)).lower()


def plain_words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower())


class WordHashes:
    """Hashes of words; what it remembers of words is bounded. `split` cuts texts that aren't plain ASCII."""

    def __init__(self, split: Callable[[str], list[str]] = plain_words):
        self.split = split
        self.clear()

    def clear(self):
        self.at: dict = {}
        self.hashes = np.zeros(1024, np.uint64)

    def words(self, text: str) -> list:
        return text.encode().translate(_PART).split() if text.isascii() else self.split(text)

    def of(self, ws: list) -> np.ndarray:
        """The hashes of words; a word hashes alike as text and as bytes."""
        if len(self.at) > 500_000:
            self.clear()
        found = list(map(self.at.get, ws))
        if None in found:
            for w in {w for w, k in zip(ws, found) if k is None}:
                n = self.at[w] = len(self.at)
                if n >= len(self.hashes):
                    self.hashes = np.concatenate([self.hashes, np.zeros(len(self.hashes), np.uint64)])
                self.hashes[n] = xxhash.xxh3_64_intdigest(w)
            found = list(map(self.at.get, ws))
        return self.hashes[np.array(found, np.int64)]

    def __call__(self, text: str) -> np.ndarray:
        return self.of(self.words(text))
