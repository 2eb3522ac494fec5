"""Rolling k-gram keys of words over a small vocabulary, for whole batches of texts at once."""

from __future__ import annotations

from itertools import repeat

import numpy as np

from .common import alnum_words

#: Multiplier of the rolling key, modulo 2^64: a fixed odd value.
STEP = 0x9E3779B97F4A7C15


def key_of(ids: list[int]) -> int:
    """The key of one run of word ids, as a signed long."""
    key = 0
    for i in ids:
        key = (key * STEP + i) % (1 << 64)
    return key - (1 << 64) if key >> 63 else key


class Scanner:
    """Finds the places of known k-grams. vocabulary: word to id from 1; keys: for each k, the known keys.

    A k-gram with a word outside the vocabulary cannot be known, so it gets no key.
    """

    def __init__(self, vocabulary: dict[bytes, int], keys: dict[int, list[int] | np.ndarray]):
        self.vocabulary = vocabulary
        self.keys = {k: np.sort(np.unique(np.asarray(v, np.int64)).view(np.uint64)) for k, v in keys.items() if len(v)}
        self.widest = max(self.keys, default=1)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of all texts in a row (0: not in the vocabulary), each text's start among them, and its number of words."""
        gap = [0] * self.widest
        ids: list[int] = list(gap)
        starts, sizes = [], []
        get = self.vocabulary.get
        for t in texts:
            words = alnum_words(t)
            starts.append(len(ids))
            sizes.append(len(words))
            ids.extend(map(get, words, repeat(0)))
            ids.extend(gap)
        return np.array(ids, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known k-grams, ascending, and their keys (signed)."""
        places, found = [], []
        for k, known in self.keys.items():
            n = len(ids) - k + 1
            if n <= 0:
                continue
            # only runs without an unknown word
            ok = np.cumsum(np.concatenate(([0], ids == 0)))
            at = np.flatnonzero(ok[k:] == ok[:-k][: len(ok) - k])
            key = np.zeros(len(at), np.uint64)
            for j in range(k):
                key = key * np.uint64(STEP) + ids[at + j].view(np.uint64)
            where = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[where] == key
            places.append(at[hit])
            found.append(key[hit].view(np.int64))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places_, found_ = np.concatenate(places), np.concatenate(found)
        order = np.argsort(places_, kind="stable")
        return places_[order], found_[order]
