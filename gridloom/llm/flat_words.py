"""Words of many texts as flat arrays: cut at white space, told apart by their bytes, and turned to ids once each.

A word of up to ``LONGEST`` bytes is four 64-bit integers, so that words compare exactly without being objects; a hash of them sorts a
batch's words into distinct ones, and what it would confuse is seen and told apart.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LONGEST = 32
_LANES = LONGEST // 8
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that may begin white space beyond ASCII, or that str.split() and tokenizers see differently.
_ODD = np.zeros(256, dtype=bool)
_ODD[[0, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Words:
    """The words of some texts: where they start and end in the bytes, and of which text each is."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.raw = np.frombuffer(b" ".join([b"", *texts, b" " * (LONGEST + 8)]), dtype=np.uint8)
        inside = ~_SPACE[self.raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the bytes begin and end with a space
        self.start, self.end = edge[::2], edge[1::2]
        self.size = self.end - self.start
        self.text = np.searchsorted(np.cumsum(sizes), self.start, "left")
        self.n_texts = len(texts)
        odd = np.flatnonzero(_ODD[self.raw])
        strange = [np.searchsorted(np.cumsum(sizes), odd, "left"), self.text[self.size > LONGEST]]
        #: Texts with bytes or words that this can't hold.
        self.strange = np.unique(np.concatenate(strange))

    def keys(self, which: np.ndarray) -> np.ndarray:
        """The bytes of words as rows of integers, zeros behind their end."""
        eight = np.ndarray(shape=(len(self.raw) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        start, size = self.start[which], self.size[which]
        out = np.empty((len(which), _LANES), dtype=np.uint64)
        for lane in range(_LANES):
            out[:, lane] = eight[start + 8 * lane] & _MASKS[np.clip(size - 8 * lane, 0, 8)]
        return out


def _hashed(keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys), dtype=np.uint64)
    for lane in range(_LANES):
        h = (h ^ keys[:, lane]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class FlatMemory:
    """ids of words that were met, in arrays sorted by hash; it starts anew beyond ``most`` words."""

    def __init__(self, make: Callable[[Words, np.ndarray], tuple[np.ndarray, np.ndarray]], most: int = 400_000):
        self.make, self.most = make, most
        self._clear()

    def _clear(self) -> None:
        self.hash = np.empty(0, dtype=np.uint64)
        self.key = np.empty((0, _LANES), dtype=np.uint64)
        self.at, self.n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.uint32)

    def ids_of(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after the other, and how many each has."""
        if len(self.hash) > self.most:
            self._clear()
        keys = words.keys(which)
        hashes = _hashed(keys)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if not (keys[first][back] == keys).all():  # two words of one hash: tell them apart by all their bytes
            _, first, back = np.unique(keys, axis=0, return_index=True, return_inverse=True)
            distinct = hashes[first]
            back = back.reshape(-1)
        own = keys[first]
        at = np.searchsorted(self.hash, distinct)
        known = at < len(self.hash)
        known[known] = (self.key[at[known]] == own[known]).all(axis=1) if known.any() else False
        new = np.flatnonzero(~known)
        start, n = np.empty(len(first), dtype=np.int64), np.empty(len(first), dtype=np.int64)
        start[known], n[known] = self.at[at[known]], self.n[at[known]]
        if len(new):
            ids, counts = self.make(words, which[first[new]])
            start[new], n[new] = len(self.ids) + np.cumsum(counts) - counts, counts
            self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])
            order = np.argsort(np.concatenate([self.hash, distinct[new]]), kind="stable")
            merged = lambda old, more: np.concatenate([old, more])[order]
            self.hash, self.key = merged(self.hash, distinct[new]), merged(self.key, own[new])
            self.at, self.n = merged(self.at, start[new]), merged(self.n, n[new])
        start, n = start[back], n[back]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        return self.ids[place], n
