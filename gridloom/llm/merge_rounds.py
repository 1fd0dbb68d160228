"""Byte-pair merging of many words at once, in rounds over flat numpy arrays.

The symbols of all words lie in one array. Each round takes the smallest pair rank of every word (a segmented minimum, which also gives
its leftmost place), merges there, closes the gaps and lets go of words without pairs. Sequential merging takes the best pair,
the leftmost of equals, one at a time; a round merges all of a word's places of its best rank, leftmost first, only where that
can't differ: where the rank makes one symbol, and that symbol is in no pair as good as itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np


#: Pairs that are looked up at once.
PORTION = 1 << 18


class MergeTable:
    """pairs: (left, right) -> (rank, result), symbols and ranks small non-negative integers."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.none = 1 + max((r for r, _ in pairs.values()), default=0)
        made: dict[int, set[int]] = {}
        best: dict[int, int] = {}
        for (a, b), (r, z) in pairs.items():
            made.setdefault(r, set()).add(z)
            for x in (a, b):
                best[x] = min(best.get(x, r), r)
        self.at_once = np.zeros(self.none + 1, dtype=bool)
        for r, zs in made.items():
            self.at_once[r] = len(zs) == 1 and best.get(next(iter(zs)), r + 1) > r
        # a hash table of three times the pairs or more; a pair that finds its slot taken goes to the next free one
        self.bits = max(4, (3 * len(pairs)).bit_length())
        size = 1 << self.bits
        keys, self.value = np.full(size + 64, -1, dtype=np.int64), np.full(size + 64, self.none << 32, dtype=np.int64)
        slots = self._slot(np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)) if pairs else []
        self.probes = 1
        for ((a, b), (r, z)), at in zip(pairs.items(), slots):
            at, step = int(at), 1
            while keys[at] != -1:
                at, step = at + 1, step + 1
            keys[at], self.value[at] = (a << 32) | b, (r << 32) | z
            self.probes = max(self.probes, step)
        self.keys = keys

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | result of each pair; the rank ``none`` without one."""
        out = np.empty(len(left), dtype=np.int64)
        for at in range(0, len(left), PORTION):  # so that a long word costs little more than its arrays
            out[at : at + PORTION] = self._pair(left[at : at + PORTION], right[at : at + PORTION])
        return out

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.value[slot], self.none << 32)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = slot[open_] + step
            hit = self.keys[at] == key[open_]
            out[open_[hit]] = self.value[at[hit]]
            open_ = open_[~hit & (self.keys[at] != -1)]
        return out

    def merge_runs(self, sym: list[int], counts: list[int]) -> np.ndarray:
        """The merged symbols of one word, given as runs of equal symbols: of any length, it takes no more memory than its result."""
        runs = [[x, n] for x, n in zip(sym, counts)]
        while True:
            x, n = np.array(runs, dtype=np.int64).T
            inside = np.where(n > 1, self.pair(x, x), self.none << 32)
            between = np.append(self.pair(x[:-1], x[1:]), self.none << 32)
            found = np.stack([inside, between], axis=1).reshape(-1)
            at = int((found >> 32).argmin())  # the leftmost of equals
            rank, made = int(found[at]) >> 32, int(found[at]) & 0xFFFFFFFF
            if rank == self.none:
                return np.repeat(x.astype(np.int32), n)
            i, (own, count) = at // 2, runs[at // 2]
            if at % 2:
                runs[i : i + 2] = [[own, count - 1], [made, 1], [runs[i + 1][0], runs[i + 1][1] - 1]]
            else:
                times = count // 2 if self.at_once[rank] else 1
                runs[i : i + 1] = [[made, times], [own, count - 2 * times]]
            joined: list[list[int]] = []
            for y, m in runs:
                if joined and joined[-1][0] == y:
                    joined[-1][1] += m
                elif m:
                    joined.append([y, m])
            runs = joined

    def merge(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sym: the symbols (int64) of words of ``sizes`` symbols, none empty. The merged symbols, and each word's end among them."""
        n_words, nothing = len(sizes), self.none << 32
        word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
        starts = np.cumsum(sizes) - sizes
        pair = np.full(len(sym), nothing)
        if len(sym) > 1:
            pair[:-1] = self.pair(sym[:-1], sym[1:])
            pair[starts[1:] - 1] = nothing
        done_sym, done_word = [], []
        while len(sym):
            index = np.arange(len(sym))
            best = np.minimum.reduceat((pair >> 32) * len(sym) + index, starts)
            least, leftmost = best // len(sym), best % len(sym)
            over = least == self.none
            lengths = np.diff(np.append(starts, len(sym)))
            if over.any():
                gone = np.repeat(over, lengths)
                done_sym.append(sym[gone])
                done_word.append(word[gone])
                if over.all():
                    break
            else:
                gone = np.zeros(len(sym), dtype=bool)
            chosen = np.zeros(len(sym), dtype=bool)
            chosen[leftmost[~over]] = True
            long = np.flatnonzero(~over & self.at_once[least] & (lengths > 3))
            if len(long):
                wanted = np.full(len(starts), -1)
                wanted[long] = least[long]
                place = np.flatnonzero((pair >> 32) == np.repeat(wanted, lengths))
                head = np.append(True, np.diff(place) != 1)
                since = np.arange(len(place)) - np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))
                chosen[place[since % 2 == 0]] = True
            at = np.flatnonzero(chosen)
            sym[at] = pair[at] & 0xFFFFFFFF
            gone[at + 1] = True
            stay = np.flatnonzero(~gone)
            moved = np.searchsorted(stay, at)  # where the merged symbols are now
            sym, word, pair = sym[stay], word[stay], pair[stay]
            last = len(sym) - 1
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            for where in (moved, moved[moved > 0] - 1):
                right = np.minimum(where + 1, last)
                inside = (word[where] == word[right]) & (right > where)
                pair[where] = np.where(inside, self.pair(sym[where], sym[right]), nothing)
        if not done_sym:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        out, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return out[order], np.cumsum(np.bincount(owner, minlength=n_words))


class WordMemory:
    """What was made of words, about ``most`` bytes of it; older ones that no batch has asked for since go, and words over ``longest`` characters aren't kept."""

    #: Bytes that Python takes for an entry beside what it holds.
    ENTRY = 240

    def __init__(self, make: Callable[[list[str]], Iterable[bytes]], most: int = 48 << 20, longest: int = 1000):
        self.make, self.most, self.longest = make, most, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0  # of the new ones

    def _keep(self, words: Iterable[str], made: Iterable[bytes]) -> None:
        for w, x in zip(words, made):
            self.new[w] = x
            self.size += 2 * len(w) + len(x) + self.ENTRY

    def __call__(self, texts: list[list[str]]) -> list[bytes]:
        """For each list of words, what was made of them, joined."""
        if self.size > self.most // 2:
            self.old, self.new, self.size = self.new, {}, 0
        missing = set().union(*texts).difference(self.new)
        if self.old:
            again = [w for w in missing if w in self.old]
            self._keep(again, map(self.old.__getitem__, again))
            missing.difference_update(again)
        long = [w for w in missing if len(w) > self.longest]
        missing.difference_update(long)
        if missing:
            words = list(missing)
            self._keep(words, self.make(words))
        if not long:
            return [b"".join(map(self.new.__getitem__, ws)) for ws in texts]
        once = dict(zip(long, self.make(long)))
        return [b"".join(once[w] if len(w) > self.longest else self.new[w] for w in ws) for ws in texts]
