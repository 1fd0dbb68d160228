"""Deep-shallow sorting of byte strings in groups: order and common prefixes.

The shallow part is a multikey quicksort over eight-byte words: within a set of strings that agree so far, the next word decides, and those that
agree on it as well go on together, to a depth of ``SHALLOW`` bytes; all sets of a batch are one numpy sort a word. What still agrees
then has long common prefixes, and comparing it byte by byte would cost their length each time: a blind trie orders each such set. It
keeps only branching places and bytes; a string goes down along those, is compared once with the leaf it meets, and so finds its place.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 128


class _Node:
    __slots__ = ("depth", "branches", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth = depth  # strings below agree up to here
        self.branches: dict[int, object] = {}  # next byte, -1 for the end of a string -> node or list of equal strings
        self.leaf = leaf  # some string below


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


def blind_trie_order(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of the strings, equal ones as given, and of each but the first its common prefix with the one before."""
    if len(strings) == 1:
        return [0], []
    root = _Node(len(strings[0]), 0)
    root.branches[-1] = [0]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        path = []
        while True:  # blind descent: only branching bytes are looked at
            path.append(node)
            below = node.branches.get(_byte(s, node.depth))
            if not isinstance(below, _Node):
                break
            node = below
        leaf = below[0] if below is not None else path[-1].leaf
        n = common_prefix(s, strings[leaf])
        if below is not None and n == len(s) == len(strings[leaf]):
            below.append(i)
            continue
        k = next((k for k, x in enumerate(path) if x.depth >= n), len(path))
        if k < len(path) and path[k].depth == n and _byte(s, n) not in path[k].branches:
            path[k].branches[_byte(s, n)] = [i]
            continue
        new = _Node(n, leaf)
        old = path[k] if k < len(path) else below
        new.branches[_byte(strings[old.leaf if isinstance(old, _Node) else old[0]], n)] = old
        new.branches[_byte(s, n)] = [i]
        if k == 0:
            root = new
        else:
            path[k - 1].branches[_byte(s, path[k - 1].depth)] = new
    order: list[int] = []
    lcp: list[int] = []
    todo: list[tuple[object, int]] = [(root, 0)]  # what is below, and its common prefix with what was given out before
    while todo:
        node, shared = todo.pop()
        if isinstance(node, list):
            if order:
                lcp.append(shared)
            lcp += [len(strings[node[0]])] * (len(node) - 1)
            order += node
            continue
        parts = sorted(node.branches.items())
        todo += [(x, node.depth if j else shared) for j, (_, x) in reversed(list(enumerate(parts)))]
    return order, lcp


def sort_groups(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group (non-negative numbers) and string. lcp[i]: common prefix of the i-th and the one before; 0 at a group's first."""
    n = len(strings)
    size = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(n, dtype=np.int64)
    if n < 2:
        return order, lcp
    tied = np.append(False, group[order][1:] == group[order][:-1])  # agrees so far with the one before
    for depth in range(0, SHALLOW, 8):
        again = tied.copy()
        again[:-1] |= tied[1:]
        at = np.flatnonzero(again)
        if not len(at):
            break
        who = order[at]
        part = [strings[i][depth : depth + 8] for i in who.tolist()]
        word = np.frombuffer(b"".join(p.ljust(8, b"\0") for p in part), dtype=">u8").astype(np.uint64)
        left = np.clip(size[who] - depth, 0, 8)  # tells a short string from one that goes on with zeros
        sets = np.cumsum(~tied)[at]
        by = np.lexsort((left, word, sets))
        at_word, at_left, at_set = word[by], left[by], sets[by]
        order[at] = who[by]
        same = np.append(False, (at_word[1:] == at_word[:-1]) & (at_left[1:] == at_left[:-1]) & (at_set[1:] == at_set[:-1]))
        inside = np.append(False, at_set[1:] == at_set[:-1])
        new = np.flatnonzero(inside & ~same)
        diff = at_word[new] ^ at_word[new - 1]
        equal = np.array([(64 - d.bit_length()) // 8 for d in diff.tolist()], dtype=np.int64)
        lcp[at[new]] = depth + np.minimum(equal, np.minimum(at_left[new], at_left[new - 1]))
        ends = at_left < 8  # equal and at an end: equal strings
        over = np.flatnonzero(same & ends)
        lcp[at[over]] = size[order[at[over]]]
        tied[at] = same & ~ends
    starts = np.flatnonzero(tied & ~np.append(False, tied[:-1]))
    for s in starts.tolist():
        e = s
        while e < n and tied[e]:
            e += 1
        own = order[s - 1 : e]
        rest = [strings[i][SHALLOW:] for i in own.tolist()]
        inner, shared = blind_trie_order(rest)
        order[s - 1 : e] = own[inner]
        lcp[s:e] = np.array(shared) + SHALLOW
    return order, lcp


class RangeMinimum:
    """Smallest value in any range of an array, from minima over powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        k = 1
        while 2 * k <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Over first..last, both included, first <= last."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=self.rows[0].dtype)
        for k in np.unique(level).tolist():
            m = level == k
            row = self.rows[k]
            out[m] = np.minimum(row[first[m]], row[last[m] - (1 << k) + 1])
        return out
