"""Vector bin packing of examples into training sequences, by the dot-product heuristic.

A sequence has limits on tokens, segments (pieces of examples) and loss-bearing tokens. Of the examples that fit what is left of the
open sequence on all three, the one whose demand has the largest dot product with what is left goes in. When none fits, the one
with the largest product is cut where the first limit is met, and its rest waits on. A sequence that ends short of the token limit is
split at powers of two, which need no padding. Each task packs its own rows, in windows of ``WINDOW`` tokens, the rest of a window
going into the next; nothing is shuffled, and a task that runs again packs alike.

Defined results: a null text counts as empty, which packs as its end id alone; repeated rows and rows without id are packed each; a text of
any length is cut as needed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from .flat_words import FlatMemory, Words
from .merge_rounds import MergeTable, WordMemory
from .piece_codec import _portions

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS = 4096, 128, 4096
WINDOW = 1 << 20
#: White space of the tokenizer's patterns; the cuts between words, which no token crosses.
_SPACE = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[^{_SPACE}]+")
_ODD = re.compile("[\x1c-\x1f]")
#: Letters that are one code point in any normal form and have a lower case of one, then up to four marks that begin no contraction.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]{0,4})")

_MARK = np.zeros(256, dtype=bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and b != 39]] = True


def _byte_characters() -> list[str]:
    """The characters by which byte-level BPE writes bytes: printable ones by themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(0x100 + rest.index(b)) for b in range(256)]


_BYTES = _byte_characters()

_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """A BPE tokenizer with word ends that lower-cases and drops white space, with the ids of words remembered.

    Words of plain letters (and marks after them) are merged here, in rounds over many words; all others go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.table = MergeTable({(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(pairs)})
        # byte-level tokenizers write byte b as the character _BYTES[b]
        self.inner = np.array([vocab[_BYTES[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[_BYTES[b] + end] for b in range(256)], dtype=np.int64)
        self.of_words = WordMemory(self._made)
        self.flat = FlatMemory(self._made_flat)
        self.of_marks: dict[str, bytes] = {}

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _made(self, words: list[str]) -> list[bytes]:
        found = list(map(_PLAIN.fullmatch, words))
        others = [w for w, f in zip(words, found) if f is None]
        strange = iter(self._library(others))
        parts = [f.groups() for f in found if f]
        if not parts:
            return list(strange)
        stems, marks = zip(*parts)
        new = list(set(marks).difference(self.of_marks))
        self.of_marks.update(zip(new, self._library(new)))
        stems = "\n".join(stems).lower().encode("utf-8").split(b"\n")
        sizes = np.fromiter(map(len, stems), dtype=np.int64, count=len(stems))
        raw = np.frombuffer(b"".join(stems), dtype=np.uint8)
        sym, last = self.inner[raw], np.cumsum(sizes) - 1
        sym[last] = self.final[raw[last]]
        flat, ends = self.table.merge(sym, sizes)
        ids, cuts = flat.astype("<u4").tobytes(), (4 * ends).tolist()
        made = map(bytes.__add__, [ids[a:b] for a, b in zip([0, *cuts], cuts)], map(self.of_marks.__getitem__, marks))
        return [next(made if f else strange) for f in found] if others else list(made)

    def _made_flat(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words in flat arrays: ids, and how many each word has."""
        size = words.size[which]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(begin, size) + np.repeat(words.start[which], size)
        raw = words.raw[at].copy()
        latin = np.append(False, raw[:-1] == 0xC3)  # the second byte of a letter from U+00C0 to U+00FF
        raw[((raw >= 65) & (raw <= 90)) | (latin & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97))] += 32
        letter = ((raw >= 97) & (raw <= 122)) | ((raw == 0xC3) & ~np.append(np.isin(raw[1:], (0x97, 0xB7)), False)) | (latin & ~np.isin(raw, (0x97, 0xB7)))
        word = np.repeat(np.arange(len(which)), size)
        other = np.flatnonzero(~letter)
        stem = size.copy()
        np.minimum.at(stem, word[other], other - begin[word[other]])
        inside = np.arange(len(raw)) - np.repeat(begin, size)
        mark = _MARK[raw]
        bad = (~mark & (inside >= stem[word])) | (inside >= stem[word] + 4)
        plain = stem > 0
        plain[word[bad]] = False
        ids: list[np.ndarray] = []
        counts = np.zeros(len(which), dtype=np.int64)
        owner: list[np.ndarray] = []
        rows = np.flatnonzero(plain)
        if len(rows):
            keep = plain[word] & (inside < stem[word])
            sym, last = self.inner[raw[keep]], np.cumsum(stem[rows]) - 1
            sym[last] = self.final[raw[keep][last]]
            flat, ends = self.table.merge(sym, stem[rows])
            n = np.diff(ends, prepend=0)
            ids.append(flat)
            owner.append(np.repeat(rows, n))
        rows = np.flatnonzero(plain & (stem < size))
        tail = np.zeros((len(rows), 4), dtype=np.uint8)
        n = (size - stem)[rows]
        for k in range(4):
            there = n > k
            tail[there, k] = raw[(begin + stem)[rows[there]] + k]
        kinds, back = np.unique(tail.view("<u4").reshape(-1), return_inverse=True)
        for k, kind in enumerate(kinds.tolist()):
            m = kind.to_bytes(4, "little").rstrip(b"\0").decode()
            if m not in self.of_marks:
                self.of_marks[m] = self._library([m])[0]
            own, same = np.frombuffer(self.of_marks[m], "<u4"), rows[back == k]
            ids.append(np.tile(own, len(same)))
            owner.append(np.repeat(same, len(own)))
        rest = np.flatnonzero(~plain)
        texts = [words.raw[a:b].tobytes().decode("utf-8") for a, b in zip(words.start[which[rest]].tolist(), words.end[which[rest]].tolist())]
        for i, own in zip(rest.tolist(), self._library(texts)):
            own = np.frombuffer(own, "<u4")
            ids.append(own)
            owner.append(np.full(len(own), i))
        who = np.concatenate(owner) if owner else np.empty(0, dtype=np.int64)
        order = np.argsort(who, kind="stable")
        counts += np.bincount(who, minlength=len(which))
        return (np.concatenate(ids) if ids else np.empty(0, dtype=np.int64))[order], counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        words = Words([t.encode("utf-8") for t in texts])
        usual = np.ones(len(texts), dtype=bool)
        usual[words.strange] = False
        which = np.flatnonzero(usual[words.text])
        out: list[bytes] = [b""] * len(texts)
        if len(which):
            ids, n = self.flat.ids_of(words, which)
            raw = ids.astype("<u4").tobytes()
            per_text = np.bincount(words.text[which], n, len(texts)).astype(np.int64)
            cuts = (4 * np.cumsum(per_text)).tolist()
            out = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        odd = np.flatnonzero(~usual).tolist()
        # str.split() also splits at the four odd characters, which are no white space to the tokenizer
        for i, own in zip(odd, self.of_words([_WORDS.findall(t) if _ODD.search(t) else t.split() for t in (texts[i] for i in odd)])):
            out[i] = own
        return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


class Packer:
    """Packs examples that come one by one; pieces come out of ``pack``.

    A piece is (example, start, length, sequence, offset), an example the number that ``add`` gave it, each higher than the last. Examples of equal demand
    wait in one line, the lowest number first, so a placement costs as much as there are different demands, however many examples wait.
    """

    def __init__(self, first_sequence: int, max_tokens: int, max_segments: int, max_loss_tokens: int):
        if min(max_tokens, max_segments, max_loss_tokens) < 1:
            raise ValueError("limits are 1 at least")
        self.limits = np.array([max_tokens, max_segments, max_loss_tokens], dtype=float)
        self.sequence = first_sequence
        self.waiting = 0
        self.line_of: dict[tuple[int, int], int] = {}  # tokens and loss tokens -> line
        self.lines: list[list[tuple[int, int]]] = []  # heaps of (example, tokens of it that are placed)
        self.demand = np.empty((16, 3))
        self.alive = np.zeros(16, dtype=bool)
        self.loss: dict[int, np.ndarray] = {}  # running count of loss tokens, only where not all bear loss

    def add(self, example: int, tokens: int, loss: np.ndarray | None = None) -> None:
        if tokens == 0:
            return
        if loss is not None:
            self.loss[example] = np.cumsum(np.append(0, loss))
        self._wait(example, 0, tokens, self._loss_between(example, 0, tokens))
        self.waiting += tokens

    def _wait(self, example: int, start: int, tokens: int, loss: int) -> None:
        line = self.line_of.get((tokens, loss))
        if line is None:
            line = self.line_of[tokens, loss] = len(self.lines)
            self.lines.append([])
            if line == len(self.demand):
                self.demand, self.alive = np.concatenate([self.demand, self.demand]), np.append(self.alive, np.zeros(line, dtype=bool))
            self.demand[line] = tokens, 1, loss
        heapq.heappush(self.lines[line], (example, start))
        self.alive[line] = True

    def waiting_examples(self) -> set[int]:
        return {e for line in self.lines for e, _ in line}

    def _loss_between(self, example: int, start: int, end: int) -> int:
        run = self.loss.get(example)
        return end - start if run is None else int(run[end] - run[start])

    def _cut(self, example: int, start: int, end: int, left: np.ndarray) -> int:
        """Where the first limit is met."""
        end = min(end, start + int(left[0]))
        run = self.loss.get(example)
        if run is None:
            return min(end, start + int(left[2]))
        return min(end, int(np.searchsorted(run, run[start] + left[2], "right")) - 1)

    def _choose(self, left: np.ndarray) -> tuple[int, bool]:
        """The line whose demand has the largest product with what is left, of those that fit if any does; and whether it fits."""
        n = len(self.lines)
        demand, alive = self.demand[:n], self.alive[:n]
        product = np.where(alive, (demand / self.limits) @ (left / self.limits), -1.0)
        fits = alive & (demand <= left).all(axis=1)
        whole = bool(fits.any())
        if whole:
            product = np.where(fits, product, -1.0)
        best = np.flatnonzero(product == product.max())
        return int(best[0]) if len(best) == 1 else min(best.tolist(), key=lambda k: self.lines[k][0]), whole

    def pack(self, until: int) -> list[tuple[int, int, int, int, int]]:
        """Close sequences until at most ``until`` tokens wait."""
        out = []
        while self.waiting > until:
            left, placed = self.limits.copy(), []
            while left[0] >= 1 and left[1] >= 1 and self.waiting:
                line, whole = self._choose(left)
                example, start = self.lines[line][0]
                end = start + int(self.demand[line, 0])
                to = end if whole else self._cut(example, start, end, left)
                if to == start:
                    break
                used = self._loss_between(example, start, to)
                heapq.heappop(self.lines[line])
                self.alive[line] = bool(self.lines[line])
                if to < end:
                    self._wait(example, to, end - to, int(self.demand[line, 2]) - used)
                placed.append((example, start, to - start))
                left -= (to - start, 1, used)
                self.waiting -= to - start
            out += self._sequences(placed)
        kept = [(key, self.lines[k]) for key, k in self.line_of.items() if self.lines[k]]
        self.line_of, self.lines = {key: k for k, (key, _) in enumerate(kept)}, [line for _, line in kept]
        for k, (tokens, loss) in enumerate(self.line_of):
            self.demand[k] = tokens, 1, loss
        self.alive[:] = False
        self.alive[: len(kept)] = True
        live = self.waiting_examples() if self.loss else ()
        self.loss = {e: x for e, x in self.loss.items() if e in live}
        return out

    def _sequences(self, placed: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        """One sequence, if full; else as many as its length has binary ones, longest first."""
        total = sum(n for _, _, n in placed)
        sizes = [total] if total == self.limits[0] else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        room = offset = 0
        for example, start, n in placed:
            while n:
                if room == 0:
                    room, offset = sizes.pop(0), 0
                    sequence, self.sequence = self.sequence, self.sequence + 1
                take = min(n, room)
                yield example, start, take, sequence, offset
                start, n, room, offset = start + take, n - take, room - take, offset + take


def _packed(examples: Iterator[tuple[object, bytes, np.ndarray | None]], limits: tuple[int, int, int], window: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """examples: (id, ids, loss mask) of one task."""
    packer = Packer(TaskContext.get().partitionId() << 40, *limits)
    waiting: dict[int, tuple[object, bytes]] = {}

    def batch(pieces) -> pa.RecordBatch:
        rows = [(waiting[e][0], s, n, waiting[e][1][4 * s : 4 * (s + n)], len(waiting[e][1]) // 4, q, o) for e, s, n, q, o in pieces]
        cols = list(zip(*rows))
        kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    for n, (key, ids, loss) in enumerate(examples):
        waiting[n] = key, ids
        packer.add(n, len(ids) // 4, loss)
        if packer.waiting >= window:
            if pieces := packer.pack(window // 8):
                yield batch(pieces)
            live = packer.waiting_examples()
            waiting = {e: x for e, x in waiting.items() if e in live}
    if pieces := packer.pack(0):
        yield batch(pieces)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss_tokens: int = MAX_LOSS_TOKENS, window: int = WINDOW
) -> DataFrame:
    """Pieces of every document's ids and ``end_id``, all bearing loss: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    No token of the tokenizer may reach across white space; its file must lie at that path on every executor.
    """
    kind, end = docs.schema["doc_id"].dataType, np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TOKENIZERS:
            _TOKENIZERS[tokenizer_path] = WordTokenizer(tokenizer_path)
        own = _TOKENIZERS[tokenizer_path]

        def each():
            for batch in batches:
                for at, size in _portions(batch.column(1), 1 << 20):
                    part = batch.slice(at, size)
                    yield from zip(part.column(0).to_pylist(), (x + end for x in own.encode(part.column(1).to_pylist())), [None] * size)

        yield from _packed(each(), (max_tokens, max_segments, max_loss_tokens), window, to_arrow_type(kind))

    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, StructType([StructField("doc_id", kind), *StructType.fromDDL(_PIECE)]))


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss_tokens: int = MAX_LOSS_TOKENS, window: int = WINDOW) -> DataFrame:
    """The same for instruction data: (doc_id long, ids array<int>, loss array<boolean>), where loss marks the trainable ids.

    Null ids count as none, which give no piece; a null loss array means that all ids bear loss.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for key, ids, loss in zip(*(c.to_pylist() for c in batch.columns)):
                    yield key, np.array(ids or [], dtype="<u4").tobytes(), None if loss is None else np.array(loss, dtype=np.int64)

        yield from _packed(each(), (max_tokens, max_segments, max_loss_tokens), window, pa.int64())

    own = examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"), F.col("loss").cast("array<boolean>").alias("loss"))
    return own.mapInArrow(run, f"doc_id long, {_PIECE}")
