"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text is cut where no piece of the vocabulary reaches across: before a run of word marks, and around characters that stand in no longer
piece. The cuts ("words") that a task has not met lately are merged together, in rounds over flat arrays (merge_rounds.py). A word of more than ``LONG``
characters is cut as well between any two that stand side by side in no piece; what is still long then and mostly repeats one character is
merged run by run. So memory goes with ``CHUNK`` and a text's own size, but for a word of over ``CHUNK`` characters that has neither such places nor such runs,
which takes about 60 bytes a character while it is merged.

Defined results: a null text counts as empty, which has no ids and decodes to the empty text; control strings in a text are ordinary text;
repeated rows are coded each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .merge_rounds import MergeTable, WordMemory

MARK = "▁"
#: Characters of text that are cut into words, and of words that are merged, at once, about.
CHUNK = 1 << 19
#: Characters from which on a word is cut between characters that no piece has side by side.
LONG = 1000
#: Longer words of at most RUNS runs of equal characters are merged run by run.
RUNS = 512
#: Ids that are turned to text at once.
IDS = 1 << 18


class PieceCodec:
    """The merge table of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        if any(model.is_unused(i) for i in plain):
            raise ValueError("models with unused pieces are not supported")
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("models with pieces across words are not supported")
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.symbol = {pieces[i]: i for i in plain}
        #: Symbols from ``n`` on are characters that are no piece: first those of longer pieces, then strange ones of a text.
        self.pieces, self.size = pieces, n
        self.extra: dict[str, int] = {}
        for i in plain:
            for c in pieces[i]:
                if c not in self.symbol:
                    self.extra.setdefault(c, self.size + len(self.extra))
        self.fixed = n + len(self.extra)
        score = {i: model.get_score(i) for i in plain}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        table: dict[tuple[int, int], tuple[int, int]] = {}
        for i in plain:
            p = pieces[i]
            for at in range(1, len(p)):
                left, right = self._known(p[:at]), self._known(p[at:])
                if left is not None and right is not None:
                    table[left, right] = ranks[score[i]], i
        self.table = MergeTable(table)
        longer = {c for i in plain if len(pieces[i]) > 1 for c in pieces[i]}
        #: Any two characters that stand side by side in a piece.
        self.beside = np.unique(np.array([(ord(a) << 32) | ord(b) for i in plain for a, b in zip(pieces[i], pieces[i][1:])] or [-1], dtype=np.int64))
        alone = "\n" if "\n" not in longer else ""
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|{alone}" if alone else ""))
        self.boundary = re.compile(f"[^{MARK}](?={MARK})" + (f"|{alone}" if alone else ""))
        self.of_words = WordMemory(self.merge)
        self.decimal: list[str] = []
        as_bytes = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.decoded = [as_bytes.get(i) or (pieces[i].replace(MARK, " ").encode() if i in score else b"") for i in range(n)]

    def _known(self, text: str) -> int | None:
        return self.symbol.get(text, self.extra.get(text))

    def merge(self, words: list[str]) -> Iterator[bytes]:
        """The ids of each non-empty word, as little-endian 32-bit integers."""
        batch: list[str] = []
        n = 0
        for word in words:
            if batch and (n + len(word) > CHUNK or len(word) > LONG):
                yield from self._merged(batch)
                batch, n = [], 0
            if len(word) > LONG:
                yield self._long(word)
            else:
                batch.append(word)
                n += len(word)
        if batch:
            yield from self._merged(batch)

    def _long(self, word: str) -> bytes:
        """The same for one long word, in parts that no piece reaches across."""
        out: list[bytes] = []
        parts: list[str] = []
        begin = n = 0

        def end_part(end: int) -> None:
            nonlocal begin, n
            if n and n + end - begin > CHUNK:
                out.append(b"".join(self._merged(parts)))
                parts.clear()
                n = 0
            if end - begin > LONG and (runs := _runs(word, begin, end)):
                out.append(b"".join(self._merged(parts) if parts else []))
                parts.clear()
                out.append(self._of_runs(*runs))
                begin, n = end, 0
                return
            parts.append(word[begin:end])
            begin, n = end, n + end - begin

        for at in range(0, len(word), CHUNK):
            codes = np.frombuffer(word[at : at + CHUNK + 1].encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            beside = (codes[:-1] << 32) | codes[1:]
            where = np.minimum(np.searchsorted(self.beside, beside), len(self.beside) - 1)
            for cut in (np.flatnonzero(self.beside[where] != beside) + at + 1).tolist():
                end_part(cut)
        end_part(len(word))
        out.append(b"".join(self._merged(parts) if parts else []))
        return b"".join(out)

    def _symbols(self, codes: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The symbol of each different character, and the byte ids that stand for the strange ones."""
        strange: dict[int, np.ndarray] = {}
        sym = np.empty(len(codes), dtype=np.int64)
        for i, c in enumerate(map(chr, codes.tolist())):
            at = self._known(c)
            if at is None:
                at = self.fixed + len(strange)
            if at >= self.size:
                strange[at] = self.byte_ids[np.frombuffer(c.encode(), np.uint8)]
            sym[i] = at
        return sym, strange

    def _of_runs(self, codes: list[int], counts: list[int]) -> bytes:
        distinct, back = np.unique(np.array(codes, dtype=np.uint32), return_inverse=True)
        sym, strange = self._symbols(distinct)
        flat = self.table.merge_runs(sym[back].tolist(), counts)
        return self._as_bytes(flat, np.array([len(flat)]), strange)[0]

    def _merged(self, words: list[str]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes, back = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32), return_inverse=True)
        sym, strange = self._symbols(codes)
        return self._as_bytes(*self.table.merge(sym[back], sizes), strange)

    def _as_bytes(self, flat: np.ndarray, ends: np.ndarray, strange: dict[int, np.ndarray]) -> list[bytes]:
        """Symbols of words that end at ``ends`` as ids, strange ones as their bytes'."""
        raw = flat.astype("<i4").tobytes()
        cuts = (4 * ends).tolist()
        done = [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        if strange and (odd := flat >= self.size).any():
            for w in np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right")).tolist():
                own = np.frombuffer(done[w], "<i4")
                size = np.ones(len(own), dtype=np.int64)
                kinds = [x for x in np.unique(own).tolist() if x in strange]
                for x in kinds:
                    size[own == x] = len(strange[x])
                full, first = np.repeat(own, size), np.cumsum(size) - size
                for x in kinds:
                    at = first[own == x]
                    for k, b in enumerate(strange[x].tolist()):
                        full[at + k] = b
                done[w] = full.astype("<i4").tobytes()
        return done

    def _chunks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > 2 * CHUNK:
            found = self.boundary.search(text, at + CHUNK)
            if found is None:
                break
            yield text[at : found.start() + 1]
            at = found.start() + 1
        yield text[at:]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        out: list[bytes] = []
        waiting: list[list[str]] = []
        n = 0

        def flush() -> None:
            nonlocal n
            out.extend(self.of_words(waiting))
            waiting.clear()
            n = 0

        for text in texts:
            if not text:
                waiting.append([])
                continue
            whole = MARK + text.replace(" ", MARK)
            if len(whole) <= 2 * CHUNK:
                waiting.append(self.words.findall(whole))
                n += len(whole)
                if n >= CHUNK:
                    flush()
                continue
            flush()
            parts = len(out)
            for chunk in self._chunks(whole):
                waiting.append(self.words.findall(chunk))
                flush()
            out[parts:] = [b"".join(out[parts:])]
        flush()
        return out

    def decoded_parts(self, ids: bytes) -> Iterator[str]:
        """The text of ids as ``encode`` gives them, in parts."""
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), 4 * IDS):
            raw = b"".join(map(self.decoded.__getitem__, np.frombuffer(ids[at : at + 4 * IDS], "<i4").tolist()))
            yield decoder.decode(raw[1:] if at == 0 and raw[:1] == b" " else raw)
        yield decoder.decode(b"", True)

    def decode(self, ids: bytes) -> str:
        return "".join(self.decoded_parts(ids))

    def digests(self, ids: bytes) -> tuple[int, str, str]:
        """Their number, and the SHA-256 of the decimal ids joined by commas and of the decoded text, made part by part."""
        if not self.decimal:
            self.decimal += [str(i) for i in range(self.size)]
        of_ids, of_text = hashlib.sha256(), hashlib.sha256()
        for at in range(0, len(ids), 4 * IDS):
            part = np.frombuffer(ids[at : at + 4 * IDS], "<i4").tolist()
            of_ids.update(("," * bool(at) + ",".join(map(self.decimal.__getitem__, part))).encode())
        for text in self.decoded_parts(ids):
            of_text.update(text.encode("utf-8"))
        return len(ids) // 4, of_ids.hexdigest(), of_text.hexdigest()


def _runs(word: str, begin: int, end: int) -> tuple[list[int], list[int]] | None:
    """Characters and lengths of the runs of equal ones; None if there are more than RUNS."""
    codes: list[int] = []
    counts: list[int] = []
    for at in range(begin, end, CHUNK):
        part = np.frombuffer(word[at : min(at + CHUNK, end)].encode("utf-32-le"), dtype=np.uint32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        if len(first) + len(codes) > RUNS:
            return None
        sizes = np.diff(np.append(first, len(part))).tolist()
        for c, n in zip(part[first].tolist(), sizes):
            if codes and codes[-1] == c:
                counts[-1] += n
            else:
                codes.append(c)
                counts.append(n)
    return codes, counts


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each Python worker and model."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _coded(docs: DataFrame, model_path: str, made: str, columns: Callable[[PieceCodec, list[bytes]], list[pa.Array]]) -> DataFrame:
    """doc_id and what ``columns`` makes of the ids of some texts; the model file must lie at that path on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for at, size in _portions(batch.column(1), 1 << 20):
                part = batch.slice(at, size)
                found = columns(own, own.encode(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names)

    own = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL(made)])
    names = schema.names
    return own.mapInArrow(run, schema)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text."""

    def columns(own: PieceCodec, ids: list[bytes]) -> list[pa.Array]:
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = np.frombuffer(b"".join(ids), "<i4")
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())]

    return _coded(docs, model_path, "ids array<int>, decoded string", columns)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same ids and decoded texts, which don't leave the worker."""

    def columns(own: PieceCodec, ids: list[bytes]) -> list[pa.Array]:
        n, of_ids, of_text = zip(*map(own.digests, ids))
        return [pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    return _coded(docs, model_path, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _portions(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least, so that a batch of long texts isn't held several times over."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, n = 0, 0
    for i, size in enumerate(sizes):
        if i > at and n + size > most:
            yield at, i - at
            at, n = i, 0
        n += size
    if len(sizes):
        yield at, len(sizes) - at
