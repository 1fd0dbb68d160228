"""Toxicity by class-conditional Kneser-Ney models of characters within words.

A word is a run of letters in lower case; its characters map to ``SYMBOLS`` symbols, the boundary among them. Each class has a model of the
next symbol after up to three: absolute discounting of the class's own counts, whose freed mass goes by a backoff model that both classes
share. That one is interpolated Kneser-Ney over the next symbol after two, one and none, from continuation counts (before how many different
symbols something stands) over all documents. A rare expression is so judged by what its class has seen of its parts, and where
neither class has seen the context, both say the same.

Of each word the two log-likelihoods are compared; a text's evidence is the mean, over its words, of the likelihood ratio, as a logarithm: so it is
normalised by length, and a few toxic words count in a long ordinary text. One logistic curve turns that number into a probability; it is fitted on
documents that the counts don't hold.

The classes' counts come from every labelled document outside the held-out fold but those that the curve is fitted to, which are at most
``SAMPLE / CALIBRATE`` in the order of a hash of the id; only these are broadcast. The shared counts cover every document. What reaches the driver, and
goes to each worker with the model, is a row for each different gram of the labelled documents (at most SYMBOLS**4, in prose a small part of that: 8 bytes for
the gram and 8 for its evidence), and at most SYMBOLS**3 shared ones.

Defined results: a null or empty text, or one without letters, has no evidence and is scored like any such text; repeated rows are scored
each, and count each where their id is labelled, but only one of an id tells the curve; a document without id is never learned from nor held out; without labels of both classes the score is the smoothed share of
label 1 (0.5 without any); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .piece_codec import _portions
from .shared import hash_sample, id_remainder, usable_labels

SAMPLE = 30_000
FOLDS, HELD_OUT = 5, 0
ACCEPT = 0.5
SYMBOLS, BITS = 64, 6
#: Symbols before the next one that the classes' models know; the shared model knows one less.
CONTEXT = 3
#: Every CALIBRATE-th labelled document may be kept from the counts, for the curve; SAMPLE / CALIBRATE at most are.
CALIBRATE = 3
#: A word's log-likelihood ratio counts no further than this.
MOST = 30.0
#: Of the curve's two numbers.
RIDGE = 0.01


def _symbol_table() -> np.ndarray:
    """Symbol of each character: 0 for what is no letter, 1 to 26 for a to z, a hashed one above for other letters."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x80, 0x20000):
        if chr(c).isalpha():
            out[c] = 27 + (c * 40503 >> 4) % (SYMBOLS - 27)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


_TABLE: list[np.ndarray] = []


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in one array, each text behind a boundary, and where each text starts."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    lower = [" " + (t or "").lower() for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "replace"), dtype=np.uint32)
    starts = np.cumsum([0, *map(len, lower)])[:-1]
    return _TABLE[0][codes], starts.astype(np.int64)


def _grams(s: np.ndarray, context: int) -> np.ndarray:
    """For each place, the symbol there after the ``context`` symbols before it, those before its word's boundary as 0."""
    out, open_ = s.astype(np.int64), s > 0
    # the end of a word is an event too, so a boundary sees the word before it
    for k in range(1, context + 1):
        before = np.zeros(len(s), dtype=np.int64)
        before[k:] = s[:-k]
        if k > 1:
            open_ = open_ & (last > 0)
        else:
            open_ = np.ones(len(s), dtype=bool)
        out |= np.where(open_, before, 0) << (BITS * k)
        last = before
    return out


def _events(s: np.ndarray) -> np.ndarray:
    """Places that count: letters, and boundaries right after one."""
    after = np.append(False, s[:-1] > 0)
    return np.flatnonzero((s > 0) | after)


@dataclass
class ToxicityModel:
    """Evidence of seen grams and of seen contexts (for unseen grams), and the curve."""

    grams: np.ndarray
    contexts: np.ndarray
    values: np.ndarray
    curve: tuple[float, float] = (0.0, 0.0)  # log odds: first + second * evidence of a text

    def _found(self, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the sorted table, -1 where it isn't."""
        if not len(table):
            return np.full(len(keys), -1)
        keys = keys.astype(table.dtype)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[at] == keys, at, -1)

    def evidence(self, s: np.ndarray) -> np.ndarray:
        """Of each place; 0 where nothing is known."""
        out, at = np.zeros(len(s)), _events(s)
        keys = _grams(s, CONTEXT)[at]
        hit = self._found(self.grams, keys)
        miss = np.flatnonzero(hit < 0)
        back = self._found(self.contexts, keys[miss] >> BITS)
        hit[miss] = np.where(back < 0, -1, back + len(self.grams))
        out[at] = self.values[hit]
        return out

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """The logarithm of the mean likelihood ratio of each text's words; 0 without words."""
        s, starts = symbols(texts)
        out = np.zeros(len(texts))
        begins = np.flatnonzero((s > 0) & ~np.append(False, s[:-1] > 0)) if len(s) else np.empty(0, dtype=np.int64)
        if len(begins):
            ratio = np.exp(np.clip(np.add.reduceat(self.evidence(s), begins), -MOST, MOST))
            first = np.searchsorted(begins, starts)
            last = np.append(first[1:], len(begins))
            some = np.flatnonzero(last > first)
            mean = np.add.reduceat(ratio, first[some]) / (last - first)[some]
            out[some] = np.log(mean)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        odds = self.curve[0] + self.curve[1] * self.of_texts(texts) if texts else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def fit_curve(self, evidence: np.ndarray, label: np.ndarray, rounds: int = 50) -> None:
        """Logistic regression on one number, by Newton's steps, a little drawn to a flat curve; it never falls."""
        shift, scale = (evidence.mean(), evidence.std() or 1.0) if len(evidence) else (0.0, 1.0)
        x = np.stack([np.ones(len(evidence)), (evidence - shift) / scale], axis=1)
        if len(set(label.tolist())) < 2:
            share = (label.sum() + 1) / (len(label) + 2)
            self.curve = float(np.log(share / (1 - share))), 0.0
            return
        w = np.zeros(2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            slope = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
            w -= np.linalg.solve(slope, x.T @ (p - label) + RIDGE * w)
        w[1] = max(0.0, w[1])
        self.curve = float(w[0] - w[1] * shift / scale), float(w[1] / scale)


def _shared_counts(docs: DataFrame) -> np.ndarray:
    """[b, a, x]: before how many different symbols (and at all) the symbol x after a after b stands, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SYMBOLS**4 // 8, dtype=np.uint8)  # two megabytes, one bit for each gram of four
        for batch in batches:
            for at, size in _portions(batch.column(0)):
                s, _ = symbols(batch.slice(at, size).column(0).to_pylist())
                new = np.zeros(SYMBOLS**4, dtype=bool)
                new[_grams(s, 3)[_events(s)]] = True
                seen |= np.packbits(new)
        found = np.flatnonzero(np.unpackbits(seen))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], ["gram"])

    grams = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int").distinct()
    rows = grams.groupBy((F.col("gram") % SYMBOLS**3).alias("g")).agg(F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros(SYMBOLS**3)
    for r in rows:
        out[r.g] = r.n
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def _interpolated(counts: np.ndarray, lower: np.ndarray, discount: float = 0.75) -> np.ndarray:
    """Over the last axis; lower: the distribution that the freed mass goes by."""
    total = counts.sum(axis=-1, keepdims=True)
    freed = discount * (counts > 0).sum(axis=-1, keepdims=True)
    return np.where(total > 0, (np.maximum(counts - discount, 0) + freed * lower) / np.maximum(total, 1), lower)


def shared_model(counts: np.ndarray) -> np.ndarray:
    """P(x | b, a) from continuation counts [b, a, x]."""
    two = (counts > 0).sum(axis=0).astype(float)
    one = (two > 0).sum(axis=0).astype(float)
    base = _interpolated(one, np.full(SYMBOLS, 1 / SYMBOLS))
    return _interpolated(counts, _interpolated(two, base[None, :])[None, :, :])


def _class_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all documents of ``labels`` (doc_id, label), and their counts by class [gram, class]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in _portions(batch.column(0)):
                part = batch.slice(at, size)
                s, starts = symbols(part.column(0).to_pylist())
                where = _events(s)
                label = np.repeat(np.array(part.column(1).to_pylist(), dtype=np.int64), np.diff(np.append(starts, len(s))))
                keys, n = np.unique(_grams(s, CONTEXT)[where] * 2 + label[where], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    # always a merge join: a broadcast of the labels would be of no bounded size, and the plan shall not change with it
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(labels.hint("merge"), "doc_id")
    got = own.select("text", "label").mapInArrow(run, "key long, n long")
    both = got.groupBy(F.shiftright("key", 1).alias("gram")).agg(*[F.sum(F.when(F.col("key") % 2 == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)])
    found = both.withColumn("gram", F.col("gram").cast("int")).orderBy("gram").toArrow()  # four symbols of six bits
    return found["gram"].to_numpy(), np.stack([found["n0"].to_numpy(), found["n1"].to_numpy()], axis=1)


def class_model(context: np.ndarray, n: np.ndarray, backoff: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each gram, and of each context the weight of the backoff there.

    context: which of ``contexts`` a gram's is; n: how often the class has the gram; backoff: what the shared model says of it.
    """
    ones, twos = (n == 1).sum(), (n == 2).sum()
    d = ones / (ones + 2 * twos) if ones else 0.5
    total = np.bincount(context, n, contexts)
    freed = d * np.bincount(context, n > 0, contexts)
    weight = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
    return np.where(n > 0, n - d, 0) / np.maximum(total[context], 1) + weight[context] * backoff, weight


def build(grams: np.ndarray, counts: np.ndarray, shared: np.ndarray) -> ToxicityModel:
    """The evidence tables; the curve is still to be fitted."""
    contexts, inverse = np.unique(grams >> BITS, return_inverse=True)
    backoff = shared.reshape(-1)[grams % SYMBOLS**3]
    p, weight = zip(*[class_model(inverse, counts[:, c].astype(float), backoff, len(contexts)) for c in (0, 1)])
    of_weight = [np.log(np.maximum(w, 1e-9)) for w in weight]
    values = np.concatenate([np.log(p[1]) - np.log(p[0]), of_weight[1] - of_weight[0], [0.0]])  # the last stands for what is unknown
    return ToxicityModel(grams.astype(np.int32), contexts.astype(np.int32), values)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    usable = usable_labels(labels, "toxic", FOLDS, HELD_OUT)
    chosen = hash_sample(usable.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE)) == 0), sample // CALIBRATE, "doc_id")
    counted = usable.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    model = build(*_class_counts(docs, counted), shared_model(_shared_counts(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in _portions(batch.column(0)):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(model.of_texts(part.column(0).to_pylist()))], ["id", "label", "x"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = own.select("text", F.xxhash64("doc_id").alias("id"), "label").mapInArrow(run, "id long, label int, x double")
    rows = sorted(found.groupBy("id").agg(F.max("label").alias("label"), F.max("x").alias("x")).collect())  # one row an id: as many as were chosen
    model.fit_curve(np.array([r.x for r in rows]), np.array([r.label for r in rows], dtype=float))
    return model


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, size in _portions(batch.column(1)):
                part = batch.slice(at, size)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()))], ["doc_id", "score"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
