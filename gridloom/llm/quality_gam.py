"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature has a lookup table over its quantile bins, and so have the pairs of features that explain most of what is left. Boosting goes
round the features, one after the other, each time fitting a tree of two cuts to the gradients summed by bin and adding a small
part of it to the feature's table; then round the pairs, with trees of one cut a side. A score is the sum of the tables' entries,
found for all documents of a batch at once. Features describe the whole text only; labels, lang, source and ids are never among them.

The model learns from at most ``SAMPLE`` labelled documents, in the order of a hash of the id; that sample is broadcast.

Defined results: a null text counts as empty, which is scored like any other; repeated rows are scored each; a document without id is never
learned from nor held out; without labels of both classes the score is the smoothed share of label 1 (0.5 without any); other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_trees import quantile_edges, sigmoid
from .shared import bounded_labels, id_remainder

#: Labelled documents that the model learns from, at most.
SAMPLE = 30_000
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "repeated_neighbours", "repeated_second",
    "upper", "digits", "stops", "bangs", "symbols", "bars", "other_bytes", "lines_per_word", "distinct_lines", "controls",
)


def _byte_classes() -> np.ndarray:
    kinds = np.zeros(256, dtype=np.int64)  # 0: letters that aren't upper case
    for kind, members in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"-()", "!", "#$%&*+/<=>@\\^_`~{}[]", "|", " \t\n\r\x0b\x0c"), 1):
        kinds[[ord(c) for c in members]] = kind
    kinds[128:] = 8
    kinds[[b for b in range(32) if kinds[b] == 0] + [127]] = 9
    return kinds


_KINDS = _byte_classes()


def describe(text: str | None) -> tuple[float, ...]:
    """The features of one text."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    kind = np.bincount(_KINDS[np.frombuffer(raw, dtype=np.uint8)], minlength=10)
    words, lines = raw.split(), raw.split(b"\n")
    w = len(words)
    counts = Counter(words)
    seen = max(1, n - int(kind[7]))
    letters = max(1, int(kind[0] + kind[1] + kind[8]))
    return (
        np.log1p(n), np.log1p(w), seen / max(1, w) if n else 0.0, np.log1p(max(map(len, words), default=0)), len(counts) / max(1, w) * np.log1p(w),
        max(counts.values(), default=0) / max(1, w), sum(map(bytes.__eq__, words, words[1:])) / max(1, w), sum(map(bytes.__eq__, words, words[2:])) / max(1, w),
        kind[1] / letters, kind[2] / seen, kind[3] / seen, kind[4] / seen, kind[5] / seen, kind[6] / seen, kind[8] / seen,
        len(lines) / max(1, w), len(set(lines)) / len(lines), kind[9] / seen,
    )


@dataclass
class PairwiseGam:
    """start + sum of tables[j][bin j] + sum of pair_tables[k][bin a, bin b] is the log-odds of class 1."""

    bins: int = 32
    pair_bins: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    n_pairs: int = 8
    rate: float = 0.15
    ridge: float = 1.0
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        columns = range(x.shape[1])
        self.edges = [quantile_edges(x[:, j], self.bins) if len(y) else np.empty(0) for j in columns]
        self.pair_edges = [quantile_edges(x[:, j], self.pair_bins) if len(y) else np.empty(0) for j in columns]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs, self.pair_tables = [], []
        if len(y) == 0 or y.min() == y.max():
            return self
        binned, score = self._binned(x, self.edges), np.full(len(y), self.start)
        for _ in range(self.rounds):
            for j in columns:
                p = sigmoid(score)
                g, h = (np.bincount(binned[j], v, len(self.tables[j])) for v in (y - p, p * (1 - p)))
                step = self.rate * self._two_cuts(g, h)
                self.tables[j] += step
                score += step[binned[j]]
        coarse = self._binned(x, self.pair_edges)
        self.pairs = self._strongest(coarse, y, score)
        self.pair_tables = [np.zeros((len(self.pair_edges[a]) + 1, len(self.pair_edges[b]) + 1)) for a, b in self.pairs]
        for _ in range(self.pair_rounds):
            for (a, b), own in zip(self.pairs, self.pair_tables):
                g, h = self._by_pair(coarse, a, b, y, score)
                _, step = self._quadrants(g, h)
                own += self.rate * step
                score += self.rate * step[coarse[a], coarse[b]]
        return self

    @staticmethod
    def _binned(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]

    def _gain(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g**2 / (h + self.ridge)

    def _cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """The best place for one cut of some bins, and what it gains; 0 bins to its left if none does."""
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        if not len(gl):
            return 0.0, 0
        gain = self._gain(gl, hl) + self._gain(g.sum() - gl, h.sum() - hl) - self._gain(g.sum(), h.sum())
        at = int(gain.argmax())
        return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)

    def _two_cuts(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of at most three leaves over the bins: its value in each."""
        _, first = self._cut(g, h)
        sides = [(0, first), (first, len(g))] if first else [(0, len(g))]
        second = [self._cut(g[a:b], h[a:b]) for a, b in sides]
        k = int(np.argmax([s[0] for s in second]))
        if second[k][1]:
            a, b = sides[k]
            sides[k : k + 1] = [(a, a + second[k][1]), (a + second[k][1], b)]
        out = np.empty(len(g))
        for a, b in sides:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.ridge)
        return out

    def _by_pair(self, binned: list[np.ndarray], a: int, b: int, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(self.pair_edges[a]) + 1, len(self.pair_edges[b]) + 1
        p, at = sigmoid(score), binned[a] * m + binned[b]
        return tuple(np.bincount(at, v, n * m).reshape(n, m) for v in (y - p, p * (1 - p)))

    def _quadrants(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best tree of one cut a side: what it gains, and its values."""
        if min(g.shape) < 2:
            return 0.0, np.zeros(g.shape)
        cg, ch = (v.cumsum(0).cumsum(1) for v in (g, h))
        gain = np.zeros((g.shape[0] - 1, g.shape[1] - 1))
        parts = []
        for c in (cg, ch):
            ll, l, r, t = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
            parts.append((ll, l - ll, r - ll, t - l - r + ll))
        for pg, ph in zip(*parts):
            gain += self._gain(pg, ph)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        out = np.empty(g.shape)
        for rows in (slice(0, i + 1), slice(i + 1, None)):
            for cols in (slice(0, j + 1), slice(j + 1, None)):
                out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + self.ridge)
        return float(gain[i, j]), out

    def _strongest(self, binned: list[np.ndarray], y: np.ndarray, score: np.ndarray) -> list[tuple[int, int]]:
        n = len(binned)
        gains = [(self._quadrants(*self._by_pair(binned, a, b, y, score))[0], a, b) for a in range(n) for b in range(a + 1, n)]
        return [(a, b) for gain, a, b in sorted(gains, reverse=True)[: self.n_pairs] if gain > 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        out = np.full(len(x), self.start)
        for own, at in zip(self.tables, self._binned(x, self.edges)):
            out += own[at]
        if self.pairs:
            coarse = self._binned(x, self.pair_edges)
            for (a, b), own in zip(self.pairs, self.pair_tables):
                out += own[coarse[a], coarse[b]]
        return sigmoid(out)


def _sample_features(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(map(float, describe(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    own = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    kind = own.schema["doc_id"].dataType.simpleString()
    found = own.mapInArrow(run, f"doc_id {kind}, label int, x array<double>")
    # one row an id, however many rows have it
    rows = sorted(found.groupBy("doc_id").agg(F.min(F.struct("label", "x")).alias("one")).select("doc_id", "one.*").collect())
    return np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.label for r in rows], dtype=float)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> PairwiseGam:
    return PairwiseGam().fit(*_sample_features(docs, bounded_labels(labels, "quality", sample, FOLDS, HELD_OUT)))


def scored(docs: DataFrame, model: PairwiseGam) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([describe(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs, train(docs, labels))
    held = F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, accept: float) -> DataFrame:
    """The rows of ``docs`` whose text scores ``accept`` or more, with all their columns."""
    model = train(docs, labels)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            x = np.array([describe(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= accept))

    return docs.mapInArrow(run, docs.schema)
