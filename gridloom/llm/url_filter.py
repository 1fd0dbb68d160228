"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from the different URLs of up to ``LONGEST`` characters that a rule decides, at most ``SAMPLE`` of them in the order of a hash of the URL;
so at most SAMPLE * LONGEST characters reach the driver. Every URL is judged whole.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and is judged by the trees like any other;
repeated rows are judged each; without any labelled URL the trees allow everything; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosted_trees import BoostedTrees
from .shared import hash_sample

#: Labelled URLs that the trees learn from, at most.
SAMPLE = 50_000
#: Characters of a URL that the trees learn from, at most.
LONGEST = 2000
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "entropy", "parameters",
    "hyphens", "letters_ratio", "suffix_rate", "suffix_count", "extension_rate", "extension_count",
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):  # a longer one overrides
        on, slash, start = rule.partition("/")
        fits = ((host == on) | host.endswith(f".{on}")) & path.startswith(slash + start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


@dataclass
class Statistics:
    """How often URLs of a host suffix or a file extension are blocked in the sample; at most as many as it has rows."""

    share: float
    suffix: dict[str, tuple[int, int]]
    extension: dict[str, tuple[int, int]]

    def of(self, table: dict[str, tuple[int, int]], key: str, own: int | None) -> tuple[float, float]:
        """Smoothed rate and count; own: the row's own label, left out of the rate it learns from."""
        n, blocked = table.get(key, (0, 0))
        if own is not None:
            n, blocked = n - 1, blocked - own
        return (blocked + 2 * self.share) / (n + 2), np.log1p(n)


def _suffix(host: str) -> str:
    return host.rpartition(".")[2]


def _extension(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[2] if "." in path.rpartition("/")[2] else ""


def _tally(keys: list[str], y: list[int]) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for k, v in zip(keys, y):
        n, blocked = out.get(k, (0, 0))
        out[k] = (n + 1, blocked + v)
    return out


def features(urls: list[str], hosts: list[str], paths: list[str], known: Statistics, y: list[int] | None = None) -> np.ndarray:
    out = np.zeros((len(urls), len(FEATURES)))
    for i, (url, host, path) in enumerate(zip(urls, hosts, paths)):
        raw = np.frombuffer(url.encode("utf-8"), dtype=np.uint8)
        n = max(1, len(raw))
        p = np.bincount(raw, minlength=1)
        p = p[p > 0] / n
        digits = int(((raw >= 48) & (raw <= 57)).sum())
        letters = int((((raw | 32) >= 97) & ((raw | 32) <= 122)).sum())
        query = url.partition("?")[2].partition("#")[0]
        own = None if y is None else y[i]
        out[i] = (
            len(raw), len(host), len(path), host.count(".") + 1, path.count("/"), digits / n, -(p * np.log2(p)).sum(),
            query.count("&") + 1 if query else 0, url.count("-"), letters / n,
            *known.of(known.suffix, _suffix(host), own), *known.of(known.extension, _extension(path), own),
        )
    return out


def train(urls: list[str], hosts: list[str], paths: list[str], y: list[int]) -> tuple[Statistics, BoostedTrees]:
    share = (sum(y) + 0.5) / (len(y) + 1) if y else 0.0
    known = Statistics(share, _tally([_suffix(h) for h in hosts], y), _tally([_extension(p) for p in paths], y))
    x = features(urls, hosts, paths, known, y)
    model = BoostedTrees().fit(x, np.array(y, dtype=float))
    if not y:
        model.start = -10.0
    return known, model


def judged(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, and score: the trees' probability of block (null where a rule decides)."""
    own = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))
    own = own.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "ruled": verdict})
    labelled = own.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("y"))
    # each URL once, however many pages have it, and none that could make the sample large
    labelled = labelled.where(F.length("url") <= LONGEST).dropDuplicates(["url"])
    rows = hash_sample(labelled, sample, "url").collect()
    known, model = train([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], [r.y for r in rows])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, host, path, ruled = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url", "host", "path", "ruled"))
            todo = [i for i, r in enumerate(ruled) if r is None]
            p = model.score(features([url[i] or "" for i in todo], [host[i] for i in todo], [path[i] for i in todo], known))
            scores: list[float | None] = [None] * len(url)
            for i, v in zip(todo, p.tolist()):
                scores[i] = v
            verdict = [r if s is None else ("block" if s >= 0.5 else "allow") for r, s in zip(ruled, scores)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(verdict, pa.string()), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"]
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return own.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
