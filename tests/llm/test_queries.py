"""The registered queries, as registered, against their contracts written out plainly, on the smallest tables."""

import collections
import hashlib
import os
import zlib

import numpy as np
import pytest
import xxhash

from gridloom.llm import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def rows_of(spark, name):
    return queries.QUERIES[name](spark, SMALL).collect()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def held(doc_id, parts, out):
    return zlib.crc32(str(doc_id).encode()) % parts == out


@pytest.mark.parametrize("name, parts, out, accept", [("op1_quality_gam", 4, 2, 0.7), ("op5_toxicity_lm", 5, 0, 0.5)])
def test_scores(spark, texts, name, parts, out, accept):
    rows = rows_of(spark, name)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == held(r.doc_id, parts, out) and 0 <= r.score <= 1 and r.predicted == int(r.score >= accept) for r in rows)


def test_op2(spark, texts):
    def fingerprint(text):
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {i: fingerprint(t) for i, t in texts.items()}
    least = {i: i for i in want}
    near = [(i, j) for i in want for j in want if i < j and (want[i] ^ want[j]).bit_count() <= 3]
    for _ in want:
        before = dict(least)
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows_of(spark, "op2_simhash_dedup")}
    assert got == {i: (f"{want[i]:016x}", least[i]) for i in want}


def test_op3(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = (u @ u.T >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in rows_of(spark, "op3_embedding_dedup")}
    assert {r.vec_id for r in table} == set(got) and all(got[r.vec_id].n_links <= k for r, k in zip(table, n.tolist()))
    assert sum(r.n_links for r in got.values()) >= 0.9 * n.sum() and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    ids = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 2], dtype="<u4") for i, t in texts.items()}
    seen, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows_of(spark, "op4_packing"):
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces, total in [*((seen[i], len(x)) for i, x in ids.items()), *((p, None) for p in sequences.values())]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == total if total is not None else at <= 4096 and at & (at - 1) == 0


def test_op6(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    for r in rows_of(spark, "op6_piece_codec"):
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_op7(spark, texts):
    raws = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter()
    for raw in raws.values():
        seen.update(xxhash.xxh3_128_digest(raw[j : j + 400]) for j in range(len(raw) - 399))
    rows = rows_of(spark, "op7_suffix_dedup")
    assert len(rows) == len(raws)
    for r in rows:
        raw = raws[r.doc_id]
        edge = np.zeros(len(raw) + 1, dtype=np.int64)
        for j in range(len(raw) - 399):
            if seen[xxhash.xxh3_128_digest(raw[j : j + 400])] > 1:
                edge[j] += 1
                edge[j + 400] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), spans, sha(kept))
        assert (r.text == texts[r.doc_id]) == (r.n_passages == 0)


def test_op8(spark, texts):
    import re

    plain = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t) for i, t in texts.items()}
    groups = collections.defaultdict(list)
    for i, t in plain.items():
        groups[t].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows_of(spark, "op8_exact_dedup")}
    assert got == {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in plain.items()}


def test_op9(spark):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    rows = rows_of(spark, "op9_url_filter")
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        url = urls[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end : min([k for k in (rest.find(c, end) for c in "?#") if k >= 0], default=len(rest))]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_op10(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    talks = collections.defaultdict(list)
    for r in rows:
        talks[r.conv_id].append((r.turn, r.role, r.text or ""))
    said = r"\### Assistant: </turn> ok"
    talks[-7] = [(0, "user", said), (1, "assistant", said)]
    got = {r.conv_id: r for r in rows_of(spark, "op10_chat_format")}
    assert set(got) == set(talks)
    for i, turns in talks.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want = len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), sha(loss)
        assert (got[i].n_turns, got[i].turns_sha256, got[i].loss_chars, got[i].loss_sha256) == want
