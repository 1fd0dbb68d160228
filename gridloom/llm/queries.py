"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, exact_dedup, packing, piece_codec, quality_gam, simhash_dedup, suffix_dedup, toxicity_lm, url_filter
from .shared import corpus, table


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.judged(corpus(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(corpus(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(corpus(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(corpus(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_toxicity_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_lm.judged(corpus(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(corpus(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: how many passages repeat (runs of 50 words, most of them under 400 bytes), and the text without them."""
    docs = corpus(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.without_repeats(docs, passage=suffix_dedup.PASSAGE)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
        F.col("left_over").alias("text"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(corpus(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(corpus(spark, sf_dir, "pages")).drop("score")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = corpus(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    back = chat_format.read_back(chat_format.examples(turns.unionByName(more)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {
    "op1_quality_gam": op1_quality_gam,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "op5_toxicity_lm": op5_toxicity_lm,
    "op6_piece_codec": op6_piece_codec,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_chat_format": op10_chat_format,
}

_ESC = r"regexp_replace({}, '(\\|### |</turn>)', '\\\1', 'g')"
ORACLE_SQL = {
    "op8_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS plain FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(plain) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY plain)""",
    "op10_chat_format": rf"""
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        o AS (
          SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                 sum(4 + length(role) + 2 + length({_ESC.format("text")}) + 9) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
          FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
        FROM o GROUP BY conv_id""",
}
