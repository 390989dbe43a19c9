"""One query per operator over the whole given tables, and the answers in SQL where there is one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm import (
    anchor_negatives, backoff_langid, block_mix, chunk_bpe, line_runs, logbilinear, minmax_hash, ownership, prefix_forest, pu_toxicity, rank_index_fim, risk_rules, sign_hash,
)
from driftgrid.llm.answers import SQL  # noqa: F401
from driftgrid.llm.common import ready, remainder, table

#: The vocabulary file of the byte-level BPE, read by the driver.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_ownership_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents; the owner of a document is its source, and each document a repository of it."""
    return ownership.digest(ownership.scan_secrets(table(ready(spark), sf_dir, "documents")))


def op2_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from two thirds of them."""
    docs = table(ready(spark), sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = backoff_langid.fit(docs.filter(~held_out))
    found = backoff_langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels outside the held-out fifth."""
    docs, labels = table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = pu_toxicity.fit(docs.filter(~held_out), labels.filter(~held_out))
    scored = pu_toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_logbilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents by word counts and by the neural model, learned from six sevenths of them."""
    docs = table(ready(spark), sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = logbilinear.fit(docs.filter(~held_out))
    scored = logbilinear.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 1, 2, 3 of their sources."""
    return block_mix.mix(table(ready(spark), sf_dir, "documents"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents without those that an earlier document holds."""
    kept = line_runs.dedup_lines(table(ready(spark), sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_sign_hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all vectors of a label."""
    return sign_hash.near_vectors(table(ready(spark), sf_dir, "embeddings"))


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents, by 4-word shingles."""
    return minmax_hash.near_documents(table(ready(spark), sf_dir, "documents"), words=4)


def bpe_digest(docs: DataFrame) -> DataFrame:
    """Ids of whole texts and their decoding, as digests."""
    ready(docs.sparkSession)
    ids = chunk_bpe.encode(docs, chunk_bpe.read_ranks(RANKS), public_tokenizers.PATTERN, decoded=True)
    return ids.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe_digest(table(ready(spark), sf_dir, "documents"))


def op10_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents, with thresholds from the labels per language."""
    docs, labels = table(ready(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = risk_rules.judge(docs, labels)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op11_anchor_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors, with the label of every seventh moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(ready(spark), sf_dir, "embeddings").withColumn("label", moved)
    return anchor_negatives.mine(vectors, F.col("id") % 100 == 0)


def op12_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return prefix_forest.nearest(table(ready(spark), sf_dir, "embeddings"))


def op13_rank_index_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for filling in the middle, and put together again."""
    made = rank_index_fim.fill_in_middle(table(ready(spark), sf_dir, "documents"))
    again = rank_index_fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ownership_secrets, op2_backoff_langid, op3_pu_toxicity, op4_logbilinear_lm, op5_block_mix,
        op6_line_runs, op7_sign_hash_vectors, op8_minmax_near_dedup, op9_chunk_bpe, op10_risk_rules,
        op11_anchor_negatives, op12_prefix_forest, op13_rank_index_fim,
    )
}
