"""Registered queries: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import alignment, audio, chat, decontam, licenses, lm, mixing, neardup, pii, secrets, structure, tokens, toxicity
from docloom.llm.common import table

TOKENS = tokens.Tokens(public_tokenizers.path("word_bpe_49k.json"))
ALIGNMENT = alignment.Alignment(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan all documents for secrets: by the fixed rules with a new ledger, then by the further rules only, over what it doesn't have."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    known = secrets.addresses(docs)
    ledger, _ = secrets.scan(docs, rules=secrets.BASE, known=known)
    _, found = secrets.scan(docs, ledger, known=known)
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(F.col("path").alias("doc_id"), *[count(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE], F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' token ids as flat files and read them back."""
    return tokens.read_shards(tokens.write_shards(table(spark, sf_dir, "documents"), TOKENS))


def op3_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all documents as sound and compute its features from the stored media."""
    out = audio.features(audio.store(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.size("segments"), F.sha2(F.to_json("segments"), 256), F.sha2("tensors", 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest licence of all documents."""
    return licenses.best_license(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents by source."""
    out = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find personal data in all documents."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal_data(docs, pii.trained(docs))
    digest = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold all documents against all benchmark items."""
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.concat_ws(",", "items"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render all conversations from each participant's perspective."""
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link all near-duplicate documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearDup(shingle=2))


def op11_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage all conversations and repair them."""
    turns = table(spark, sf_dir, "conversations")
    found = structure.digest(structure.repair(structure.damage(turns))).withColumnRenamed("conv_id", "_conv")
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts] + [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")]
    return given.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *filled)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align two tokenizers over all documents."""
    return alignment.align(table(spark, sf_dir, "documents"), ALIGNMENT)[0]


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn a language model from the documents outside the held-out fold and score all of them."""
    docs = table(spark, sf_dir, "documents")
    scored = lm.score(docs, lm.fit(docs.where(~lm.held_out(F.col("doc_id")))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secrets, op2_token_ids, op3_audio, op4_licenses, op5_toxicity, op6_source_mix, op7_personal_data, op8_decontamination, op9_perspectives, op10_near_duplicates, op11_structure, op12_alignment, op13_language_model)
}
