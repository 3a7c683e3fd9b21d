"""Registered queries of the subpackage, one for each operator.

Each applies its operator to its whole table and derives the digest columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    decontamination,
    jaccard_join,
    lm_scoring,
    oracles,
    quality_classifier,
    quality_rules,
    ranked_search,
    secret_scans,
    simhash,
    source_mix,
    substring_dedup,
    token_counts,
    warc,
    whitening,
)
from codeloom.llm.common import crc_mod
from codeloom.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


@query("op2_secret_scans")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scans.find_secrets(docs, redact=False)
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_confirmed"
    )


@query("op3_substring_dedup", oracles.SUBSTRING_DEDUP)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest")))
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))


@query("op4_jaccard_join", oracles.JACCARD_JOIN)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "n_linked_sets")


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    held_out = crc_mod("doc_id", 3) == 1
    trees = quality_classifier.learn(docs, labels, rows=~held_out)
    scored = quality_classifier.score_quality(docs.withColumn("held_out", held_out), trees)
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op6_decontamination", oracles.DECONTAMINATION)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@query("op7_warc", oracles.WARC)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/llm/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    read = warc.read_warc(spark, path)
    page, first = (warc.id_of(F.col(c)).try_cast("long") for c in ("record_id", "refers_to"))
    digest = F.substring("payload_digest", len("sha1:") + 1, 32)
    # payloads are measured anew; revisits state those of the full payload
    full = F.coalesce("payload", F.lit(b""))
    responses = read.where("record_type = 'response'").select(
        page.alias("page_id"),
        F.octet_length(full).cast("long").alias("payload_bytes"),
        warc.base32_sha1(full).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = (
        warc.read_warc(spark, path, payloads=False)
        .where("record_type = 'revisit'")
        .select(page.alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", first.alias("refers_to"))
    )
    return responses.unionByName(revisits)


@query("op8_lm_scoring")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 10) == 0
    model = lm_scoring.train(docs, rows=~held_out, order=3)
    return lm_scoring.score_texts(docs.withColumn("held_out", held_out), model)


@query("op9_source_mix", source_mix.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return source_mix.mix_sources(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_quality_rules", oracles.QUALITY_RULES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality_rules.line_frequency_rules(docs, keep_text=False).drop("source", "removed_lines")


@query("op11_ranked_search", ranked_search.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.rank_documents(docs, table(spark, sf_dir, "benchmark"))


@query("op12_simhash", simhash.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
