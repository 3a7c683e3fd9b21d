"""A training corpus in five stages, each one operator over all that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import crc_mod, staged
from codeloom.llm.decontamination import decontaminate
from codeloom.llm.jaccard_join import jaccard_classes
from codeloom.llm.quality_classifier import learn, score_quality
from codeloom.llm.secret_scans import find_secrets
from codeloom.llm.source_mix import emitted, mix_sources

#: SQL has no trees and no min-hash; the stages are tested against brute force.
ORACLE_SQL = None

_MARK = "__mark"  # tells rows apart that share a doc_id


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn(_MARK, F.xxhash64("text"))


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left[_MARK] == right[_MARK])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier predicts to be of label 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = learn(docs, labels, rows=crc_mod("doc_id", 3) != 1)
    return score_quality(docs, trees).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays;
    equal rows are one document. Rows without words or id are their own."""
    rows = _marked(docs)
    classes = jaccard_classes(rows.select("doc_id", _MARK, "text"))
    named = F.col("class_set").isNotNull() & F.col("class_id").isNotNull()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _MARK)).alias("first")
    best = classes.where(named).groupBy("class_set").agg(first).select("first.doc_id", f"first.{_MARK}")
    own = classes.where(~named).select("doc_id", _MARK)
    stay = best.unionByName(own).distinct()
    kept = rows.join(stay, _same(rows, stay), "left_semi")
    return kept.dropDuplicates(["doc_id", _MARK]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    rows = _marked(docs)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(rows.select("doc_id", _MARK, "text"), bench).where("contaminated").select("doc_id", _MARK)
    return rows.join(found, _same(rows, found), "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets inside the texts; every document stays."""
    found = find_secrets(docs)
    size = F.when(F.col("spans") != "", F.char_length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": size, "text": F.col("redacted")}).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy of a document that the mix takes."""
    return emitted(mix_sources(docs)).select(*docs.columns, "size", "source_size", "target", "copy")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, each to the written result of the
    one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        docs = result if number == len(STAGES) - 1 else staged(result, f"stage-{number}")
    return docs
