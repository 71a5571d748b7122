"""From raw documents to a training mix: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontam, mixing, quality, suffix_dedup, superminhash
from pagemill.llm.common import shared_dir, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a passage that counts as repeated: fifty words of these languages are longer.
PASSAGE = 200


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows that aren't held out, doesn't reject.

    Each row is judged by its own text, null and empty ones as a text without
    words; repeated rows stay or go together, an empty table stays empty.
    """
    model = quality.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), model, "_score").where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies (shingles of five words, similarity 0.8).

    Of rows that agree in doc_id and text one stays, that of smallest lang,
    source and n_chars; rows without an id or without words stay as they are.
    """
    docs = docs.select(*COLUMNS)
    gone = stored(superminhash.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "near")
    again = stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    once = docs.join(gone.union(again).distinct(), "doc_id", "left_anti").select(*COLUMNS)
    rest = docs.join(again, "doc_id", "left_semi").join(gone, "doc_id", "left_anti")
    rest = rest.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r")).select("doc_id", "text", "r.*")
    return once.unionByName(rest)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document, or an earlier place, has; documents of which nothing is left go."""
    return suffix_dedup.without_later_copies(docs.select(*COLUMNS), PASSAGE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, each row by its own text, whatever its id.

    Null and empty texts hold none and stay; repeated rows stay or go together,
    an empty table stays empty, an empty benchmark drops nothing.
    """
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), carry=("lang", "source", "n_chars"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken (repeats counted) and their source's target.

    Rows without words give nothing and go; rows that agree in doc_id are taken
    one by one, in the order of their texts; a null source is one of its own.
    """
    return mixing.mixed(docs, carry=("text", "lang", "source", "n_chars")).where("taken > 0")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Classifier, suffix arrays and knapsack aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
