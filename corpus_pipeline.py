"""A training-corpus pipeline: five stages, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.ngram_join import ngram_jaccard
from palimpsest.llm.packing import pack
from palimpsest.llm.positional import decontaminate
from palimpsest.llm.quality import held_out, score_quality, train
from palimpsest.llm.secrets import redact
from palimpsest.plans.stage import stage

# A document below this chance of label 1 goes.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out("doc_id")), "doc_id", "text", "quality")
    # Texts travel beside their statistics, so nothing is joined back.
    scored = score_quality(docs, model, docs.columns, out="__score")
    return scored.where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of linked ones.

    Linked as the operator's contract has it: four words, 85 of 100. Documents of
    one id stay or go together, different texts both; equal ones are one, also without an id.
    """
    groups = ngram_jaccard(docs)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    single = docs.join(kept, "doc_id", "left_semi")
    # A document that has no id links with nothing; equal texts of one id, or of none, are one.
    rest = single.unionByName(docs.where(F.col("doc_id").isNull()))
    rest = rest.withColumn("__text", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["doc_id", "__text"])
    return rest.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    A document without an id, or of an id that others have too, is judged by its own text.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # A row's name holds its text, so that rows without an id, or of one id, are told apart.
    named = docs.withColumn("__row", F.xxhash64(F.lit("stage"), F.col("doc_id"), F.col("text")))
    marked = decontaminate(named, items, key="__row").where("contaminated").select("__row").distinct()
    return named.join(marked, "__row", "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets that look live replaced; lengths follow."""
    clean = redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 1024."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written for the next and removed when the session ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


# SQL has no words for the classifier and the tokenizer; tests compare with brute force.
ORACLE_SQL = None
