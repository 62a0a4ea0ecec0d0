"""Corpus pipeline: toxicity, line dedup, near-dedup, mixing and packing.

Every stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``:

1. toxicity: documents that the string-kernel model scores 0.7 or more go;
2. line_dedup: aligned common blocks are cut from the later document and
   ``n_chars`` follows; a document of which a fifth or less is left was a near copy and goes;
3. near_dedup: of every group of near duplicates (five words, 0.8) the smallest id stays;
4. mixing: all rows, in files whose numbers and rows follow the mixture;
5. packing: one row per piece of a training sequence; ascending sequence ids follow the mixture.

Null and empty texts pass every stage; packing gives them the end id alone.
Further columns of ``docs`` are kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateql.llm import linededup, mixing, packing, settings, survivors, toxicity
from slateql.llm.exprs import fresh
from slateql.sources.shared import new_folder, remove


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    name = fresh(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs, labels), keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) < settings.TOXIC_FROM).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "cut")
    cut = linededup.cut_lines(docs, linededup.line_cuts(docs), name=name)
    gone, left = F.col(f"{name}.chars"), F.length("text")
    enough = F.col("text").rlike(r"[^\x20\x09-\x0D]") & (100 * left.cast("bigint") > (100 - settings.NEAR_PERCENT) * (left + gone).cast("bigint"))
    kept = cut.where((F.col(f"{name}.lines") == 0) | enough)
    n_chars = F.when(F.col(f"{name}.lines") > 0, left.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return survivors.drop_near_duplicates(docs, percent=settings.NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "mixed")
    mixed = mixing.mix(docs, settings.SOURCE_WEIGHTS, settings.OTHER_WEIGHT, name=name)
    place = [f"{name}.slot", f"{name}.within"]
    return mixed.repartitionByRange(*place).sortWithinPartitions(*place).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(docs, settings.TOKENIZER, in_file_order=True, cached_words=settings.PIPELINE_WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A kernel machine, patience alignment and tokenization are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    A stage's result lies in the cluster's shared folder until the next one is written; the last, which the
    DataFrame returned reads, until ``slateql.sources.shared.remove_folders`` is called.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
