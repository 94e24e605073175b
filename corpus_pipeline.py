"""Corpus pipeline: toxicity, line dedup, near-duplicates, source mix, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``, the first four of them with
what the stage changed (text and n_chars), and only the rows it keeps.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.llm import op3_jaccard, op5_toxicity, op6_bpe, op8_lines, op9_mixing
from textsieve.llm.common import table
from textsieve.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a toxic probability of at least ``op5_toxicity.CUTOFF`` go.

    The chain is fitted on the labelled rows of ``docs``."""
    chain = op5_toxicity.toxicity_chain(spark, sf_dir, docs)
    scored = op5_toxicity.predict_chain(docs, chain, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    return scored.where(F.col("p_toxic") < op5_toxicity.CUTOFF).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: later copies of repeated line runs are cut out; a document of which nothing is left goes."""
    cut = op8_lines.dedup_lines(docs, extra=("lang", "source", "n_chars"))
    gone = (F.col("n_deleted") > 0) & (F.trim(F.col("text")) == "")
    n_chars = F.when(F.col("n_deleted") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.where(~F.coalesce(gone, F.lit(False))).withColumn("n_chars", n_chars).select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of linked documents the one with the smallest id stays, once.

    Documents without words or without id are in no group and all stay."""
    groups = op3_jaccard.jaccard_join(docs).where("n_shingles > 0 AND doc_id IS NOT NULL")
    lost = groups.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(lost, "doc_id", "left_anti").select(*COLUMNS)
    repeated = groups.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    once = (left.join(repeated, "doc_id", "left_semi").groupBy("doc_id")
            .agg(F.min(F.struct(*[c for c in COLUMNS if c != "doc_id"])).alias("row")).select("doc_id", "row.*"))
    return left.join(repeated, "doc_id", "left_anti").unionByName(once.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: each document appears as often as the mix takes it (0 to 3 times)."""
    chosen = op9_mixing.mix(docs).where("copies > 0").select("k1", "k2", "copies")
    named = docs.select(*COLUMNS, *op9_mixing.keys("doc_id", "source", "text"))
    return (named.join(chosen, ["k1", "k2"])
            .select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: ids of every document, with digests of ids and of the decoded bytes."""
    return op6_bpe.encode(docs, public_tokenizers.path(op6_bpe.RANKS), digests=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", keep_one_of_group),
          ("source_mix", mix_sources), ("tokens", tokenize)]

#: Fitted models and hashes decide in stages 1 and 4, which SQL cannot express; tests check every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns lies as Parquet under spark.checkpoint.dir."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
