"""Text classifier giving P(injection) from a stored model (X3), and its semantic weight.

A model is a table (term, weight): the terms' log-odds, and the intercept under the
term null.  `fit` makes one from a labelled table by counting (naive Bayes on the
distinct terms of a text, add-one smoothing), `write_model` and `read_model` keep it;
any other linear model fits the same table.  A text's score is the intercept plus the
weights of its distinct terms; the probability is its logistic.

Fail-soft: where the model cannot be read, or a text is null or empty, the probability
is null and adds no signal.

Scale: fitting is one aggregation of (term, label) with partial sums; scoring explodes
terms, joins the weights (Spark broadcasts them if they are small) and sums by text.
What is shuffled back is a number for each distinct text, known by 128 bits of its hash.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.functions import patterns as P
from textsieve.functions.arrays import explode_rows

_KEY = ["_c1", "_c2"]
MODEL_DDL = "term string, weight double"


def terms(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and _ of the lower-cased text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-zA-Z0-9_]+", -1), lambda t: t != ""))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """(term, weight) from rows with label 0 or 1; other labels and null texts do not count."""
    rows = (labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))
            .where("text IS NOT NULL AND y IN (0, 1)"))
    totals = rows.agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    seen = (explode_rows(rows, ["y"], terms(F.col("text")), "term").groupBy("term")
            .agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0")))
    n1, n0 = (F.coalesce(c, F.lit(0)) for c in ("n1", "n0"))
    weights = seen.join(F.broadcast(totals)).select(                                 # one row
        "term", (F.log((F.col("c1") + 1) / (n1 + 2)) - F.log((F.col("c0") + 1) / (n0 + 2))).alias("weight"))
    return weights.unionByName(totals.select(F.lit(None).cast("string").alias("term"),
                                             (F.log(n1 + 1) - F.log(n0 + 1)).alias("weight")))


def write_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored model, or None where there is none."""
    try:
        model = spark.read.parquet(path)
    except AnalysisException:
        return None
    return model.select("term", F.col("weight").cast("double").alias("weight")) if {"term", "weight"} <= set(model.columns) else None


def score(model: DataFrame | None, df: DataFrame, text_col: str, out_col: str = "p_injection") -> DataFrame:
    """Adds P(injection) of a text column, null without a model and for null or empty text."""
    if model is None:
        return df.withColumn(out_col, F.lit(None).cast("double"))
    keyed = df.withColumns({"_c1": F.xxhash64(F.col(text_col)), "_c2": F.xxhash64(F.lit(1), F.col(text_col))})
    texts = (keyed.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).groupBy(*_KEY).agg(F.first(text_col).alias("_t")))
    sums = (explode_rows(texts, _KEY, terms(F.col("_t")), "term").join(model.where("term IS NOT NULL"), "term")
            .groupBy(*_KEY).agg(F.sum("weight").alias("_s")))
    intercept = model.where("term IS NULL").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_i"))        # one row
    scored = (texts.select(*_KEY).join(sums, _KEY, "left").join(F.broadcast(intercept))
              .select(*_KEY, (1 / (1 + F.exp(-(F.coalesce("_s", F.lit(0.0)) + F.col("_i"))))).alias(out_col)))
    return keyed.join(scored, _KEY, "left").drop(*_KEY)


def semantic_weight(prob: Column) -> Column:
    """> 0.8 -> 40, > 0.6 -> 20, else 0; null -> null (no signal)."""
    return (F.when(prob.isNull(), F.lit(None))
            .when(prob > P.SEMANTIC_HIGH_PROB, P.SEMANTIC_HIGH_WEIGHT)
            .when(prob > P.SEMANTIC_MED_PROB, P.SEMANTIC_MED_WEIGHT).otherwise(0))
