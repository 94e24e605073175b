"""Detectors and where they run.

A detector is an object with a ``name`` and ``findings(df, text_col)``, which adds a struct
column of that name: matched, score (0 to 100), evidence (array of short texts, never
the matched value itself) and sanitized_text (null if the detector does not redact).
A `Registry` holds the detectors of each surface in the order they run; `analyze`
folds over it, so another detector is one ``register`` call.

`results` makes whatever a detector returns safe: a null or empty text is unmatched, nulls are
no match, scores are clamped, and of an unmatched result only the sanitized text counts.
"""
from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textsieve.operators import pii as PII
from textsieve.operators import prompt as PR
from textsieve.operators import rag as RAG
from textsieve.operators import similarity as SIM

SURFACES = ("prompt", "doc")
RESULTS_DDL = "array<struct<ord:int,tag:string,matched:boolean,score:int,evidence:array<string>,sanitized_text:string>>"


class Detector(Protocol):
    name: str

    def findings(self, df: DataFrame, text_col: str) -> DataFrame: ...


class PromptInjection:
    name = "prompt_injection"

    def __init__(self, paraphrase: bool = True, prob_col: str | None = None):
        self.paraphrase, self.prob_col = paraphrase, prob_col

    def findings(self, df: DataFrame, text_col: str) -> DataFrame:
        df = PR.prompt_scan(df, text_col, paraphrase=self.paraphrase, prob_col=self.prob_col)
        return df.withColumn(self.name, F.col(self.name).withField("sanitized_text", F.lit(None).cast("string")))


class PersonalData:
    name = "pii"

    def findings(self, df: DataFrame, text_col: str) -> DataFrame:
        return PII.pii_scan(df, text_col)


class DocumentInjection:
    name = "rag_injection"

    def __init__(self, similarity: Callable[[DataFrame, str], DataFrame] | None = SIM.with_template_similarity,
                 doc_id_col: str | None = None, trusted_ids=()):
        self.similarity, self.doc_id_col, self.trusted_ids = similarity, doc_id_col, trusted_ids

    def findings(self, df: DataFrame, text_col: str) -> DataFrame:
        return RAG.rag_scan(df, text_col, doc_id_col=self.doc_id_col, similarity=self.similarity, trusted_ids=self.trusted_ids)


class Registry:
    """Detectors by surface, in run order."""

    def __init__(self):
        self._of: dict[str, list[Detector]] = {s: [] for s in SURFACES}

    def register(self, surface: str, detector: Detector) -> Registry:
        if surface not in self._of:
            raise ValueError(f"no surface {surface!r}: {', '.join(SURFACES)}")
        if any(d.name == detector.name for d in self._of[surface]):
            raise ValueError(f"{detector.name!r} already runs on {surface}")
        self._of[surface].append(detector)
        return self

    def of(self, surface: str) -> list[Detector]:
        return list(self._of[surface])

    def routes(self, spark: SparkSession) -> DataFrame:
        """Which detector runs on which surface, in run order."""
        rows = [(s, d.name, i) for s, ds in self._of.items() for i, d in enumerate(ds)]
        return spark.createDataFrame(rows, "surface string, detector string, ord int")


def default_registry(paraphrase: bool = True, similarity: bool = True, prob_col: str | None = None) -> Registry:
    """Prompts: prompt injection, then personal data; documents: document injection."""
    docs = DocumentInjection(SIM.with_template_similarity if similarity else None)
    return (Registry().register("prompt", PromptInjection(paraphrase, prob_col)).register("prompt", PersonalData())
            .register("doc", docs))


def results(df: DataFrame, text_col: str, detectors: list[Detector], out: str) -> DataFrame:
    """Runs the detectors one after the other and adds ``out``, the array of their results in run order:
    struct(ord, tag, matched, score, evidence, sanitized_text)."""
    text = F.col(text_col)
    has_text = text.isNotNull() & (text != "")

    def safe(i: int, name: str) -> Column:
        r = F.col(name)
        matched = F.coalesce(has_text & r["matched"], F.lit(False))
        return F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("tag"), matched.alias("matched"),
            F.when(matched, F.least(F.greatest(F.coalesce(r["score"].cast("int"), F.lit(0)), F.lit(0)), F.lit(100)))
            .otherwise(0).alias("score"),
            F.when(matched, F.coalesce(r["evidence"], F.array().cast("array<string>")))
            .otherwise(F.array().cast("array<string>")).alias("evidence"),
            r["sanitized_text"].cast("string").alias("sanitized_text"))

    for d in detectors:
        df = d.findings(df, text_col)
    names = [d.name for d in detectors]
    return df.withColumn(out, F.array(*[safe(i, n) for i, n in enumerate(names)]).cast(RESULTS_DDL)).drop(*names)
