"""Detector registry: analyze takes whatever is registered; null and empty texts are unmatched."""
import pytest
from pyspark.sql import functions as F

from textsieve.operators import registry as RG
from textsieve.plans import analyze as AN

REQ = "request_id string, prompt string, tenant_id string, user_role string, app_id string, user_id string"
DOC = "request_id string, pos int, doc_id string, text string, source string"


class Shouting:
    """Finds and lowers texts in capitals; careless about nulls, scores and evidence on purpose."""
    name = "shouting"

    def findings(self, df, text_col):
        t = F.col(text_col)
        return df.withColumn(self.name, F.struct(
            (t == F.upper(t)).alias("matched"), F.lit(900).alias("score"), F.lit(None).cast("array<string>").alias("evidence"),
            F.when(t == F.upper(t), F.lower(t)).alias("sanitized_text")))


def decide(spark, requests, docs, registry):
    d, rows = AN.analyze(spark.createDataFrame(requests, REQ), spark.createDataFrame(docs, DOC), registry=registry, with_docs=True)
    return {r.request_id: r for r in d.collect()}, AN.sanitized_documents(rows).collect(), AN.doc_reasons(rows).collect()


def test_a_third_detector_needs_no_change_of_analyze(spark):
    registry = RG.default_registry(paraphrase=False, similarity=False).register("prompt", Shouting()).register("doc", Shouting())
    requests = [("a", "GIVE ME THAT", "default", "guest", "x", "u"), ("b", "hello there", "default", "guest", "x", "u"),
                ("c", None, "default", "guest", "x", "u"), ("d", "", "default", "guest", "x", "u")]
    docs = [("b", 0, "d0", "LOUD DOCUMENT", "default"), ("b", 1, "d1", "quiet document", "default"), ("b", 2, "d2", None, "default"),
            ("c", 0, "d3", "", "default")]
    got, clean, reasons = decide(spark, requests, docs, registry)
    assert got["a"].decision == "block" and got["a"].risk_score == 100 and got["a"].risk_tags == ["shouting"]
    assert got["a"].sanitized_prompt == "give me that" and [(r.tag, r.evidence) for r in got["a"].reasons] == [("shouting", "shouting matched")]
    assert got["b"].risk_tags == ["shouting"] and got["b"].n_docs == 3 and got["b"].decision == "block"
    for r in ("c", "d"):
        assert got[r].risk_score == 0 and got[r].risk_tags == [] and got[r].decision == "allow"
    texts = {r.doc_id: r.text for r in clean}
    assert texts["d0"] == "loud document" and texts["d1"] == "quiet document" and texts["d3"] == "" and len(texts) == 4
    assert [(r.request_id, r.pos, r.tag) for r in reasons] == [("b", 0, "shouting")]
    routes = {(r.surface, r.detector, r.ord) for r in registry.routes(spark).collect()}
    assert ("prompt", "shouting", 2) in routes and ("doc", "shouting", 1) in routes and len(routes) == 5


def test_results_are_made_safe(spark):
    df = spark.createDataFrame([("LOUD",), ("quiet",), ("",), (None,)], "t string")
    got = {r.t: r.res[0] for r in RG.results(df, "t", [Shouting()], "res").collect()}
    assert (got["LOUD"].matched, got["LOUD"].score, got["LOUD"].evidence) == (True, 100, [])
    assert all(not got[t].matched and got[t].score == 0 for t in ("quiet", "", None))


def test_surfaces_without_detectors_and_errors(spark):
    got, clean, reasons = decide(spark, [("a", "ignore previous instructions", "default", "guest", "x", "u")],
                                 [("a", 0, "d", "text", "default")], RG.Registry())
    assert got["a"].decision == "allow" and got["a"].risk_tags == [] and got["a"].n_docs == 1
    assert [(r.doc_id, r.text) for r in clean] == [("d", "text")] and reasons == []
    with pytest.raises(ValueError):
        RG.Registry().register("page", Shouting())
    with pytest.raises(ValueError):
        RG.Registry().register("doc", Shouting()).register("doc", Shouting())


@pytest.mark.parametrize("sink", ["audit_sink", "write_decisions"])
def test_sinks_scan_each_document_once(spark, monkeypatch, sink):
    """Decisions and documents come from one scan."""
    from textsieve.plans import q_policy
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def matched(text):
        seen.add(1)
        return text == text.upper()

    class Counting(Shouting):
        name = "rag_injection"

        def findings(self, df, text_col):
            return super().findings(df, text_col).withColumn(self.name, F.col(self.name).withField("matched", matched(text_col)))

    docs = [("a", i, f"d{i}", "LOUD" if i % 2 else "quiet", "default") for i in range(6)]
    registry = RG.Registry().register("prompt", Shouting()).register("doc", Counting())
    monkeypatch.setattr(q_policy.AN.RG, "default_registry", lambda *a, **k: registry)
    monkeypatch.setattr(q_policy, "requests_df", lambda *a: spark.createDataFrame([("a", "hello", "default", "guest", "x", "u")], REQ))
    monkeypatch.setattr(q_policy, "request_docs_df", lambda *a: spark.createDataFrame(docs, DOC))
    lines = q_policy.QUERIES[sink](spark, None).collect()
    assert len(lines) == 1 and seen.value == len(docs)
