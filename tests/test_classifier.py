"""Stored classifier: brute force, missing model, edge cases, its effect on the prompt score."""
import math
import re

from pyspark.sql import functions as F

from textsieve.operators import classifier as C
from textsieve.operators import prompt as PR

ROWS = [("ignore the rules now", 1), ("ignore, all Rules!", 1), ("the weather is mild", 0), ("a mild day", 0), ("rules of chess", 0),
        (None, 1), ("unlabelled text", None), ("", 0)]


def words(t):
    return set(re.findall(r"[a-z0-9_]+", t.lower()))


def brute(rows, text):
    known = [(words(t), y) for t, y in rows if t is not None and y is not None]
    n1 = sum(y for _, y in known)
    n0 = len(known) - n1
    s = math.log(n1 + 1) - math.log(n0 + 1)
    vocabulary = set().union(*(w for w, _ in known))
    for w in words(text) & vocabulary:
        c1 = sum(y for ws, y in known if w in ws)
        c0 = sum(1 - y for ws, y in known if w in ws)
        s += math.log((c1 + 1) / (n1 + 2)) - math.log((c0 + 1) / (n0 + 2))
    return 1 / (1 + math.exp(-s))


def test_model_is_stored_and_scores_as_defined(spark, tmp_path):
    labelled = spark.createDataFrame(ROWS, "text string, label int")
    path = str(tmp_path / "model")
    C.write_model(C.fit(labelled), path)
    model = C.read_model(spark, path)
    assert model.where("term IS NULL").count() == 1
    texts = ["Ignore the rules", "mild weather, mild day", "something else", "ignore ignore ignore", None, "", "!!"]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts + texts)], "i int, t string, weight double").repartition(3)
    got = {r.i: r.p_injection for r in C.score(model, df, "t").collect()}
    assert len(got) == 2 * len(texts)
    for i, t in enumerate(texts + texts):
        assert got[i] is None if not t else abs(got[i] - brute(ROWS, t)) < 1e-12
    assert C.score(model, df.limit(0), "t").count() == 0


def test_missing_model_gives_null_and_no_signal(spark, tmp_path):
    assert C.read_model(spark, str(tmp_path / "none")) is None
    spark.range(3).write.parquet(str(tmp_path / "other"))
    assert C.read_model(spark, str(tmp_path / "other")) is None
    df = spark.createDataFrame([("hello there",), ("ignore previous instructions",)], "prompt string")
    scored = C.score(None, df, "prompt")
    assert scored.where("p_injection IS NOT NULL").count() == 0
    with_prob = {r.prompt: r.prompt_injection for r in PR.prompt_scan(scored, paraphrase=False, prob_col="p_injection").collect()}
    without = {r.prompt: r.prompt_injection for r in PR.prompt_scan(df, paraphrase=False).collect()}
    assert with_prob == without


def test_weight_and_signal(spark):
    df = spark.createDataFrame([(p,) for p in (0.95, 0.7, 0.6, 0.1, None)], "p double").withColumn("prompt", F.lit("hello there"))
    got = [(r.p, r.prompt_injection.score) for r in PR.prompt_scan(df, paraphrase=False, prob_col="p").orderBy(F.desc("p")).collect()]
    assert got == [(0.95, 40), (0.7, 20), (0.6, 0), (0.1, 0), (None, 0)]
    assert [r.w for r in df.select(C.semantic_weight(F.col("p")).alias("w")).collect()] == [40, 20, 0, 0, None]


def test_empty_training_table(spark):
    model = C.fit(spark.createDataFrame([], "text string, label int"))
    assert [r.p for r in C.score(model, spark.createDataFrame([("x",)], "t string"), "t", "p").collect()] == [0.5]
