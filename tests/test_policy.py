"""Policy arithmetic against the plain definitions."""
import random

from pyspark.sql import functions as F

from textsieve.operators import policy as POL


def test_combine_score_closed_form(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.randint(0, 100) for _ in range(rnd.randint(0, 6))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, s array<int>")
    got = {r.i: r.c for r in df.select("i", POL.combine_score(F.col("s")).alias("c")).collect()}
    for i, s in rows:
        if not s:
            exp = 0
        else:
            top, *rest = sorted(s, reverse=True)
            exp = min(100, top + sum(int(x * 0.25) for x in rest))
        assert got[i] == exp


def test_weights_and_rules(spark):
    df = spark.createDataFrame([(35, True, "admin", "external_pdf"), (35, True, "guest", ""),
                                (70, False, "admin", "external_pdf"), (90, True, "admin", "external_pdf")],
                               "s int, m boolean, role string, src string")
    got = [r[0] for r in df.select(POL.apply_weights(F.col("s"), F.col("m"), F.col("role"), F.col("src"))).collect()]
    assert got == [round(35 * 1.3 * 1.5), 35, 70, 100]
    t = spark.createDataFrame([(["pii", "prompt_injection"],), (["pii"],), (["prompt_injection", "rag_injection"],)],
                              "tags array<string>")
    acts = [r[0] for r in t.select(POL.compound_action(F.col("tags"))).collect()]
    assert acts == ["block", None, "block"]
