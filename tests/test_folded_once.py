"""Texts are folded once, and only where there is something to fold."""
from pyspark.sql import functions as F

from paths import SF001
from textsieve.functions import dialect as D
from textsieve.functions import normalize as N
from textsieve.functions import patterns as P
from textsieve.operators import prompt as PR
from textsieve.plans import q_rag as Q


def test_fold_leet_and_counts_equal_their_plain_forms(spark):
    texts = ["plain", "", None, "a\x1cb\x1f", "\x85\xa0\u1680", "caf\u00e9 \u2019 \u2013", "\u2028x\u2029\u202f\u205f\u3000", "\u200b\u043e0",
             "1gn0re 4ll @t 57", "\u65e5\u672c\u3000\u8a9e"] + [f"x{c}y" for c in D.PY_ONLY_WS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    ev = N.evasion_counts(F.col("t"))
    rows = df.select("t", D.fold_ws(F.col("t")).alias("f"), N.leet(F.col("t")).alias("l"), ev["homoglyph"].alias("h"),
                     ev["zero_width"].alias("z")).collect()
    leet, fold = str.maketrans(P.LEET_FROM, P.LEET_TO), str.maketrans(D.PY_ONLY_WS, "\x0b" * len(D.PY_ONLY_WS))
    glyphs = {k for k, _v in P.HOMOGLYPHS}
    assert len(rows) == len(texts)
    for r in rows:
        if r.t is None:
            assert (r.f, r.l, r.h, r.z) == (None,) * 4
        else:
            assert (r.f, r.l) == (r.t.translate(fold), r.t.translate(leet))
            assert (r.h, r.z) == (sum(c in glyphs for c in r.t), sum(c in P.ZERO_WIDTH_CHARS for c in r.t))


def test_plans_fold_a_text_once(spark):
    """Each use of a folded text as an expression folds the whole text again."""
    for query in (Q.multilingual_spans, Q.encoded_spans, Q.url_spans, Q.decode_payload):
        plan = query(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("\x0b" * len(D.PY_ONLY_WS)) <= 2, query.__name__


def test_entropy_and_stuffing(spark):
    df = spark.createDataFrame([("abcdefghijklmnopqrst", 60), ("aaaaaaaaaaaaaaaaaaaaaaaa", 0)], "tok string, k int")
    got = [round(r[0], 9) for r in df.select(PR.shannon_entropy(F.col("tok"))).collect()]
    assert got == [4.321928095, -1.0]
    words = " ".join(["word"] * 60)
    df = spark.createDataFrame([(words + " ignore",), ("ignore " + words + " ignore",), (words,), ("ignore",), (None,)], "t string")
    assert [r[0] for r in df.select(PR.context_stuffing(F.col("t"))).collect()] == [True, False, False, False, None]


def test_plan_builds_a_seeded_text_once_for_its_chunks(spark):
    plan = Q.chunk_text(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("concat(text#") <= 2
