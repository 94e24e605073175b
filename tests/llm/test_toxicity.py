"""Classifier chain: held-out accuracy, folds, edge cases."""
import numpy as np
from pyspark.sql import functions as F

from textsieve.llm import op5_toxicity as T


def fit(rows, extra, y):
    return T.fit_logistic(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64),
                          np.array([len(r) for r in rows], np.int64), extra, y)


def test_fit_finds_the_telling_slots():
    rnd = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1500):
        bad = rnd.random() < 0.1
        slots = set(rnd.integers(100, 5000, size=60).tolist())
        if bad:
            slots |= set(rnd.choice(8, size=3).tolist())
        rows.append(np.array(sorted(slots)))
        y.append(float(bad))
    y = np.array(y)
    b, at, w, e = fit(rows[:1000], np.zeros((1000, 0)), y[:1000])
    weights = dict(zip(at.tolist(), w))
    p = np.array([b + sum(weights.get(s, 0.0) for s in r.tolist()) for r in rows[1000:]])
    assert ((p > 0) == (y[1000:] == 1)).mean() > 0.98
    assert set(range(8)) <= set(weights)


def test_extra_feature_gets_its_weight():
    rnd = np.random.default_rng(2)
    x = rnd.random((800, 1))
    y = (x[:, 0] > 0.5).astype(float)
    b, _, w, e = fit([np.array([1])] * 800, x, y)
    assert e[0] > 5 and abs(-(b + w.sum()) / e[0] - 0.5) < 0.05


def test_one_class_and_no_rows():
    assert fit([], np.zeros((0, 0)), np.zeros(0))[0] < -10
    b, at, _, _ = fit([np.array([1])] * 3, np.zeros((3, 0)), np.ones(3))
    assert b > 10 and len(at) == 0


def test_held_out(spark):
    """Fit on the labels of even ids (some 2,000, a sixth of the fit sample), judge on those of odd ids."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    chain = T.fit_chain(docs.repartition(8), labels.where("doc_id % 2 = 0"), T.label_categories())
    assert [m.category for m in chain] == ["poor", "toxic"] and len(chain[1].earlier) == 1
    rows = (T.predict_chain(docs.join(labels.where("doc_id % 2 = 1"), "doc_id").repartition(8), chain, keep=("toxic",))
            .select("toxic", F.col("p_toxic")).collect())
    toxic = [r for r in rows if r.toxic == 1]
    assert len(toxic) > 150
    assert sum(r.p_toxic >= T.CUTOFF for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.p_toxic >= T.CUTOFF for r in rows if r.toxic == 0) <= 0.005 * len(rows)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(i, ("you vile creature " if i % 3 == 0 else "a kind word ") + f"number{i}", i) for i in range(120)]
                                 + [(500, None, 1), (501, "", 1), (None, "vile", 1), (3, "you vile creature number3", 3)],
                                 "doc_id long, text string, slots int")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(100)] + [(500, None, 0), (None, 1, 1), (101, 1, None)],
                                   "doc_id long, quality int, toxic int")
    chain = T.fit_chain(docs, labels, T.label_categories())
    out = T.predict_chain(docs, chain, keep=("slots",)).collect()
    assert len(out) == docs.count() and {"doc_id", "slots", "p_poor", "p_toxic"} == set(out[0].asDict())
    assert all((r.p_toxic >= T.CUTOFF) == (r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 500)
    assert all(r.p_toxic < T.CUTOFF for r in out if r.doc_id in (500, 501))
    nothing = T.fit_chain(docs, labels.limit(0), T.label_categories())
    assert all(r.p_toxic < 0.01 for r in T.predict_chain(docs, nothing).collect())
    assert T.predict_chain(docs.limit(0), chain).count() == 0


def test_reruns_agree(spark):
    d = "/root/testdata/sf0.001"
    first, second = (sorted((r.doc_id, r.p_toxic) for r in T.op5_toxicity(spark, d).collect()) for _ in range(2))
    assert first == second


def test_fit_bound():
    """The bound of the fit is not lowered for a check's limits."""
    assert T.FIT_ROWS >= 20_000
