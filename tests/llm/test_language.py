"""Language ID: held-out accuracy, encoder algebra, edge cases."""
import numpy as np
from pyspark.sql import functions as F

from textsieve.llm import op1_language as L


def test_gram_vector_is_product_of_rotated_letters():
    e = L.Encoder(dim=64)
    g = e.grams("abc")
    a, b, c = (e._letter_vector(ord(x)).astype(int) for x in "abc")
    boundary = e._letter_vector(0).astype(int)
    expected = {tuple(np.roll(x, 2) * np.roll(y, 1) * z) for x, y, z in
                [(boundary, a, b), (a, b, c), (b, c, boundary)]}
    assert {tuple(r) for r in e.gram_matrix(g).astype(int)} == expected
    total = e.bundle(np.zeros(len(g), int), g, 1)[0]
    assert (total == np.sum([list(x) for x in expected], axis=0)).all()


def test_bundle_over_blocks_equals_direct_sum(monkeypatch):
    e = L.Encoder(dim=32)
    g = e.grams("the quick brown fox jumps over the lazy dog and much more besides")
    whole = e.bundle(np.zeros(len(g), int), g, 1)
    monkeypatch.setattr(L, "_BLOCK_GRAMS", 7)
    assert (e.bundle(np.zeros(len(g), int), g, 1) == whole).all()


def test_held_out_accuracy(spark):
    r = L.op1_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = r.where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 150
    assert sum(x.lang == x.lang_pred for x in rows) >= 0.97 * len(rows)
    assert all(0 <= x.score <= 1 for x in rows)


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score double, lang_pred string"
    docs = spark.createDataFrame(
        [(1, "the cat and the dog", "en", 0.0, "x"), (2, "le chat et la souris", "fr", 0.0, "x"),
         (3, None, "en", 0.0, "x"), (4, "", None, 0.0, "x"), (5, "123 !!", "fr", 0.0, "x"), (None, "the dog", None, 0.0, "x"),
         (6, "the dog " * 20000, None, 0.0, "x"), (6, "the dog " * 20000, None, 0.0, "x")], schema)
    model = L.train(docs)
    assert sorted(model) == ["en", "fr"]
    out = L.predict(docs, model, keep={"odd": F.col("doc_id") % 2 == 1}).collect()
    by = {}
    for x in out:
        by.setdefault(x.doc_id, []).append(x)
    assert [by[i][0].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "fr", "und", "und", "und"]
    assert by[3][0].score == 0 and by[None][0].lang_pred == "en" and len(by[6]) == 2
    assert by[6][0].lang_pred == "en"
    assert {x.lang_pred for x in L.predict(docs, {}).collect()} == {"und"}
    empty = docs.limit(0)
    assert L.train(empty) == {} and L.predict(empty, model).count() == 0
