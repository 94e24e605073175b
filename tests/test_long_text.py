"""Nothing is cut: findings far into a long text, separated cards, own tokens."""
from pyspark.sql import functions as F

from textsieve.operators import pii


def test_findings_after_fifty_thousand_characters(spark):
    far = "word " * 12_000 + "card 4111 1111 1111 1111 or 4111-1111-1111-1111, call 212-555-0147 or +14155552671."
    df = spark.createDataFrame([(1, far)], "doc_id long, text string")
    r = pii.pii_scan(df).select("pii.*").first()
    assert [f.type for f in r.findings] == ["credit_card", "credit_card", "phone", "phone"]
    assert not any(c.isdigit() for c in r.sanitized_text)


def test_phone_forms(spark):
    forms = ["+14155552671", "4155552671", "+33 1 23 45 67 89", "(212) 555-0147", "212.555.0147", "+1 212-555-0147"]
    rows = [(i, f"call {f} now") for i, f in enumerate(forms)]
    got = pii.pii_scan(spark.createDataFrame(rows, "doc_id long, text string")).select("pii.findings").collect()
    assert all([f.type for f in r.findings] == ["phone"] for r in got)


def test_own_tokens(spark):
    df = spark.createDataFrame([(1, "mail jo@example.com")], "doc_id long, text string")
    r = pii.pii_scan(df, tokens={"email": "<mail>"}).select(F.col("pii.sanitized_text")).first()
    assert r[0] == "mail <mail>"
