"""Labelled and checksum finders against check digits worked out here."""
import random

from textsieve.operators import pii as PII

VALUES = dict(zip("ABCDEFGHJKLMNPRSTUVWXYZ0123456789", [1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9, *range(10)]))


def vin_ok(v):
    total = sum(VALUES[c] * w for c, w in zip(v, (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)))
    return v[8] == "0123456789X"[total % 11] and any(c.isalpha() for c in v) and any(c.isdigit() for c in v)


def routing_ok(d):
    return sum(int(c) * w for c, w in zip(d, [3, 7, 1] * 3)) % 10 == 0 and int(d) > 0


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: [(f.type, r.text[f.start:f.end]) for f in r.pii.findings] for r in PII.pii_scan(df).collect()}


def test_vin_check_digit(spark):
    rnd = random.Random(3)
    vins = ["".join(rnd.choice("ABCDEFGHJKLMNPRSTUVWXYZ0123456789") for _ in range(17)) for _ in range(400)]
    vins += ["1M8GDM9AXKP042788", "11111111111111111", "1HGCM82633A004352", "1HGCM82633A004353"]
    got = found(spark, [f"car {v} sold" for v in vins])
    for i, v in enumerate(vins):
        assert (("vin", v) in got[i]) == vin_ok(v), v
    assert sum(map(vin_ok, vins)) > 10


def test_routing_numbers_need_label_and_checksum(spark):
    rnd = random.Random(4)
    numbers = [f"{rnd.randrange(10 ** 9):09d}" for _ in range(200)] + ["021000021", "000000000"]
    got = found(spark, [f"Routing number: {d} end" for d in numbers] + [f"see {d} end" for d in numbers])
    for i, d in enumerate(numbers):
        assert any(t == "routing_number" for t, _ in got[i]) == routing_ok(d), d
        assert not any(t == "routing_number" for t, _ in got[i + len(numbers)])


def test_labelled_numbers(spark):
    cases = {"SWIFT code DEUTDEFF500 now": "swift_code", "bic: DEUTDEFF": "swift_code", "Account no. 1234567890123": "bank_account",
             "passport X1234567": "passport", "Driver's licence D1234567": "drivers_license"}
    got = found(spark, list(cases))
    for i, want in enumerate(cases.values()):
        assert [t for t, _ in got[i]] == [want]
    assert all(not x for x in found(spark, ["OVERRIDE DEUTDEFF500", "account closed", "passport please", None, "", "driver license"]).values())


def test_guards_lose_nothing(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += ["AKIA" + "A1" * 8, "ghp_" + "a1" * 18, "AIza" + "b" * 35, "xoxb-" + "1" * 12, "bearer " + "ab1" * 8, "-----BEGIN PRIVATE KEY-----",
              "ssh-rsa " + "Ab1" * 16, "eyJ" + "a" * 8 + ".eyJ" + "b" * 8 + "." + "c" * 8, "00:1A:2B:3C:4D:5E", "2001:db8::8a2e:370:7334"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(8)
    guarded = {r.i: r.f for r in df.select("i", PII.pii_findings("text").alias("f")).collect()}
    saved, PII._GUARDS_SQL = PII._GUARDS_SQL, {}
    try:
        plain = {r.i: r.f for r in df.select("i", PII.pii_findings("text").alias("f")).collect()}
    finally:
        PII._GUARDS_SQL = saved
    assert guarded == plain and sum(map(len, plain.values())) > 20
