"""Personal-data and secret detection, merge, redaction and scoring (per row).

Every finder is a native regex span extraction (``regex_spans``) plus an
optional validator written with built-in functions (``luhn_check``, octet range,
IBAN mod-97, SSN area rules).  Findings of one row are merged, redacted and
scored inside that row, so a corpus scan is a map-only job: no shuffle, and the
text never leaves its partition.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textsieve.functions import dialect as D
from textsieve.functions.barrier import computed_once
from textsieve.functions import patterns as P
from textsieve.functions.merge import merge_overlaps, redact, span_list_repr
from textsieve.functions.spans import SPAN_TYPE, regex_spans_sql, sql_literal

FINDING_DDL = "struct<start:int,ord:int,end:int,type:string,confidence:double>"

# Own finder set.  The e-mail pattern is a fixed value; the others re-aim the
# phone library and the NER pattern recognizers as plain regexes (documented in
# README): (type, python-syntax regex, flags, confidence).
PHONE = (r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}\b"
         r"|(?:\([0-9]{2,4}\)[ .-]?|\b[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{4}\b"
         r"|\b[2-9][0-9]{2}[2-9][0-9]{6}\b")
CREDIT_CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
CARD_CONFIDENCE = 0.97          # a Luhn hit outranks a phone number inside it
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"
CRYPTO = (r"\b0x[0-9a-fA-F]{40}\b|\bbc1[ac-hj-np-z02-9]{11,71}\b"
          r"|\b[13][1-9A-HJ-NP-Za-km-z]{25,34}\b")
SECRETS = [
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,255}\b"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("slack_token", r"\bxox[abprs]-[0-9A-Za-z-]{10,72}"),
    ("bearer_token", r"\b[Bb]earer [A-Za-z0-9._~+/-]{20,}=*"),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("ssh_key", r"\bssh-(?:rsa|ed25519|dss) [A-Za-z0-9+/]{40,}={0,2}"),
    ("jwt_token", r"\beyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"),
    ("mac_address", r"\b(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\b"),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b"
             r"|\b[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?\b"),
]

# Numbers that mean nothing by themselves count with the label in front of them; a VIN has a check digit.
_LABEL = r"(?: (?:number|no\.?|code))?[ :#]{1,3}"
LABELLED = [
    ("routing_number", r"\b(?:routing|aba)" + _LABEL + r"[0-9]{9}\b", 0.9),
    ("swift_code", r"\b(?:swift|bic)" + _LABEL + r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.9),
    ("bank_account", r"\b(?:account|acct)" + _LABEL + r"[0-9]{8,17}\b", 0.9),
    ("passport", r"\bpassport" + _LABEL + r"[A-Z]?[0-9]{6,9}\b", 0.9),
    ("drivers_license", r"\bdriver(?:'?s)? licen[cs]e" + _LABEL + r"[A-Z][0-9]{5,13}\b", 0.9),
]
VIN = r"\b[A-HJ-NPR-Z0-9]{17}\b"

FINDERS = [
    # type, regex, flags, confidence
    ("email", P.EMAIL, "I", P.EMAIL_CONFIDENCE),
    ("phone", PHONE, "", P.PHONE_CONFIDENCE),
    ("credit_card", CREDIT_CARD, "", CARD_CONFIDENCE),
    ("ssn", SSN, "", 0.85),
    ("ip_address", IPV4, "", 0.85),
    ("iban", IBAN, "", 0.85),
    ("crypto_wallet", CRYPTO, "", 0.8),
] + [(t, p, "", 0.9) for t, p in SECRETS] + [(t, p, "I", c) for t, p, c in LABELLED] + [("vin", VIN, "", 0.9)]
STRUCTURED = ["credit_card", "ssn", "ip_address", "iban", "crypto_wallet", "bank_account", "passport", "drivers_license"]
SECRET_TYPES = [t for t, _p in SECRETS] + ["routing_number", "swift_code", "vin"]

# cheap literal guards: a row is only regex-scanned when its guard holds
_GUARDS_SQL = {
    "email": "contains({t}, '@')",
    "phone": "{t} RLIKE '[0-9]{{4}}|[+][0-9]'",
    "credit_card": "{t} RLIKE '[0-9](?:[ -]?[0-9]){{12}}'",
    "ssn": "{t} RLIKE '[0-9]-[0-9]{{2}}-[0-9]'",
    "ip_address": "{t} RLIKE r'[0-9]\\.[0-9]{{1,3}}\\.[0-9]'",
    "iban": "{t} RLIKE '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11}}'",
    "crypto_wallet": "{t} RLIKE '0x|bc1|[13][1-9A-HJ-NP-Za-km-z]{{25}}'",
    "aws_access_key": "(contains({t}, 'AKIA') OR contains({t}, 'ASIA'))",
    "github_token": "contains({t}, 'gh')",
    "google_api_key": "contains({t}, 'AIza')",
    "slack_token": "contains({t}, 'xox')",
    "bearer_token": "contains({t}, 'earer ')",
    "private_key": "contains({t}, 'PRIVATE KEY')",
    "ssh_key": "contains({t}, 'ssh-')",
    "jwt_token": "contains({t}, 'eyJ')",
    "mac_address": "contains({t}, ':')",
    "ipv6": "contains({t}, ':')",
    "routing_number": "{t} RLIKE '[0-9]{{9}}'",
    "swift_code": "{t} RLIKE '(?i)swift|bic'",
    "bank_account": "{t} RLIKE '[0-9]{{8}}'",
    "passport": "{t} RLIKE '[0-9]{{6}}'",
    "drivers_license": "{t} RLIKE '[0-9]{{5}}'",
    "vin": "{t} RLIKE '[A-HJ-NPR-Z0-9]{{17}}'",
}
_VIN_LETTERS, _VIN_VALUES = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
_VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
_VALIDATORS_SQL = {
    "phone": "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 7 AND 15",
    "credit_card": "luhn_check(regexp_replace(m, '[ -]', ''))",
    "ssn": ("substring(m, 1, 3) NOT IN ('000', '666') AND NOT startswith(substring(m, 1, 3), '9') "
            "AND substring(m, 5, 2) <> '00' AND substring(m, 8, 4) <> '0000'"),
    "ip_address": "forall(split(m, r'\\.'), o -> CAST(o AS INT) <= 255)",
    "iban": ("aggregate(split(array_join(transform(split(concat(substring(m, 5, 64), substring(m, 1, 4)), ''), "
             "c -> CASE WHEN c RLIKE '[A-Z]' THEN CAST(ascii(c) - 55 AS STRING) ELSE c END), ''), ''), 0, "
             "(acc, d) -> (acc * 10 + CAST(d AS INT)) % 97) = 1"),
    "routing_number": ("aggregate(zip_with(split(right(m, 9), ''), array(3, 7, 1, 3, 7, 1, 3, 7, 1), "
                       "(c, w) -> CAST(c AS INT) * w), 0, (a, x) -> a + x) % 10 = 0 AND right(m, 9) <> '000000000'"),
    "vin": (f"aggregate(zip_with(split(translate(m, '{_VIN_LETTERS}', '{_VIN_VALUES}'), ''), array({', '.join(map(str, _VIN_WEIGHTS))}), "
            "(c, w) -> CAST(c AS INT) * w), 0, (a, x) -> a + x) % 11 = "
            "CASE WHEN substring(m, 9, 1) = 'X' THEN 10 ELSE try_cast(substring(m, 9, 1) AS INT) END AND m RLIKE '[A-Z]' AND m RLIKE '[0-9]'"),
}


def pii_findings(text_col: str, finders=None) -> Column:
    """array<FINDING_DDL> of the raw findings of a column in generation order (before merge), built as one
    SQL expression (one parse instead of hundreds of driver round trips)."""
    finders = finders or FINDERS
    t = f"`{text_col}`"
    empty = f"CAST(array() AS {SPAN_TYPE})"
    parts = []
    for ord_, (ptype, pat, flags, conf) in enumerate(finders):
        jp = D.java(pat, flags)
        guard = _GUARDS_SQL.get(ptype, "TRUE").format(t=t)
        spans = f"CASE WHEN ({guard}) AND {t} RLIKE {sql_literal(jp)} THEN {regex_spans_sql(t, jp)} ELSE {empty} END"
        val = _VALIDATORS_SQL.get(ptype)
        if val is not None:
            m = f"substring({t}, s.start + 1, s.end - s.start)"
            spans = f"filter({spans}, s -> {_with_m(val, m)})"
        parts.append(f"transform({spans}, s -> named_struct('start', s.start, 'ord', {ord_}, 'end', s.end, "
                     f"'type', '{ptype}', 'confidence', CAST({conf} AS DOUBLE)))")
    return F.expr("flatten(array(" + ", ".join(parts) + "))")


def _with_m(val: str, m: str) -> str:
    """Substitute the match expression for the token ``m`` in a validator."""
    import re as _re
    return _re.sub(r"\bm\b", lambda _x: m, val)


def _lookup(pairs, key: Column, default) -> Column:
    m = F.create_map(*[x for k, v in pairs for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, key), default)


def pii_token(ptype: Column, overrides: dict[str, str] | None = None) -> Column:
    tokens = {**dict(P.PII_TOKENS), **(overrides or {})}
    return _lookup(tokens.items(), ptype, F.concat(F.lit("[REDACTED_"), F.upper(ptype), F.lit("]")))


def pii_weight(ptype: Column) -> Column:
    return _lookup(P.PII_WEIGHTS, ptype, F.lit(P.PII_UNKNOWN_TYPE_WEIGHT))


def pii_scan(df: DataFrame, text_col: str = "text", extra_findings: str | None = None,
             tokens: dict[str, str] | None = None) -> DataFrame:
    """Adds ``pii`` struct: matched, score, evidence, sanitized_text, merged findings.

    ``extra_findings``: optional column of external model findings (D5) in
    FINDING_DDL shape, merged with the regex findings.  ``tokens``: replacement
    per type, over the default ones.
    """
    t = F.col(text_col)
    raw = pii_findings(text_col)
    if extra_findings:
        raw = F.concat(raw, F.col(extra_findings))
    out = df.withColumn("_pii_raw", computed_once(raw))
    out = out.withColumn("_pii_merged", computed_once(merge_overlaps(F.col("_pii_raw"), FINDING_DDL, "confidence")))
    merged = F.col("_pii_merged")
    types = F.array_sort(F.array_distinct(F.transform(merged, lambda m: m["type"])))
    per_type = F.transform(types, lambda ty: F.struct(
        ty.alias("type"), F.filter(merged, lambda m: m["type"] == ty).alias("fs")))
    out = out.withColumn("_pii_types", computed_once(per_type))
    pt = F.col("_pii_types")
    score = F.least(F.lit(P.PII_MAX_SCORE), F.aggregate(
        F.transform(pt, lambda x: pii_weight(x["type"]) + F.least(F.size(x["fs"]) - 1, F.lit(4))
                    * F.floor(pii_weight(x["type"]) / 2).cast("int")), F.lit(0), lambda a, b: a + b))
    evidence = F.transform(pt, lambda x: F.concat(
        F.lit("type="), x["type"], F.lit(" count="), F.size(x["fs"]).cast("string"),
        F.lit(" spans="), span_list_repr(x["fs"])))
    matched = F.size(merged) > 0
    empty = t.isNull() | (t == "")
    result = F.struct(
        (matched & ~empty).alias("matched"),
        F.when(empty | ~matched, 0).otherwise(
            F.when(score == 0, P.PII_DEFAULT_SCORE).otherwise(score)).cast("int").alias("score"),
        F.when(empty | ~matched, F.array().cast("array<string>")).otherwise(evidence).alias("evidence"),
        F.when(empty, F.coalesce(t, F.lit(""))).otherwise(
            redact(t, merged, lambda m: pii_token(m["type"], tokens))).alias("sanitized_text"),
        merged.alias("findings"),
    )
    return out.withColumn("pii", computed_once(result)).drop("_pii_raw", "_pii_merged", "_pii_types")


def external_findings(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Model entities (key, entity_type, start, end, score) -> findings.

    Keeps allow-listed entity types renamed by the entity map, drops scores
    under the confidence floor.  The entity map
    is a fixed 30-row table, broadcast by construction."""
    spark = entities.sparkSession
    emap = spark.createDataFrame(P.ENTITY_MAP, "entity_type string, type string")
    return (entities.join(F.broadcast(emap), "entity_type")
            .where(F.col("score") >= P.NER_MIN_CONFIDENCE)
            .select(key, "type", "start", "end", F.col("score").cast("double").alias("confidence")))


# Entity names a recognizer service reports for our own finder types (used to
# feed the regex finders through the external-entity path).
ENTITY_NAME = {"email": "EMAIL_ADDRESS", "phone": "PHONE_NUMBER", "credit_card": "CREDIT_CARD",
               "ssn": "US_SSN", "ip_address": "IP_ADDRESS", "iban": "IBAN_CODE", "crypto_wallet": "CRYPTO"}
