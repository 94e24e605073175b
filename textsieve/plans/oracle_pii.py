"""DuckDB oracle for the personal-data keys.

Independent formulation: spans by split/extract lists, validators in list
lambdas, merge by window gaps-and-islands, redaction by ordered string_agg.
"""
from __future__ import annotations

import re

from textsieve.functions import dialect as D
from textsieve.functions import patterns as P
from textsieve.functions.spans import oracle_spans_sql
from textsieve.operators.pii import _VIN_LETTERS, _VIN_VALUES, _VIN_WEIGHTS, FINDERS, SECRET_TYPES, STRUCTURED
from textsieve.sources.tables import cte_prefix

_LUHN = ("(list_sum(list_transform(range(1, length(m) + 1), lambda i: "
         "CASE WHEN (length(m) - i) % 2 = 1 THEN "
         "(CASE WHEN 2 * CAST(substr(m, i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(m, i, 1) AS INTEGER) - 9 "
         "ELSE 2 * CAST(substr(m, i, 1) AS INTEGER) END) "
         "ELSE CAST(substr(m, i, 1) AS INTEGER) END)) % 10 = 0)")
_IBAN = ("(list_reduce(list_transform(string_split("
         "list_aggregate(list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: "
         "CASE WHEN regexp_matches(c, '[A-Z]') THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), "
         "'string_agg', ''), ''), lambda d: CAST(d AS INTEGER)), lambda a, b: (a * 10 + b) % 97, 0) = 1)")
_VALIDATORS = {
    "phone": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 7 AND 15",
    "credit_card": re.sub(r"\bm\b", "regexp_replace(m, '[ -]', '', 'g')", _LUHN),
    "ssn": ("substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' "
            "AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'"),
    "ip_address": "list_bool_and(list_transform(string_split(m, '.'), lambda o: CAST(o AS INTEGER) <= 255))",
    "iban": _IBAN,
    "routing_number": ("list_sum(list_transform(range(1, 10), lambda i: CAST(substr(right(m, 9), i, 1) AS INTEGER) * [3, 7, 1][(i - 1) % 3 + 1])) "
                       "% 10 = 0 AND right(m, 9) <> '000000000'"),
    "vin": (f"list_sum(list_transform(range(1, 18), lambda i: CAST(substr(translate(m, '{_VIN_LETTERS}', '{_VIN_VALUES}'), i, 1) AS INTEGER) "
            f"* [{', '.join(map(str, _VIN_WEIGHTS))}][i])) % 11 = CASE WHEN substr(m, 9, 1) = 'X' THEN 10 "
            "ELSE TRY_CAST(substr(m, 9, 1) AS INTEGER) END AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"),
}


def findings_cte(source: str = "seeded_docs", key: str = "doc_id", text: str = "text") -> str:
    """CTE body ``raw_findings(key, start_pos, end_pos, ord, type, confidence)``."""
    parts = []
    for ord_, (ptype, pat, flags, conf) in enumerate(FINDERS):
        spans = oracle_spans_sql(D.re2_word_view(text), D.re2(pat, flags))
        val = _VALIDATORS.get(ptype, "TRUE")
        parts.append(
            f"SELECT {key}, start_pos, end_pos, {ord_} AS ord, "
            f"'{ptype}' AS type, CAST({conf} AS DOUBLE) AS confidence FROM ("
            f"SELECT {key}, start_pos, end_pos, substr(t, start_pos + 1, end_pos - start_pos) AS m FROM ("
            f"SELECT {key}, t, s.start AS start_pos, s.\"end\" AS end_pos FROM ("
            f"SELECT {key}, {text} AS t, unnest({spans}) AS s FROM {source}))) "
            f"WHERE {val}")
    return "\nUNION ALL\n".join(parts)


def merged_ctes(source: str = "seeded_docs", key: str = "doc_id", text: str = "text") -> str:
    tok = " ".join(f"WHEN '{t}' THEN '{v}'" for t, v in P.PII_TOKENS)
    wts = " ".join(f"WHEN '{t}' THEN {w}" for t, w in P.PII_WEIGHTS)
    return f"""
raw_findings AS ({findings_cte(source, key, text)}),
o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start_pos, ord) AS rn FROM raw_findings),
g AS (SELECT *, max(end_pos) OVER (PARTITION BY {key} ORDER BY rn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM o),
h AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR start_pos >= prev_end THEN 1 ELSE 0 END)
        OVER (PARTITION BY {key} ORDER BY rn) AS island FROM g),
merged AS (SELECT {key}, island, min(start_pos) AS start_pos, max(end_pos) AS end_pos,
        first(type ORDER BY confidence DESC, rn) AS type,
        max(confidence) AS confidence FROM h GROUP BY {key}, island),
tokened AS (SELECT *, CASE type {tok} ELSE '[REDACTED_' || upper(type) || ']' END AS token,
        lag(end_pos, 1, 0) OVER (PARTITION BY {key} ORDER BY start_pos) AS cut FROM merged),
per_type AS (SELECT {key}, type, count(*) AS n,
        'type=' || type || ' count=' || CAST(count(*) AS VARCHAR) || ' spans=[' ||
        string_agg('(' || CAST(start_pos AS VARCHAR) || ', ' || CAST(end_pos AS VARCHAR) || ')', ', '
                   ORDER BY start_pos) || ']' AS ev,
        CASE type {wts} ELSE {P.PII_UNKNOWN_TYPE_WEIGHT} END AS w FROM merged GROUP BY {key}, type),
doc_score AS (SELECT {key}, least({P.PII_MAX_SCORE}, sum(w + least(n - 1, 4) * (w // 2))) AS score,
        string_agg(ev, ' | ' ORDER BY type) AS evidence, sum(n) AS n_findings FROM per_type GROUP BY {key}),
doc_redact AS (SELECT t.{key}, string_agg(substr(d.{text}, t.cut + 1, t.start_pos - t.cut) || t.token, ''
        ORDER BY t.start_pos) || substr(any_value(d.{text}), max(t.end_pos) + 1) AS sanitized_text
        FROM tokened t JOIN {source} d ON d.{key} = t.{key} GROUP BY t.{key})
"""


def pii_sql() -> dict[str, str]:
    pre = cte_prefix("seeded_docs").rstrip() + ",\n" + merged_ctes()
    sp1_parts = []
    for ord_, (ptype, pat, flags, conf) in enumerate(FINDERS[:5]):
        if ptype in ("email", "ip_address", "credit_card"):
            spans = oracle_spans_sql(D.re2_word_view("text"), D.re2(pat, flags))
            sp1_parts.append(f"SELECT doc_id, '{ptype}' AS pattern_id, s.start AS start_pos, s.\"end\" AS end_pos "
                             f"FROM (SELECT doc_id, unnest({spans}) AS s FROM seeded_docs)")
    sp1 = cte_prefix("seeded_docs") + "\nUNION ALL\n".join(sp1_parts)
    structured, secrets = ("(" + ",".join(f"'{t}'" for t in ts) + ")" for ts in (STRUCTURED, SECRET_TYPES))
    from textsieve.operators.pii import ENTITY_NAME
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENTITY_NAME.items())
    emap = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ENTITY_MAP)
    ext = pre + f"""SELECT doc_id, etype AS type, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos,
        confidence FROM (SELECT *, CASE (CASE type {names} ELSE upper(type) END) {emap} END AS etype FROM raw_findings)
        WHERE etype IS NOT NULL AND confidence >= {P.NER_MIN_CONFIDENCE}"""
    return {
        "external_findings": ext,
        "regex_spans": sp1,
        "pii_email": pre + "SELECT doc_id, start_pos, end_pos FROM raw_findings WHERE type = 'email'",
        "pii_phone": pre + "SELECT doc_id, start_pos, end_pos FROM raw_findings WHERE type = 'phone'",
        "pii_structured": pre + f"SELECT doc_id, type, start_pos, end_pos FROM raw_findings WHERE type IN {structured}",
        "secret_finders": pre + f"SELECT doc_id, type, start_pos, end_pos FROM raw_findings WHERE type IN {secrets}",
        "merge_overlaps": pre + "SELECT doc_id, start_pos, end_pos, type, confidence FROM merged",
        "redact_pii": pre + """SELECT d.doc_id, coalesce(r.sanitized_text, d.text) AS sanitized_text
            FROM seeded_docs d LEFT JOIN doc_redact r ON r.doc_id = d.doc_id""",
        "pii_score": pre + "SELECT doc_id, CAST(score AS BIGINT) AS score FROM doc_score",
        "pii_evidence": pre + "SELECT doc_id, type, ev AS evidence FROM per_type",
        "pii_scan": pre + """SELECT d.doc_id, s.doc_id IS NOT NULL AS matched,
            CAST(coalesce(s.score, 0) AS BIGINT) AS score, CAST(coalesce(s.n_findings, 0) AS BIGINT) AS n_findings,
            coalesce(s.evidence, '') AS evidence, coalesce(r.sanitized_text, d.text) AS sanitized_text
            FROM seeded_docs d LEFT JOIN doc_score s ON s.doc_id = d.doc_id
            LEFT JOIN doc_redact r ON r.doc_id = d.doc_id""",
        "pii_type_counts": pre + """SELECT m.type, d.source, count(*) AS n_findings,
            count(DISTINCT m.doc_id) AS n_docs FROM merged m JOIN seeded_docs d ON d.doc_id = m.doc_id
            GROUP BY ROLLUP (m.type, d.source)""",
    }
