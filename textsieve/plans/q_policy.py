"""Policy, request, decision and audit keys.

Keys with a DuckDB oracle screen *prompt-only requests* (no context documents,
as in the reference's own test cases) with the rule detectors; ``analyze`` and
``sanitize_docs`` screen prompts plus their attached documents with every
detector (paraphrase, template similarity) and are rows-only checks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.functions.arrays import explode_rows

from textsieve.functions import patterns as P
from textsieve.operators import policy as POL
from textsieve.operators import registry as RG
from textsieve.plans import analyze as AN
from textsieve.plans import oracle_pii, oracle_prompt
from textsieve.sources import requests as RQ
from textsieve.sources import responses as RS
from textsieve.sources.tables import cte_prefix, read_table, seeded

REQ_COLS = ["request_id", "prompt", "tenant_id", "user_role", "app_id", "user_id"]


def requests_df(spark, sf_dir) -> DataFrame:
    return seeded(spark, sf_dir, "seeded_prompts").select(*REQ_COLS)


def request_docs_df(spark, sf_dir) -> DataFrame:
    """Attached documents; ``pos`` only orders a request's documents (the
    numeric doc id), so no window and no shuffle of the text before the scan."""
    d = seeded(spark, sf_dir, "request_docs")
    return d.select("request_id", F.col("doc_id").cast("int").alias("pos"),
                    F.col("document_id").alias("doc_id"), "text", "source")


def _prompt_only(spark, sf_dir) -> DataFrame:
    return AN.analyze(requests_df(spark, sf_dir), None, paraphrase=False)


def _full(spark, sf_dir) -> DataFrame:
    return AN.analyze(requests_df(spark, sf_dir), request_docs_df(spark, sf_dir))


def policy_table(spark, sf_dir):
    return POL.effective_policy(requests_df(spark, sf_dir))


def policy_lookup(spark, sf_dir):
    return POL.known_tenants(requests_df(spark, sf_dir))


def apply_weights_q(spark, sf_dir):
    d = _prompt_only(spark, sf_dir)
    return (explode_rows(d, ["request_id"], "results", "r").where("r.matched")
            .select("request_id", F.col("r.tag").alias("tag"), F.col("r.score").cast("long").alias("score")))


def combine_score_q(spark, sf_dir):
    return _prompt_only(spark, sf_dir).select("request_id", F.col("risk_score").cast("long").alias("risk_score"))


def compound_rules_q(spark, sf_dir):
    return (_prompt_only(spark, sf_dir).where(F.col("compound_action").isNotNull())
            .select("request_id", F.col("compound_action").alias("action")))


def decide_q(spark, sf_dir):
    return _prompt_only(spark, sf_dir).select("request_id", "decision")


def risk_tags_q(spark, sf_dir):
    return _prompt_only(spark, sf_dir).select("request_id", F.array_join("risk_tags", ",").alias("tags"))


def reasons_q(spark, sf_dir):
    return _prompt_only(spark, sf_dir).select("request_id", F.array_join(F.transform(
        "reasons", lambda r: F.concat(r["tag"], F.lit(": "), r["evidence"])), " || ").alias("reasons"))


def sanitize_prompt_q(spark, sf_dir):
    return _prompt_only(spark, sf_dir).select("request_id", "sanitized_prompt")


def sanitize_docs_q(spark, sf_dir):
    """Y8 with the rule detectors (checked against the document oracle's redaction)."""
    _d, docs = AN.analyze(requests_df(spark, sf_dir), request_docs_df(spark, sf_dir), paraphrase=False,
                          similarity=False, with_docs=True)
    s = AN.sanitized_documents(docs)
    return s.select("request_id", F.col("pos").cast("long").alias("pos"), "doc_id", "text")


def route_detectors_q(spark, sf_dir):
    routes = RG.default_registry().routes(spark)
    prompts = requests_df(spark, sf_dir).select("request_id", F.lit("prompt").alias("surface"))
    docs = request_docs_df(spark, sf_dir).select("request_id", F.lit("doc").alias("surface"))
    units = prompts.unionByName(docs)
    return units.join(F.broadcast(routes), "surface").select("request_id", "surface", "detector")


def analyze_prompt_q(spark, sf_dir):
    d = _prompt_only(spark, sf_dir)
    return d.select("request_id", "decision", F.col("risk_score").cast("long").alias("risk_score"),
                    F.array_join("risk_tags", ",").alias("risk_tags"), "sanitized_prompt")


def analyze_q(spark, sf_dir):
    d = _full(spark, sf_dir)
    return d.select("request_id", "tenant_id", "decision", F.col("risk_score").cast("long").alias("risk_score"),
                    F.array_join("risk_tags", ",").alias("risk_tags"), "sanitized_prompt",
                    F.col("n_docs").cast("long").alias("n_docs"))


def _audit(spark, sf_dir):
    return AN.audit_records(_prompt_only(spark, sf_dir))


def audit_record_q(spark, sf_dir):
    a = _audit(spark, sf_dir)
    return a.select("request_id", "app_id", "user_id_hash", "tenant", "policy_version", "prompt_hash",
                    F.col("n_context_docs").cast("long").alias("n_doc_hashes"),
                    F.col("score").cast("long").alias("score"), "decision",
                    F.array_join("tags", ",").alias("tags"))


def _rules_with_docs(spark, sf_dir, stored):
    return AN.analyze(requests_df(spark, sf_dir), request_docs_df(spark, sf_dir), paraphrase=False, similarity=False, with_docs=True, stored=stored)


def audit_sink_q(spark, sf_dir):
    """S3, G1: one JSON line for each request, with the ordered hashes of its documents (rule detectors)."""
    decisions, docs = _rules_with_docs(spark, sf_dir, "hashes")
    return RS.audit_lines(AN.audit_records(decisions).drop("timestamp"), AN.audit_doc_hashes(docs)).select("value")


def repeated_inputs_q(spark, sf_dir):
    r = AN.repeated_inputs(_audit(spark, sf_dir))
    return r.select("prompt_hash", F.col("n").cast("long").alias("n"),
                    F.array_join("decisions", ",").alias("decisions"))


def hash_lookup_q(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    hashes = conv.select(F.sha2("text", 256).alias("hash")).distinct()
    r = AN.hash_lookup(_audit(spark, sf_dir), hashes)
    return r.select("hash", F.col("n_seen").cast("long").alias("n_seen"), "ever_blocked")


def read_requests_q(spark, sf_dir):
    return RQ.read_requests_check(spark, sf_dir)


def write_decisions_q(spark, sf_dir):
    """Response JSON per request, documents nested (rule detectors; checked against the oracle)."""
    return RS.response_lines(*_rules_with_docs(spark, sf_dir, "texts"), stored=True)


QUERIES = {
    "read_requests": read_requests_q,
    "write_decisions": write_decisions_q,
    "audit_sink": audit_sink_q,
    "policy_table": policy_table,
    "policy_lookup": policy_lookup,
    "apply_weights": apply_weights_q,
    "combine_score": combine_score_q,
    "compound_rules": compound_rules_q,
    "decide": decide_q,
    "risk_tags": risk_tags_q,
    "reasons": reasons_q,
    "sanitize_prompt": sanitize_prompt_q,
    "sanitize_docs": sanitize_docs_q,
    "route_detectors": route_detectors_q,
    "analyze_prompt": analyze_prompt_q,
    "analyze": analyze_q,
    "audit_record": audit_record_q,
    "repeated_inputs": repeated_inputs_q,
    "hash_lookup": hash_lookup_q,
}


# ----------------------------------------------------------------- oracle
def _tenant_case(col: str, idx: int) -> str:
    default = P.DEFAULT_THRESHOLDS[idx]
    whens = " ".join(f"WHEN '{t}' THEN {v[idx]}" for t, *v in P.TENANT_THRESHOLDS)
    return f"CASE {col} {whens} ELSE {default} END"


def _weight_case(col: str, pairs) -> str:
    d = dict(pairs)
    whens = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in pairs)
    return f"CAST(CASE coalesce({col}, 'default') {whens} ELSE {float(d.get('default', 1.0))} END AS DOUBLE)"


def _decision_sql() -> str:
    pre = cte_prefix("seeded_prompts").rstrip() + ",\n"
    pre += oracle_prompt.views_cte() + ",\n" + oracle_prompt.signals_cte() + ",\n" + oracle_prompt.result_cte() + ",\n"
    pre += "pp AS (SELECT request_id, prompt FROM seeded_prompts),\n"
    pre += oracle_pii.merged_ctes("pp", "request_id", "prompt") + ",\n"
    rw = _weight_case("sp.user_role", P.ROLE_WEIGHTS)
    cw = float(dict(P.CONTEXT_WEIGHTS)["prompt"])
    pi_ev = ("list_concat(['severity=' || res.severity || ' aggregate_score=' || CAST(res.score AS VARCHAR) "
             "|| ' categories=[' || array_to_string(list_transform(res.cats, lambda c: '''' || c || ''''), ', ') || ']'], "
             "res.ev, CASE WHEN res.edu THEN ['dampened: reads as educational/meta discussion, not an attempt'] "
             "WHEN res.factor < 1.0 THEN ['dampened: hedge_factor=' || printf('%.2f', res.factor) || "
             "' (citation/example language present)'] ELSE [] END)")
    rules = " ".join(f"WHEN list_has_all(tags, [{', '.join(repr(t) for t in tags)}]) THEN '{a}'"
                     for tags, a in P.COMPOUND_RULES)
    return pre + f"""
results AS (
  SELECT sp.request_id, 0 AS ord, 'prompt_injection' AS tag, res.k IS NOT NULL AS matched,
         CAST(coalesce(res.score, 0) AS INTEGER) AS raw_score,
         CASE WHEN res.k IS NOT NULL THEN {pi_ev} ELSE [] END AS evidence, sp.user_role
  FROM seeded_prompts sp LEFT JOIN res ON res.k = sp.request_id
  UNION ALL
  SELECT sp.request_id, 1, 'pii', ds.request_id IS NOT NULL, CAST(coalesce(ds.score, 0) AS INTEGER),
         coalesce(string_split(ds.evidence, ' | '), []), sp.user_role
  FROM seeded_prompts sp LEFT JOIN doc_score ds ON ds.request_id = sp.request_id),
weighted AS (
  SELECT r.*, CASE WHEN matched THEN greatest(0, least(100, CAST(round_even(raw_score * {rw.replace('sp.user_role', 'r.user_role')} * CAST({cw} AS DOUBLE), 0) AS INTEGER)))
         ELSE raw_score END AS score FROM results r),
ragg AS (
  SELECT request_id,
         coalesce(max(score) FILTER (WHERE matched), 0) AS top,
         coalesce(sum(floor(score * {P.CORROBORATION_WEIGHT})) FILTER (WHERE matched), 0) AS bumps,
         coalesce(list_sort(list_distinct(list(tag) FILTER (WHERE matched))), []) AS tags,
         coalesce(array_to_string(list(tag || ': ' || CASE WHEN len(evidence) > 0 THEN array_to_string(evidence, '; ')
                  ELSE tag || ' matched' END ORDER BY ord) FILTER (WHERE matched), ' || '), '') AS reasons
  FROM weighted GROUP BY request_id),
decided AS (
  SELECT a.*, CAST(CASE WHEN top = 0 AND bumps = 0 THEN 0 ELSE least(100, top + bumps - floor(top * {P.CORROBORATION_WEIGHT})) END AS BIGINT) AS risk_score,
         CASE {rules} END AS compound_action, sp.tenant_id, sp.app_id, sp.user_id, sp.prompt
  FROM ragg a JOIN seeded_prompts sp ON sp.request_id = a.request_id),
final AS (
  SELECT d.*, coalesce(compound_action, CASE WHEN risk_score >= {_tenant_case('tenant_id', 0)} THEN 'block'
         WHEN risk_score >= {_tenant_case('tenant_id', 1)} THEN 'transform' ELSE 'allow' END) AS decision,
         coalesce(r.sanitized_text, d.prompt) AS sanitized_prompt
  FROM decided d LEFT JOIN doc_redact r ON r.request_id = d.request_id)
"""


def oracle() -> dict[str, str]:
    base = _decision_sql()
    seeds = cte_prefix("request_docs")
    known = ["default"] + sorted(t for t, _b, _t2 in P.TENANT_THRESHOLDS)
    return {
        "policy_table": cte_prefix("seeded_prompts") + f"""SELECT DISTINCT tenant_id, '{P.POLICY_VERSION}' AS version,
            {_tenant_case('tenant_id', 0)} AS block, {_tenant_case('tenant_id', 1)} AS transform FROM seeded_prompts""",
        "policy_lookup": cte_prefix("seeded_prompts") + f"""SELECT t.tenant_id, '{P.POLICY_VERSION}' AS version,
            {_tenant_case('t.tenant_id', 0)} AS block, {_tenant_case('t.tenant_id', 1)} AS transform,
            count(p.request_id) AS n_requests, t.tenant_id IN ({', '.join(f"'{k}'" for k in known)}) AS known
            FROM (SELECT tenant_id FROM seeded_prompts UNION SELECT * FROM (VALUES {', '.join(f"('{k}')" for k in known)}) AS v(tenant_id)) t
            LEFT JOIN seeded_prompts p ON p.tenant_id = t.tenant_id GROUP BY t.tenant_id""",
        "apply_weights": base + "SELECT request_id, tag, CAST(score AS BIGINT) AS score FROM weighted WHERE matched",
        "combine_score": base + "SELECT request_id, risk_score FROM final",
        "compound_rules": base + "SELECT request_id, compound_action AS action FROM final WHERE compound_action IS NOT NULL",
        "decide": base + "SELECT request_id, decision FROM final",
        "risk_tags": base + "SELECT request_id, array_to_string(tags, ',') AS tags FROM final",
        "reasons": base + "SELECT request_id, reasons FROM final",
        "sanitize_prompt": base + "SELECT request_id, sanitized_prompt FROM final",
        "route_detectors": seeds + """SELECT request_id, 'prompt' AS surface, d AS detector FROM seeded_prompts,
            (VALUES ('prompt_injection'), ('pii')) AS r(d)
            UNION ALL SELECT request_id, 'doc', 'rag_injection' FROM request_docs""",
        "analyze_prompt": base + """SELECT request_id, decision, risk_score, array_to_string(tags, ',') AS risk_tags,
            sanitized_prompt FROM final""",
        "audit_record": base + f"""SELECT request_id, app_id, sha256(user_id) AS user_id_hash, tenant_id AS tenant,
            '{P.POLICY_VERSION}' AS policy_version, sha256(prompt) AS prompt_hash, CAST(0 AS BIGINT) AS n_doc_hashes,
            risk_score AS score, decision, array_to_string(tags, ',') AS tags FROM final""",
        "repeated_inputs": base + """SELECT sha256(prompt) AS prompt_hash, count(*) AS n,
            array_to_string(list_sort(list_distinct(list(decision))), ',') AS decisions FROM final
            GROUP BY sha256(prompt) HAVING count(*) > 1""",
        "hash_lookup": base + """, seen AS (SELECT sha256(prompt) AS h, count(*) AS n_seen,
            bool_or(decision = 'block') AS ever_blocked FROM final GROUP BY 1)
            SELECT c.hash, coalesce(s.n_seen, 0) AS n_seen, coalesce(s.ever_blocked, false) AS ever_blocked
            FROM (SELECT DISTINCT sha256(text) AS hash FROM conversations) c LEFT JOIN seen s ON s.h = c.hash""",
        "read_requests": RQ.oracle_sql(),
        **{key: "SELECT request_id, tenant_id, decision, risk_score, risk_tags, sanitized_prompt, n_docs FROM ("
           + "\n".join(analyze_rules_parts(scan)) + ")" for key, scan in (("analyze_rules", "rag_rules"), ("analyze_similarity", "rag_similar"))},
        "write_decisions": _documents_oracle() + """SELECT a.request_id, a.decision, to_json({'decision': a.decision,
            'risk_score': CAST(a.risk_score AS INTEGER), 'risk_tags': a.tag_list, 'sanitized_prompt': a.sanitized_prompt,
            'sanitized_context_docs': coalesce(l.docs, []), 'reasons': list_concat(a.reasons, coalesce(l.reasons, []))}) AS response
            FROM ar a LEFT JOIN lists l ON l.request_id = a.request_id""",
        "sanitize_docs": _sanitize_docs_oracle(),
        "audit_sink": _documents_oracle() + f"""SELECT to_json({{'request_id': a.request_id, 'app_id': sp.app_id,
            'user_id_hash': sha256(sp.user_id), 'tenant': sp.tenant_id, 'policy_version': '{P.POLICY_VERSION}',
            'prompt_hash': sha256(sp.prompt), 'score': CAST(a.risk_score AS INTEGER),
            'decision': a.decision, 'tags': a.tag_list, 'context_doc_hashes': coalesce(l.hashes, [])}}) AS value
            FROM ar a JOIN seeded_prompts sp ON sp.request_id = a.request_id LEFT JOIN lists l ON l.request_id = a.request_id""",
    }


def _documents_oracle() -> str:
    """CTEs ar (decisions of the rules) and lists (documents, their reasons and hashes of each request, in order)."""
    ctes, final = analyze_rules_parts()
    return ctes + f""",
ar AS ({final}),
lists AS (SELECT rd.request_id, list({{'id': rd.document_id, 'text': rr.sanitized_text, 'source': rd.source}} ORDER BY rd.doc_id) AS docs,
  list({{'tag': 'rag_injection', 'evidence': replace(rr.evidence, ' | ', '; ')}} ORDER BY rd.doc_id) FILTER (WHERE rr.matched) AS reasons,
  list(sha256(rd.text) ORDER BY rd.doc_id) AS hashes
  FROM request_docs rd JOIN rr ON rr.doc_id = rd.doc_id GROUP BY rd.request_id)
"""


def _sanitize_docs_oracle() -> str:
    from textsieve.plans import oracle_rag
    rag_part = oracle_rag.base_ctes() + "SELECT k AS doc_id, sanitized_text FROM res"
    return cte_prefix("request_docs") + f""", rr AS ({rag_part})
SELECT rd.request_id, CAST(rd.doc_id AS BIGINT) AS pos, rd.document_id AS doc_id, rr.sanitized_text AS text
FROM request_docs rd JOIN rr ON rr.doc_id = rd.doc_id"""


def analyze_rules_q(spark, sf_dir):
    """Y10 with every rule detector on prompts and attached documents (no
    paraphrase model, no similarity): oracle-checked end to end."""
    return _decided(AN.analyze(requests_df(spark, sf_dir), request_docs_df(spark, sf_dir), paraphrase=False, similarity=False))


def _decided(d):
    return d.select("request_id", "tenant_id", "decision", F.col("risk_score").cast("long").alias("risk_score"),
                    F.array_join("risk_tags", ",").alias("risk_tags"), "sanitized_prompt",
                    F.col("n_docs").cast("long").alias("n_docs"))


QUERIES["analyze_rules"] = analyze_rules_q


def analyze_similarity_q(spark, sf_dir):
    """Y10 with template similarity on the documents, without the paraphrase ratio (oracle-checked end to end)."""
    return _decided(AN.analyze(requests_df(spark, sf_dir), request_docs_df(spark, sf_dir), paraphrase=False))


QUERIES["analyze_similarity"] = analyze_similarity_q


def analyze_rules_oracle() -> str:
    return "\n".join(analyze_rules_parts())


def analyze_rules_parts(scan: str = "rag_rules") -> tuple[str, str]:
    """The CTEs of the end-to-end rule oracle (rr: the document scan) and its final SELECT."""
    from textsieve.plans import oracle_rag
    prompt_part = _decision_sql() + "SELECT request_id, ord, tag, matched, score, evidence FROM weighted"
    rag_part = oracle_rag.rag_sql()[scan]
    final_part = _decision_sql() + "SELECT request_id, sanitized_prompt FROM final"
    rw = _weight_case("sp.user_role", P.ROLE_WEIGHTS)
    cw = _weight_case("CASE WHEN rd.source = '' OR rd.source IS NULL THEN 'prompt' ELSE rd.source END",
                      P.CONTEXT_WEIGHTS)
    rules = " ".join(f"WHEN list_has_all(tags, [{', '.join(repr(t) for t in tags)}]) THEN '{a}'"
                     for tags, a in P.COMPOUND_RULES)
    return cte_prefix("request_docs") + f""", pw AS ({prompt_part}),
rr AS ({rag_part}),
fp AS ({final_part}),
dw AS (SELECT rd.request_id, 'rag_injection' AS tag, r.matched,
          CASE WHEN r.matched THEN greatest(0, least(100, CAST(round_even(r.score * {rw} * {cw}, 0) AS INTEGER)))
          ELSE r.score END AS score
       FROM request_docs rd JOIN rr r ON r.doc_id = rd.doc_id JOIN seeded_prompts sp ON sp.request_id = rd.request_id),
allr AS (SELECT request_id, tag, matched, score FROM pw UNION ALL SELECT request_id, tag, matched, score FROM dw),
agg AS (SELECT request_id, coalesce(max(score) FILTER (WHERE matched), 0) AS top,
          coalesce(sum(floor(score * {P.CORROBORATION_WEIGHT})) FILTER (WHERE matched), 0) AS bumps,
          count(*) FILTER (WHERE matched) AS n_hit,
          coalesce(list_sort(list_distinct(list(tag) FILTER (WHERE matched))), []) AS tags FROM allr GROUP BY request_id),
dec AS (SELECT a.request_id, sp.tenant_id,
          CAST(CASE WHEN n_hit = 0 THEN 0 ELSE least(100, top + bumps - floor(top * {P.CORROBORATION_WEIGHT})) END AS BIGINT) AS risk_score,
          tags, CASE {rules} END AS compound_action FROM agg a JOIN seeded_prompts sp ON sp.request_id = a.request_id)""", f"""SELECT d.request_id, d.tenant_id,
       coalesce(compound_action, CASE WHEN risk_score >= {_tenant_case('d.tenant_id', 0)} THEN 'block'
         WHEN risk_score >= {_tenant_case('d.tenant_id', 1)} THEN 'transform' ELSE 'allow' END) AS decision,
       risk_score, array_to_string(tags, ',') AS risk_tags, fp.sanitized_prompt,
       CAST((SELECT count(*) FROM request_docs x WHERE x.request_id = d.request_id) AS BIGINT) AS n_docs,
       tags AS tag_list, compound_action,
       coalesce((SELECT list({{'tag': r.tag, 'evidence': CASE WHEN len(r.evidence) > 0
                    THEN array_to_string(r.evidence, '; ') ELSE r.tag || ' matched' END}} ORDER BY r.ord)
                 FROM pw r WHERE r.request_id = d.request_id AND r.matched), []) AS reasons
FROM dec d JOIN fp ON fp.request_id = d.request_id"""
