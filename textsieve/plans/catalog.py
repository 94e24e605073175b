"""Registry of every query key and its DuckDB oracle."""
from __future__ import annotations

from textsieve.plans import q_limit, q_pii, q_policy, q_prompt, q_rag, q_stream

QUERIES = {}
QUERIES.update(q_pii.QUERIES)
QUERIES.update(q_prompt.QUERIES)
QUERIES.update(q_limit.QUERIES)
QUERIES.update(q_policy.QUERIES)
QUERIES.update(q_rag.QUERIES)
QUERIES.update(q_stream.QUERIES)


def oracle() -> dict[str, str]:
    from textsieve.plans import oracle_pii, oracle_prompt, oracle_rag
    out = {}
    out.update(oracle_pii.pii_sql())
    out.update(oracle_prompt.prompt_sql())
    out.update(q_limit.oracle())
    out.update(q_policy.oracle())
    out.update(q_stream.oracle())
    out.update(oracle_rag.rag_sql())
    return {k: v for k, v in out.items() if k in QUERIES}


def flagship(spark, sf_dir):
    return q_policy.analyze_q(spark, sf_dir)
