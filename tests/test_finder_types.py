"""Queries on some types of findings run the finders of those types only, with the same rows."""
from paths import SF001
from textsieve.operators import pii
from textsieve.plans import q_pii as Q


def test_only_the_named_finders_run(spark):
    plan = Q.secret_finders(spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "'email'" not in plan and "luhn_check" not in plan and "phone" not in plan


def test_rows_are_those_of_all_finders(spark):
    for query, types in ((Q.secret_finders, pii.SECRET_TYPES), (Q.pii_structured, pii.STRUCTURED)):
        every = Q._raw(spark, SF001)
        want = every.where(every.type.isin(types)).select("doc_id", "type", "start_pos", "end_pos").collect()
        assert sorted(query(spark, SF001).collect()) == sorted(want) and want
