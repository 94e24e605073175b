"""Line dedup against brute force over all pairs of positions."""
import random

from hypothesis import given, settings, strategies as st

from textsieve.llm import op8_lines as L


def brute(rows, min_chars):
    docs = [(i, t.split("\n") if t is not None else []) for i, t in sorted(rows, key=lambda r: r[0])]
    at = [(d, p) for d, (_, ls) in enumerate(docs) for p in range(len(ls))]
    gone = set()
    for x, (d, p) in enumerate(at):
        for e, q in at[:x]:
            n = 0
            while p + n < len(docs[d][1]) and q + n < len(docs[e][1]) and docs[d][1][p + n] == docs[e][1][q + n]:
                n += 1
            if sum(len(s) + 1 for s in docs[d][1][p:p + n]) >= min_chars:
                gone |= {(d, p + k) for k in range(n)}
    texts = {i: t for i, t in rows}
    return sorted((i, len(ls), sum((d, p) in gone for p in range(len(ls))),
                   None if texts[i] is None else "\n".join(s for p, s in enumerate(ls) if (d, p) not in gone))
                  for d, (i, ls) in enumerate(docs))


def run(spark, rows, min_chars):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, p int, rank int").repartition(3)
    return sorted((r.doc_id, r.n_lines, r.n_deleted, r.text) for r in L.dedup_lines(df, min_chars=min_chars).collect())


def test_random_sequences_of_short_and_long_lines(spark):
    rnd = random.Random(5)
    pool = ["", "a", "bb", "ccc", "a longer line of text", "another rather long line", "dddd", "ee e"]
    for min_chars, docs in ((20, 25), (9, 25), (1, 12)):
        rows = [(i * 3, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14)))) for i in range(docs)]
        rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (1003, "unique line only here"), (1004, "\n\n\n")]
        assert run(spark, rows, min_chars) == brute(rows, min_chars)


def test_long_passage_and_many_copies(spark):
    passage = "\n".join(f"line number {i} of a passage" for i in range(40))
    rows = [(i, f"own start {i}\n{passage}\nown end {i}") for i in range(30)]
    got = run(spark, rows, 20)
    assert got == brute(rows, 20)
    assert got[0][2] == 0 and all(r[2] == 40 and r[3] == f"own start {r[0]}\nown end {r[0]}" for r in got[1:])


def test_ids_null_and_repeated(spark):
    line = "one line that is repeated"
    rows = [(None, line), (2, f"x\n{line}"), (2, f"y\n{line}"), (1, line), (1, line), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_deleted, r.text) for r in L.dedup_lines(df).collect()), key=repr)
    assert got == sorted([(None, 1, ""), (None, 0, None), (1, 0, line), (1, 0, line), (2, 1, "x"), (2, 1, "y")], key=repr)


def test_empty_table_and_nothing_repeated(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_deleted, r.text) for r in L.dedup_lines(df).collect()) == [
        (1, 2, 0, "a\nb"), (2, 1, 0, "c")]
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = L.op8_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=12), st.integers(1, 20))
def test_union_of_smallest_runs_is_the_whole_run(sizes, least):
    """A run of enough characters is the union of the smallest runs inside it."""
    n, covered = len(sizes), set()
    for p in range(n):
        for q in range(p, n):
            if sum(sizes[p:q + 1]) >= least:
                covered |= set(range(p, q + 1))
                break
        for q in range(p, -1, -1):
            if sum(sizes[q:p + 1]) >= least:
                covered |= set(range(q, p + 1))
                break
    assert covered == (set(range(n)) if sum(sizes) >= least else set())
