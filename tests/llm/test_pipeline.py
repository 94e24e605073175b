"""Every stage of the corpus pipeline against a brute-force version on its own input."""
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as C
from textsieve.llm import op5_toxicity, op6_bpe, op8_lines
from textsieve.llm.ranks import read_ranks
from test_jaccard import brute as jaccard_brute
from test_lines import brute as lines_brute

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, D).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs, after))
        docs = after
    return out


def test_columns(stages):
    for _, docs, after in stages[:-1]:
        assert after.columns == docs.columns


def test_toxicity(spark, stages):
    _, docs, after = stages[0]
    chain = op5_toxicity.toxicity_chain(spark, D, docs)
    slots = op5_toxicity.Slots()

    def toxic(text):
        found, before = op5_toxicity.slots_of(text, slots), []
        for m in chain:
            before.append(m.predict(found, before))
        return before[-1] >= op5_toxicity.CUTOFF

    assert sorted(map(tuple, after.collect())) == sorted(tuple(r) for r in docs.collect() if not toxic(r.text))


def test_line_dedup(stages):
    _, docs, after = stages[1]
    rows = {r.doc_id: r for r in docs.collect()}
    want = []
    for i, _, gone, text in lines_brute([(r.doc_id, r.text) for r in rows.values()], op8_lines.MIN_CHARS):
        if not gone or text.strip(" "):
            want.append((i, text, rows[i].lang, rows[i].source, len(text) if gone else rows[i].n_chars))
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_near_duplicates(stages):
    _, docs, after = stages[2]
    rows = docs.collect()
    keep = {i for i, _, c, _ in jaccard_brute([(r.doc_id, r.text) for r in rows]) if c == i}
    assert sorted(map(tuple, after.collect())) == sorted(tuple(r) for r in rows if r.doc_id in keep)


def test_source_mix(stages):
    _, docs, after = stages[3]
    before, got = {tuple(r): r for r in docs.collect()}, Counter(tuple(r) for r in after.collect())
    assert set(got) <= set(before) and max(got.values()) <= 3
    words, taken = defaultdict(int), defaultdict(int)
    for r in before.values():
        words[r.source] += len(r.text.encode().split())
        taken[r.source] += got[tuple(r)] * len(r.text.encode().split())
    names = sorted(words)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    most, goal, free, left = {s: 3 * words[s] for s in names}, {}, set(names), float(sum(words.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most[s]}
        if not over:
            goal |= {s: left * weight[s] / total for s in free}
            break
        goal |= {s: most[s] for s in over}
        left -= sum(most[s] for s in over)
        free -= over
    for s in names:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 100


def test_tokens(stages):
    _, docs, after = stages[4]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(public_tokenizers.path(op6_bpe.RANKS)))
    want = []
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, after.collect())) == sorted(want)


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a line that is long enough", "en", None, 26),
            (3, "a line that is long enough", None, "b", 26), (3, "a line that is long enough", None, "b", 26),
            (4, "x " * 30_000, "en", "a", 60_000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in C.STAGES:
            out = stage(spark, docs, D)
            assert len(out.collect()) <= 3 * docs.count()
