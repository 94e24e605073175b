"""Merkle manifest against a tree built plainly in memory."""
import hashlib
import random
import zlib

from pyspark.sql import functions as F

from textsieve.llm import op11_merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, digest string, tree int, n int"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text))


def climb(nodes, i, node):
    """(root of the tree with node i replaced, its siblings)."""
    proof = []
    while len(nodes) > 1:
        runs = [nodes[k:k + 3] for k in range(0, len(nodes), 3)]
        run = list(runs[i // 3])
        proof += run[:i % 3] + run[i % 3 + 1:]
        run[i % 3] = node
        node, nodes, i = h(run), [h(r) for r in runs], i // 3
    return node, proof


def brute(rows, tamper):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted(((r[0] is not None, r[0] or 0, leaf_of(r, r[4]), str(r)), r) for r in rows if r[1] == s) for s in sources}
    leaves = {s: [k[2] for k, _ in m] for s, m in members.items()}
    subroots = [climb(leaves[s], 0, leaves[s][0])[0] for s in sources]
    out = []
    root = climb(subroots, 0, subroots[0])[0] if subroots else None
    for j, s in enumerate(sources):
        for i, (_, r) in enumerate(members[s]):
            changed = leaf_of(r, tamper(r))
            sub, low = climb(leaves[s], i, changed)
            folded, high = climb(subroots, j, sub)
            out.append((r[0], leaves[s][i], subroots[j], root, h(low + high), folded, changed == leaves[s][i], changed != leaves[s][i]))
    return sorted(out, key=repr)


def tampered(row):
    return row[4] and row[4].replace("\n", "") if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[4]


def run(spark, rows, levels):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(5)
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = M.manifest(df, changes={"text": cut}, block_levels=levels).collect()
    for r in got:
        assert (M.lift(r.path, r.leaf) or [r.leaf])[-1] == r.root
        assert r.copies is None or r.copies[-1] == r.folded_root and r.copies[0] != r.leaf
    return sorted(((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex(), r.folded_root.hex(),
                    r.folded_root == r.root, r.copies is not None) for r in got), key=repr)


def rows_of(n, rnd, sources):
    return [(i * 7 % 1009 - 50, rnd.choice(sources), rnd.choice(["en", None, "ä"]), rnd.choice([None, 0, 12]),
             rnd.choice([None, "", "one\ntwo", "no break é", "\n", "x" * 3000 + "\n"]) if i % 3 else f"text {i}\n{i}") for i in range(n)]


def test_many_rounds_of_small_blocks(spark):
    rnd = random.Random(11)
    rows = rows_of(150, rnd, ["hot"] * 6 + ["b", "", None, "ä", "z", "\U0001F600", "￿", "q", "r", "s", "t"]) + [(5000, "single", "en", 1, "a\nb")]
    for levels in (1, 2, M.BLOCK_LEVELS):
        assert run(spark, rows, levels) == brute(rows, tampered)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (None, "a", None, None, "x\ny"), (3, "a", "en", 1, "p\nq"),
            (3, "a", "en", 1, "p\nq"), (3, "a", "en", 1, "other\n"), (1, "a", "en", 1, "p\nq")]
    assert run(spark, rows, 1) == brute(rows, tampered)


def test_one_leaf_one_source_and_empty(spark):
    for rows in ([(1, "a", "en", 3, "a\nb")], [(i, "a", "en", 3, f"{i}\n") for i in range(10)], [(i, f"s{i}", "en", 3, f"{i}\n") for i in range(10)]):
        assert run(spark, rows, 1) == brute(rows, tampered)
    assert run(spark, [], 1) == []


def test_versions_share_all_but_the_path():
    leaves = [bytes([i]) * 32 for i in range(25)]
    tree = M.BlockTree(leaves, 3)
    before = [list(level) for level in tree.levels]
    for i in range(25):
        copies = tree.version(i, b"n" * 32)
        plain = M.BlockTree(leaves[:i] + [b"n" * 32] + leaves[i + 1:], 3)
        assert copies == [level[i // 3 ** k] for k, level in enumerate(plain.levels)]
        assert all(level[:i // 3 ** k] + level[i // 3 ** k + 1:] == before[k][:i // 3 ** k] + before[k][i // 3 ** k + 1:]
                   for k, level in enumerate(plain.levels))
    assert tree.levels == before
