"""Merkle manifest of a data set, with one persistent version of the tree for every changed leaf.

A leaf is the digest of a row's fields.  The leaves of a source, in the order of
their ids, are joined by threes, level by level, to the source's subroot; the
subroots, in the order of their sources, are joined likewise to the root.

Trees are cut into aligned blocks of ``FAN ** BLOCK_LEVELS`` nodes.  A block is
built in one task: its nodes, by levels, are never written again.  A changed leaf
makes a version of the tree by path copying (`BlockTree.version`): only the
ancestors of the leaf are made anew, everything else is shared with the tree as it
was, so a block with many changed leaves holds its nodes once.  The tops of the
blocks are the nodes of the next round, distributed in the same way, until each
tree is one node.  Paths then come down again: a block gets the one path from its
top to the root, and the versions of its leaves go on along it (`lift`), in the
block's own task, so neither a block nor an upper node ever meets all versions.

Scale: shuffled are digests (32 bytes a leaf, 32 more for a changed one), once in
ranges of (source, id) and twice in blocks; texts are read once and never
shuffled.  A hot source is many ranges and many blocks.  Rounds grow with the
logarithm of the leaves (one for each factor 2,187).  The positions of ranges are
one row for each range and source.

Edge cases: a null field counts as ``-``, so null and empty text differ; null
source comes first, null id first within its source, equal ids by their digests;
repeated rows are leaves each; a source with one leaf has it as its subroot, a
table with one source has its subroot as its root; an empty table has no rows.
Columns other than the named ones are not read.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textsieve.llm.common import cut, table

FAN = 3
BLOCK_LEVELS = 7
FILES = 16                  # of small tables
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(digests) -> bytes:
    """Digest of a run of nodes: sha256 of their digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


class BlockTree:
    """The nodes of an aligned block, by levels; versions share all that they do not replace."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.levels = [leaves]
        for _ in range(levels):
            below = self.levels[-1]
            self.levels.append([joined(below[i:i + FAN]) for i in range(0, len(below), FAN)])
        self.top = self.levels[-1][0]

    def path(self, i: int) -> bytes:
        """The siblings from leaf i to the top: for each level the numbers of those left and right, then their digests."""
        steps = []
        for nodes in self.levels[:-1]:
            start = i - i % FAN
            left, right = nodes[start:i], nodes[i + 1:start + FAN]
            steps.append(bytes([len(left), len(right)]) + b"".join(left) + b"".join(right))
            i //= FAN
        return b"".join(steps)

    def version(self, i: int, leaf: bytes) -> list[bytes]:
        """The copied nodes of the version with another leaf i, from it to its top."""
        copies = [leaf]
        for nodes in self.levels[:-1]:
            start = i - i % FAN
            copies.append(joined([*nodes[start:i], copies[-1], *nodes[i + 1:start + FAN]]))
            i //= FAN
        return copies


def steps(path: bytes):
    """(left siblings, right siblings) of every level of a path."""
    at = 0
    while at < len(path):
        left, right = path[at], path[at + 1]
        nodes = [path[k:k + 32] for k in range(at + 2, at + 2 + 32 * (left + right), 32)]
        at += 2 + 32 * (left + right)
        yield nodes[:left], nodes[left:]


def lift(path: bytes, node: bytes) -> list[bytes]:
    """The nodes above ``node`` along a path; the last one is the root."""
    copies = []
    for left, right in steps(path):
        node = joined([*left, node, *right])
        copies.append(node)
    return copies


def proof_digest(path: bytes) -> bytes:
    """Digest of all siblings of a path, level by level, left to right."""
    return joined([d for left, right in steps(path) for d in (*left, *right)])


def _levels(n: int, block_levels: int) -> int:
    """Levels inside a block of a tree of n nodes: all of its levels if it is one block."""
    if n > FAN ** block_levels:
        return block_levels
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def leaf_digest(fields: dict[str, Column]) -> Column:
    parts = []
    for value in fields.values():
        s = value.cast("string")
        parts.append(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _few(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table with a row for each range, source or block, in few files."""
    return cut(df.repartition(FILES))


def _in_order(rows: DataFrame, tree: list[str], order: list[str], files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows in ranges of (tree, order) with their place ``at``, and the runs of trees in ranges:
    ``part``, ``first`` place, rows of the tree ``before`` and in all, ``n``."""
    at = (rows.repartitionByRange(*tree, *order).sortWithinPartitions(*tree, *order)
          .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    at = cut(at.coalesce(files) if files else at)
    runs = at.groupBy(*tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("run"))
    whole = Window.partitionBy(*tree)
    before = F.sum("run").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return at, _few(runs.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("run").over(whole)))


def _blocks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / size).cast("bigint"))


def _rounds(nodes: DataFrame, most: int, block_levels: int) -> list[DataFrame]:
    """[nodes, tops of their blocks, tops of those, ...], the last with one node for each tree."""
    size = FAN ** block_levels

    def top(key, block):
        block = block.sort_by("pos")
        n = block["n"][0].as_py()
        tree = BlockTree(block["digest"].to_pylist(), _levels(n, block_levels))
        return pa.table({"tree": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // size)], "digest": [tree.top]},
                        schema=pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()),
                                          ("digest", pa.binary())]))

    rounds = [nodes]
    while most > 1:
        below = _blocks(rounds[-1].select("tree", "pos", "n", "digest"), size)
        rounds.append(_few(below.groupBy("tree", "block").applyInArrow(top, "tree bigint, pos bigint, n bigint, digest binary")))
        most = -(-most // size)
    return rounds


def _down(nodes: DataFrame, heads: DataFrame, block_levels: int, emit, schema: str) -> DataFrame:
    """Every block with the one row of ``heads`` (tree, pos: the block, path, subroot, root) for its top;
    ``emit(tree, block, head)`` gives the rows."""
    def run(key, block, head):
        block, head = block.sort_by("pos"), head.to_pylist()[0]
        return emit(BlockTree(block["digest"].to_pylist(), _levels(block["n"][0].as_py(), block_levels)), block, head)

    size = FAN ** block_levels
    return (_blocks(nodes, size).groupBy("tree", "block")
            .cogroup(heads.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(run, schema))


_HEAD = "tree bigint, pos bigint, digest binary, path binary, subroot binary, root binary"
_HEAD_ARROW = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary()), ("path", pa.binary()),
                         ("subroot", pa.binary()), ("root", pa.binary())])


def _inner(tree: BlockTree, block, head):
    n = len(block)
    return pa.table({"tree": block["tree"], "pos": block["pos"], "digest": block["digest"],
                     "path": [tree.path(i) + head["path"] for i in range(n)],
                     "subroot": [head["subroot"]] * n, "root": [head["root"]] * n}, schema=_HEAD_ARROW)


def _paths(rounds: list[DataFrame], heads: DataFrame, block_levels: int) -> DataFrame:
    """Paths of the nodes of every round but the lowest, top down; those of ``rounds[1]`` (or ``heads``)."""
    for nodes in rounds[-2:0:-1]:
        heads = _few(_down(nodes, heads.drop("digest"), block_levels, _inner, _HEAD))
    return heads


_LEAVES = ("doc_id bigint, leaf binary, subroot binary, root binary, path binary, proof binary, "
           "copies array<binary>, folded_root binary")
_LEAVES_ARROW = pa.schema([("doc_id", pa.int64()), ("leaf", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary()),
                           ("path", pa.binary()), ("proof", pa.binary()), ("copies", pa.list_(pa.binary())),
                           ("folded_root", pa.binary())])


def _leaf_rows(tree: BlockTree, block, head):
    paths = [tree.path(i) + head["path"] for i in range(len(block))]
    copies, folded = [], []
    for i, (leaf, changed) in enumerate(zip(block["digest"].to_pylist(), block["changed"].to_pylist())):
        version = tree.version(i, leaf if changed is None else changed)
        version += lift(head["path"], version[-1])
        copies.append(None if changed is None else version)
        folded.append(version[-1])
    n = len(block)
    return pa.table({"doc_id": block["doc_id"], "leaf": block["digest"], "subroot": [head["subroot"]] * n,
                     "root": [head["root"]] * n, "path": paths, "proof": [proof_digest(p) for p in paths],
                     "copies": copies, "folded_root": folded}, schema=_LEAVES_ARROW)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             changes: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row for each leaf: doc_id, leaf, subroot, root, path (siblings up to the root), proof (digest of
    all siblings), copies (nodes of the version with the leaf changed, null where ``changes``, new values of
    fields, change nothing) and folded_root (root of that version, else of the leaf and its siblings)."""
    old = {c: F.col(c) for c in fields}
    leaf = leaf_digest(old)
    changed = leaf_digest(old | changes) if changes else leaf
    leaves = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).isNotNull().alias("named"),
                          F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                          leaf.alias("digest"), changed.alias("changed"))
              .withColumn("changed", F.expr("CASE WHEN changed <> digest THEN changed END")))
    by = ["named", "source"]
    at, runs = _in_order(leaves, by, ["doc_id", "digest"])
    size = FAN ** block_levels
    places, spans = _in_order(runs.select(*by).distinct().withColumn("all", F.lit(0)), ["all"], by, FILES)
    trees = (places.join(spans, ["all", "part"])
             .select(*by, (F.col("at") - F.col("first") + F.col("before")).alias("tree"), F.col("n").alias("n_trees")))
    runs = _few(runs.join(trees, by))
    found = runs.agg(F.max("n"), F.max("n_trees")).first()
    leaves = (at.join(runs, [*by, "part"])
              .select("tree", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n", "doc_id", "digest", "changed"))
    rounds = _rounds(leaves, found[0] or 0, block_levels)
    if len(rounds) == 1:                 # every source has one leaf at most: the leaves are the subroots
        rounds.append(leaves.select("tree", "pos", "n", "digest"))
    subroots = (rounds[-1].select("tree", "digest").join(trees.select("tree", "n_trees"), "tree")
                .select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.col("n_trees").alias("n"), "digest"))
    upper = _rounds(subroots, found[1] or 0, block_levels)
    head = upper[-1].select("tree", "pos", "digest", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"),
                            F.col("digest").alias("root"))
    if len(upper) > 1:
        head = _down(upper[0], _paths(upper, head, block_levels).drop("digest"), block_levels, _inner, _HEAD)
    head = _few(head.select(F.col("pos").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "digest", "path",
                           F.col("digest").alias("subroot"), "root"))
    return _down(leaves, _paths(rounds, head, block_levels).drop("digest"), block_levels, _leaf_rows, _LEAVES)


def _hex(column: str) -> Column:
    return F.lower(F.hex(column)).alias(column)


def op11_merkle_manifest(spark, sf_dir):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest(table(spark, sf_dir, "documents"), changes={"text": tampered})
    return rows.select("doc_id", _hex("leaf"), _hex("subroot"), _hex("root"), F.lower(F.hex("proof")).alias("proof_sha256"),
                       _hex("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)) END"
             for c in (*FIELDS[:-1], text)]
    return f"sha256(concat({', '.join(parts)}))"


def _tree_sql(name: str, start: str) -> str:
    """Levels of the trees that ``start`` (tree, level, pos, h, n) gives, and their runs of three."""
    return f"""
{name} AS ({start} UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3),
{name}_runs AS (SELECT tree, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3)"""


def _fold_sql(name: str, start: str, runs: str) -> str:
    """From (rid, tree, level, pos, h, proof) up to the top of the tree."""
    others = "array_to_string(list_concat(hs[1:pos % 3], hs[pos % 3 + 2:]), '')"
    return f"""
{name}_all AS ({start} UNION ALL
  SELECT rid, f.tree, f.level + 1, pos // 3, sha256(array_to_string(list_concat(hs[1:pos % 3], [h], hs[pos % 3 + 2:]), '')),
         proof || {others}
  FROM {name}_all f JOIN {runs} r ON r.tree = f.tree AND r.level = f.level AND r.run = f.pos // 3),
{name} AS (SELECT rid, tree, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM {name}_all GROUP BY rid, tree)"""


# crc32 bit by bit: each byte is folded into the low bits of the register, which is then shifted eight times.
ORACLE_SQL = f"""
WITH RECURSIVE c AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * length(CAST(doc_id AS VARCHAR))),
           lambda i: CASE WHEN i % 8 = 0 THEN ord(substr(CAST(doc_id AS VARCHAR), (i // 8 + 1)::INT, 1))::BIGINT ELSE 0::BIGINT END)),
         lambda r, b: xor(xor(r, b) >> 1, 3988292384::BIGINT * (xor(r, b) & 1))), 4294967295::BIGINT) AS crc
  FROM documents),
x AS (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM c),
l AS (SELECT *, {_leaf_sql('text')} AS leaf, {_leaf_sql('tampered')} AS changed,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM x),
d AS (SELECT doc_id, leaf, changed, tree, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS rid,
             row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS n FROM l),
{_tree_sql('t', 'SELECT tree, 0 AS level, pos, leaf AS h, n FROM d')},
subroots AS (SELECT tree, h FROM t WHERE n = 1),
{_tree_sql('s', 'SELECT 0 AS tree, 0 AS level, tree AS pos, h, count(*) OVER () AS n FROM subroots')},
{_fold_sql('f', "SELECT rid, tree, 0 AS level, pos, changed AS h, '' AS proof FROM d", 't_runs')},
{_fold_sql('g', "SELECT rid, 0 AS tree, 0 AS level, tree AS pos, h, proof FROM f", 's_runs')}
SELECT d.doc_id, d.leaf, subroots.h AS subroot, s.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root,
       g.h = s.h AS verified
FROM d JOIN subroots USING (tree) JOIN g USING (rid) CROSS JOIN (SELECT h FROM s WHERE n = 1) s
"""

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLE = {"op11_merkle_manifest": ORACLE_SQL}
