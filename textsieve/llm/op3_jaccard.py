"""Set-similarity join of documents on word shingles with token-combination prefixes.

A document's tokens are its distinct 5-word shingles.  Two documents link when
the Jaccard similarity of their token sets is at least ``PERCENT`` / 100.

1. Equal sets have one representative.
2. All tokens have one global order: first by the least document count of a
   shingle's words, so that shingles of boilerplate come last, then by hash.  The
   word counts cover all documents; they live in ``COUNTERS`` hashed counters, so
   their size does not grow with the data (a collision only changes the order).
3. A set of n tokens may miss at most n // 5 of them in a similar set.  Its
   prefix is its first tokens in that order.  A token is rare or frequent by the
   number of prefixes that hold it.  Rare tokens are indexed singly; frequent ones
   fall into g classes by hash, and pairs inside a class are indexed (k = 2).  A
   prefix with n1 rare tokens and n_j frequent ones of class j covers
   n1 + sum(max(0, n_j - 1)) misses, and it is extended until that exceeds what a
   similar set may miss.  So two similar sets share an indexed token or pair
   (tokens, being ordered, are in the shorter prefix's range of both).  g depends on
   the power-of-two size level, so a large set indexes few pairs per token; a set
   near the edge of a level is indexed in both levels.  Where similar sets of a level
   may share no more tokens than it has classes, all its tokens count as rare.  Sets
   of fewer than percent / (100 - percent) tokens (4 at 80) can only be similar if
   equal.
4. The documents of a signature form a group named by its smallest row; signatures
   with the same smallest row share a group (rows stay linear in the postings).  A document
   leaves a group in which no other has a size that allows the similarity.
5. Each group is cut into blocks by hash, and each pair of blocks is one task group
   that verifies its pairs exactly on the full sets: shared tokens are counted
   through an index, and per document its number of links and one connected
   document are emitted, never pairs.  A pair in several groups counts once.
6. Verified links give the components; representatives' answers go back to copies.

Edge cases: null or blank text has no tokens, n_shingles 0 and links with nothing;
fewer than 5 words are one token; a row without id gets a null component; repeated
ids share one component.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsieve.llm.common import cut, mix, release, shingles, table, values, word_hashes
from textsieve.llm.graph import component_ids

PERCENT = 80
COUNTERS = 1 << 19
FREQUENT = 32                 # prefixes that hold a token, from which on it is frequent
PER_CLASS = 8                 # prefix tokens of a class that a level aims at
BLOCK_TOKENS, BLOCK_DOCS = 1 << 18, 512
MARKS, MARK_BITS = 1 << 23, 26
MAX_BROADCAST = 200_000       # members (some 150 bytes each)
_COUNTER_SHIFT = np.uint64(64 - 19)
_NAME = 0xA5A5A5A5A5A5A5A5


def may_miss(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that a similar set may lack."""
    return n - -(-n * percent // 100)


def may_link(n, percent: int = PERCENT):
    """Whether a set of n tokens can be similar to another than an equal one: to itself and one token more."""
    return n * (100 - percent) >= percent


def levels(n: int, percent: int = PERCENT) -> list[int]:
    """Size levels (power of two) in which a set of n is indexed: its own and those its partners may have."""
    lo, hi = -(-n * percent // 100), n * 100 // percent
    return list(range(max(lo, 1).bit_length() - 1, max(hi, 1).bit_length()))


def classes(level: int, percent: int = PERCENT) -> int:
    """Classes of frequent tokens at a level."""
    return max(1, may_miss(1 << level, percent) // PER_CLASS)


def singly(level: int, percent: int = PERCENT) -> bool:
    """Whether similar sets whose larger one is of the level may share no two tokens of one class."""
    return -(-(1 << level) * percent // 100) <= classes(level, percent)


def word_counters(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Documents per hashed word, on a logarithmic scale: ``COUNTERS`` numbers, whatever the size of the corpus."""
    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for text in values(b.column(0)):
                if text:
                    at = np.sort(word_hashes(text) >> _COUNTER_SHIFT).astype(np.int64)
                    total[at] += 1        # a repeated index counts once
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo:lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["at", "n"])

    out = np.zeros(COUNTERS, np.uint16)
    counts = (texts.select(text_col).mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
              .toArrow())                     # at most COUNTERS rows
    out[counts.column("at").to_numpy()] = (np.log2(1.0 + counts.column("n").to_numpy()) * 1000).astype(np.uint16)
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def token_set(text: str | None) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return distinct(shingles(word_hashes(text))) if text else np.empty(0, np.uint64)


def ordered_tokens(w: np.ndarray, s: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """The tokens of a text in the global order, as numbers that sort so: 16 bits of the least word count of the
    shingle, then 48 of its hash; from the hashes of its words and shingles."""
    c = counters[(w >> _COUNTER_SHIFT).astype(np.int64)]
    least = c[:len(s)]
    for j in range(1, len(w) - len(s) + 1):
        least = np.minimum(least, c[j:len(s) + j])
    return distinct((least.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)))


def name_of(s: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set, whatever the order of its tokens."""
    with np.errstate(over="ignore"):
        return int(s.sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(_NAME)).sum(dtype=np.uint64).astype(np.int64))


def describe(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """row id, n (set size), h1, h2 (128-bit name of the set), prefix (longest that may be needed, in order)."""
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    counters = docs.sparkSession.sparkContext.broadcast(word_counters(src))

    def run(batches):
        for b in batches:
            n, names, prefix = [], [], []
            for text in values(b.column(1)):
                w = word_hashes(text) if text else np.empty(0, np.uint64)
                each = shingles(w)
                s = distinct(each)
                n.append(len(s))
                names.append(name_of(s))
                longest = may_miss(len(s), percent) + 1 + classes(levels(len(s), percent)[-1], percent) if may_link(len(s), percent) else 0
                prefix.append(ordered_tokens(w, each, counters.value)[:longest].view(np.int64) if longest else [])
            h1, h2 = zip(*names) if names else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                 pa.array(prefix, pa.list_(pa.int64()))], names=["id", "n", "h1", "h2", "prefix"])

    return src.mapInArrow(run, "id bigint, n int, h1 bigint, h2 bigint, prefix array<bigint>")


def signatures_of(n: int, places: np.ndarray, tokens: np.ndarray, frequent: np.ndarray,
                  percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set of n tokens.  ``tokens`` (ascending ``places``) are those of its prefix that other
    prefixes have too; every other place holds a token of this prefix alone, which is rare."""
    out = []
    for level in levels(n, percent):
        kind = tokens % np.uint64(classes(level, percent))
        often = np.zeros_like(frequent) if singly(level, percent) else frequent
        at = np.flatnonzero(often)
        firsts = places[at[np.unique(kind[at], return_index=True)[1]]]
        end = may_miss(n, percent) + 1
        for p in np.sort(firsts):               # the first frequent token of a class covers no miss
            if p >= end:
                break
            end += 1
        salt = np.uint64(level + 1)
        out.append(mix(tokens[(places < end) & ~often] * np.uint64(3) + salt))
        pairs = (places < end) & often
        for c in np.unique(kind[pairs]):
            own = np.sort(tokens[pairs & (kind == c)])
            i, j = np.triu_indices(len(own), 1)
            out.append(mix(mix(own[i] + salt) * np.uint64(5) + own[j]))
    return np.unique(np.concatenate(out))


def shared_marks(shared: DataFrame) -> np.ndarray:
    """A bit for each value of the lowest ``MARK_BITS`` of a token, set where a shared token has it."""
    at = F.col("token").bitwiseAND(F.lit((1 << MARK_BITS) - 1)) + 1
    parts = (shared.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
             .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow())     # 4 kB for 32,768 marks
    out = np.zeros(1 << MARK_BITS >> 3, np.uint8)
    for bucket, bits in zip(parts.column("bucket").to_pylist(), parts.column("bits").to_pylist()):
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def signatures(prefixes: DataFrame, percent: int) -> DataFrame:
    """(sig, row) for prefixes (row, n, prefix)."""
    shared = cut(prefixes.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
                 .where("c >= 2").select("token", (F.col("c") >= FREQUENT).alias("frequent")))
    marks = prefixes.sparkSession.sparkContext.broadcast(shared_marks(shared))

    def possible(batches):
        """Tokens with a mark; all that are shared have one."""
        for b in batches:
            prefix = b.column(2)
            size = prefix.value_lengths().to_numpy()
            token = prefix.flatten().to_numpy()
            place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            at = token & ((1 << MARK_BITS) - 1)
            on = np.flatnonzero((marks.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            owner = np.repeat(np.arange(b.num_rows), size)[on]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)),
                                              pa.array(place[on].astype(np.int32)), pa.array(token[on])],
                                             names=["row", "n", "place", "token"])

    tokens = prefixes.select("row", "n", "prefix").mapInArrow(possible, "row bigint, n int, place int, token bigint")
    known = (tokens.join(shared, "token").groupBy("row", "n")
             .agg(F.sort_array(F.collect_list(F.struct("place", "token", "frequent"))).alias("known")))

    def run(batches):
        for b in batches:
            sig, row = [], []
            known = b.column(2)
            for i in range(len(known)):
                items = known[i].values
                got = signatures_of(b.column(1)[i].as_py(), items.field(0).to_numpy().astype(np.int64),
                                    items.field(1).to_numpy().view(np.uint64),
                                    items.field(2).to_numpy(zero_copy_only=False).astype(bool), percent)
                sig.append(got.view(np.int64))
                row.append(np.full(len(got), b.column(0)[i].as_py(), np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(row))],
                                                 names=["sig", "row"])

    return known.select("row", "n", "known").mapInArrow(run, "sig bigint, row bigint")


def candidate_groups(sigs: DataFrame) -> DataFrame:
    """(row, part): a signature's group is named by its smallest row; rows that share a signature share its group."""
    centre = sigs.groupBy("sig").agg(F.min("row").alias("m"), F.max("row").alias("x")).where("m < x").select("sig", "m")
    return sigs.join(centre, "sig").select("row", F.col("m").alias("part")).distinct()


def sized(members: DataFrame, percent: int) -> DataFrame:
    """Members (part, n, ...) without those whose group holds no other set of a size that can be similar.

    Sizes fall into classes of the ratio that similar sets may have, so partners are in the same class or in the nearest
    ones; groups are counted by class, never gathered."""
    ratio = F.lit(percent / 100)
    members = members.withColumn("size_class", F.floor(F.log("n") / -F.log(ratio)).cast("int"))
    found = members.groupBy("part", "size_class").agg(F.count("*").alias("same"), F.min("n").alias("low"), F.max("n").alias("high"))
    # partners are in the same class or the next; one more is looked at, as rounding may put sizes on an edge
    step = F.col("step")
    near = (found.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(-2, 3)])))
            .withColumn("size_class", F.col("size_class") + step).groupBy("part", "size_class")
            .agg(F.sum(F.when(step == 0, F.col("same"))).alias("same"), F.min(F.when(step < 0, F.col("low"))).alias("above"),
                 F.max(F.when(step > 0, F.col("high"))).alias("below")))
    n = F.col("n")
    partner = ((F.col("same") > 1) | F.coalesce(F.col("above") * percent <= n * 100, F.lit(False))
               | F.coalesce(F.col("below") * 100 >= n * percent, F.lit(False)))
    return members.join(near, ["part", "size_class"]).where(partner).drop("size_class", "same", "above", "below")


def verify_group(rows: np.ndarray, sides: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], percent: int,
                 parts: list[set[int]] | None = None, part: int = 0):
    """Links of one group.  With two sides only pairs across them count, else all pairs.
    With ``parts`` (the groups of each row) a link counts only in the smallest group that both rows are in.
    Returns for every row with links: row, a row it is connected to, number of linked documents."""
    m = len(rows)
    n = np.array([len(s) for s in sets], np.int64)
    across = len(np.unique(sides)) > 1
    owner = np.repeat(np.arange(m), n)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    inner = np.ones(len(owner), bool) if not across else sides[owner] == 1     # those that are looked up
    order = np.flatnonzero(inner)[np.argsort(token[inner], kind="stable")]
    listed = owner[order]
    at = np.searchsorted(token[order], np.arange(token.max() + 2))
    root = np.arange(m)
    links = np.zeros(m, np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ends = np.cumsum(n)
    for x in range(m):
        if across and sides[x] == 1:
            continue
        t = token[ends[x] - n[x]:ends[x]]
        lo, size = at[t], at[t + 1] - at[t]
        total = int(size.sum())
        if not total:
            continue
        take = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        common = np.bincount(listed[take], minlength=m)
        hit = 100 * common >= percent * (n[x] + n - common)
        hit[x] = False
        if across:
            hit &= sides == 1
        found = np.flatnonzero(hit)
        if len(found):
            counted = found if parts is None else found[[min(parts[x] & parts[y]) == part for y in found]]
            links[x] += copies[counted].sum()
            if across:
                links[counted] += copies[x]
            for y in found:
                a, b = find(x), find(y)
                if a != b:
                    root[max(a, b)] = min(a, b)
    linked = links > 0
    linked |= np.array([find(x) != x for x in range(m)])          # links that another group counts still connect
    for x in np.flatnonzero(linked):
        yield int(rows[x]), int(rows[find(x)]), int(links[x])


def marked(members: DataFrame) -> np.ndarray:
    """``MARKS`` bits; that of a hashed id is set where a member has the id (or another id with this hash)."""
    bits = np.zeros(MARKS, bool)
    bits[members.select(F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int").alias("at")).distinct()
         .toArrow().column("at").to_numpy()] = True
    return np.packbits(bits)


def verified_links(docs: DataFrame, members: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, links) from candidate members (id, row, h1, h2, n, copies, part, parts).

    What is shuffled is the texts of members (a text without a mark is none), which are smaller than their sets;
    the sets are made again in the group that compares them."""
    size = members.groupBy("part").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs")).where("docs > 1")
    blocks = F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("docs") / BLOCK_DOCS)).cast("int")
    members = (members.join(size, "part").withColumn("blocks", blocks)
               .withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
               .select("id", "row", "h1", "h2", "copies", "part", "parts", "blocks", "block"))
    marks = docs.sparkSession.sparkContext.broadcast(marked(members))

    def pick(batches):
        for b in batches:
            at = b.column(2).to_numpy()
            on = np.flatnonzero((marks.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            yield b.select([0, 1]).take(pa.array(on))

    if members.count() <= MAX_BROADCAST:          # else both sides are shuffled, the texts once more
        members = F.broadcast(members)
    whole = (docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
             .select("id", "text", F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int").alias("mark"))
             .mapInArrow(pick, "id bigint, text string").join(members, "id"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = (whole.select("row", "copies", "part", "parts", "block", "h1", "h2", "text", other)
             .select("part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "row", "copies", "h1", "h2", "text", "parts"))
    dealt = dealt.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j")

    def verify(batches):
        def flush(group):
            kept = {r[0]: r for r in group}           # a repeated row of the input brings its set twice
            if len(kept) < 2:
                return None
            rows, side, copies, sets, parts = zip(*kept.values())
            if key[1] != key[2] and len(set(side)) < 2:       # one of the two blocks is empty: its own group has these pairs
                return None
            got = list(verify_group(np.array(rows), np.array(side), np.array(copies), list(sets), percent, parts, key[0]))
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*got)],
                                              names=["a", "b", "links"]) if got else None

        key, group = None, []
        for b in batches:
            for i in range(b.num_rows):
                k = tuple(b.column(c)[i].as_py() for c in range(3))
                if k != key:
                    if group and (out := flush(group)) is not None:
                        yield out
                    key, group = k, []
                s = token_set(b.column(8)[i].as_py())
                if name_of(s) == (b.column(6)[i].as_py(), b.column(7)[i].as_py()):      # else another row with this id
                    group.append((b.column(4)[i].as_py(), b.column(3)[i].as_py(), b.column(5)[i].as_py(), s,
                                  set(b.column(9)[i].as_py())))
        if group and (out := flush(group)) is not None:
            yield out

    return dealt.mapInArrow(verify, "a bigint, b bigint, links bigint")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_links (documents linked directly)."""
    rows = cut(describe(docs, id_col, text_col, percent).withColumn("row", F.monotonically_increasing_id()))
    named = rows.where("id IS NOT NULL AND n > 0")
    folded = cut(named.groupBy("h1", "h2", "n").agg(F.min("row").alias("rep"), F.count("*").alias("copies")))
    # copies are indexed as well (linear in their number); only representatives are verified
    sigs = cut(signatures(named.where(may_link(F.col("n"), percent)).select("row", "n", "prefix"), percent))
    release(docs.sparkSession)                # the shuffles of tokens are no longer needed
    pairs = candidate_groups(sigs).join(folded.select(F.col("rep").alias("row"), "h1", "h2", "n", "copies"), "row")
    pairs = cut(sized(cut(pairs), percent))
    lists = pairs.groupBy("row").agg(F.collect_list("part").alias("parts"))
    members = cut(named.select("id", "row").join(pairs, "row").join(lists, "row"))
    del sigs, pairs, lists
    release(docs.sparkSession)
    verified = cut(verified_links(docs, members, percent, id_col, text_col))
    copies = named.join(folded.where("copies > 1").select("h1", "h2", "n", "rep"), ["h1", "h2", "n"])
    links = verified.select("a", "b").unionByName(copies.select(F.col("row").alias("a"), F.col("rep").alias("b")))
    parts = component_ids(named, links)
    degrees = verified.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    by_set = (folded.join(degrees, "rep", "left")
              .select("h1", "h2", "n", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    own = rows.select("row", "id", "n", "h1", "h2").join(parts, "row", "left")
    return (own.join(by_set.where("n_links > 0"), ["h1", "h2", "n"], "left")
            .select(F.col("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id"),
                    F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links")))


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op3_jaccard_join": op3_jaccard_join}
