"""Trie of conversation prefixes, family first.

Turns become narrow rows at once: conversation, turn, a 128-bit digest of role and text, and the text's length; the
texts are read once and never shuffled. Conversations are rebuilt from the first turns of their base conversation and
their own later turns; those that share a base id are a family. Turns and base turns of a family are cogrouped by base
id, the family's small trie is built there, and only its combined nodes (with counts, smallest member and lists of at
most a family's conversations) are shuffled and merged by key with those of other families.

A node's key is 120 bits of SHA-256 over the digests of its turns. The digests are hashed in blocks of BLOCK turns:
key(d) = H(P, H(turns of d's block up to d)), where P holds the blocks before, so the blocks of a conversation of any
length are built side by side, and a family is grouped by base id and block. Ranks inside a conversation are prefix
sums over cells of turn numbers. So neither a long conversation nor a large family is ever in one task.

Subtree sums need no rounds. A node's home is its smallest member. The nodes of one home are the end of that
conversation's path, a chain. If T(c) is the sum over the chain of c, and W(x) that over x's chain from x downwards,
the sum over the subtree of x is W(x) plus T(c) of all members c of x but its home: one sum by key, again combined by
family first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Conversations c and c - c % FAMILY are a family; a conversation takes fewer than HEADS turns of its base.
FAMILY, HEADS = 100, 6
#: Turns that are hashed in one task, not fewer than HEADS - 1; cells of turn numbers and of depths have 2 ** CELL_BITS values.
BLOCK, CELL_BITS = 1024, 10
#: Ids of conversations in a piece of the list that ends_sha256 hashes.
PIECE_BITS = 9
_FIRST = -(1 << 63)
_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, chars long, n long, conv long, members array<long>, ends array<long>"
NOTHING = hashlib.sha256(b"").hexdigest()


def _sixty(at: int) -> str:
    return f"cast(conv(substring(hash, {at}, 15), 16, 10) AS bigint)"


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    return rows.withColumn("cell", F.coalesce(F.shiftright("turn", CELL_BITS), F.lit(_FIRST)))


def _ranked(turns: DataFrame, cells: DataFrame) -> DataFrame:
    """turns with their rank in the conversation: turn, null first, then digest."""
    at = Window.partitionBy("conv", "cell").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return turns.withColumn("in_cell", F.row_number().over(at)).join(cells, ["conv", "cell"]).withColumn("rank", F.col("before") + F.col("in_cell"))


def _seams(rows: DataFrame) -> DataFrame:
    """Of rows (base, conv, pos, digest, length) of conversations of several blocks: (base, conv, block, seam, p1, p2, length) of each block but the first.

    seam stands for all blocks before, combined by xor of hashes that hold their places; p1 and p2 are the key of the last node before.
    """
    full = rows.groupBy("base", "conv", "length", F.expr("(pos - 1) div {0}".format(BLOCK)).alias("block"))
    full = full.agg(F.expr("sha2(unhex(array_join(transform(array_sort(collect_list(struct(pos, digest))), x -> hex(x.digest)), '')), 256)").alias("held"))
    hashed = full.withColumn("hash", F.sha2(F.concat(F.col("block").cast("string"), F.lit(":"), F.col("held")).cast("binary"), 256))
    parts = [f"x{k}" for k in range(4)]
    hashed = hashed.select("*", *(F.expr(_sixty(1 + 15 * k)).alias(p) for k, p in enumerate(parts)))
    w = Window.partitionBy("conv").orderBy("block")
    joined = lambda frame: F.concat_ws("-", *(F.bit_xor(p).over(frame).cast("string") for p in parts))
    earlier = F.when(F.col("block") == 0, "").otherwise(joined(w.rowsBetween(Window.unboundedPreceding, -1)))
    out = hashed.select("base", "conv", "length", "block", "held", earlier.alias("earlier"), joined(w.rowsBetween(Window.unboundedPreceding, 0)).alias("seam"))
    out = out.withColumn("hash", F.sha2(F.concat(F.col("earlier").cast("binary"), F.unhex("held")), 256))
    return out.select("base", "conv", (F.col("block") + 1).alias("block"), "seam", F.expr(_sixty(1)).alias("p1"), F.expr(_sixty(16)).alias("p2"), "length")


def _family(turns: pa.Table, heads: pa.Table) -> pa.Table:
    """The trie of one block of a family; a conversation's first row has no turn but tells where it starts."""
    turns = turns.sort_by([("conv", "ascending"), ("pos", "ascending")])
    heads = heads.sort_by("rank")
    opening = list(zip(heads["digest"].to_pylist(), heads["chars"].to_pylist()))
    nodes: dict[tuple, list] = {}

    def add(key, parent, depth, chars, conv, length):
        node = nodes.get(key)
        if node is None:
            node = nodes[key] = [*key, *parent, depth, chars, 0, conv, [], []]
        node[6] += 1
        node[8].append(conv)
        if depth == length:
            node[9].append(conv)
        return key

    names = ["conv", "pos", "digest", "chars", "seam", "p1", "p2", "shift", "length"]
    conv = None
    for c, pos, digest, chars, seam, p1, p2, shift, size in zip(*(turns[n].to_pylist() for n in names)):
        if c != conv:
            conv, length, prefix, held, at = c, size, seam.encode(), hashlib.sha256(), (p1, p2)
            steps = []
            if pos == 0:
                at = add((0, 0), (None, None), 0, 0, conv, length)
                steps = opening[:shift]
        else:
            steps = [(digest, chars)]
        for depth, (d, n) in enumerate(steps, pos if digest is not None else 1):
            held.update(d)
            h = hashlib.sha256(prefix + held.digest()).hexdigest()
            at = add((int(h[:15], 16), int(h[15:30], 16)), at, depth, n, conv, length)
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())] * 2
    columns = zip(*nodes.values()) if nodes else [[]] * 10
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[f.split()[0] for f in _NODE.split(", ")])


def _hash_lists(batches):
    """SHA-256 of the pieces of each key, which come in order; only the open key's state is held."""
    key, state = None, None
    out: list[tuple] = []

    def batch():
        done = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])
        out.clear()
        return done

    for rows in batches:
        for k1, k2, ids in zip(*(rows.column(c).to_pylist() for c in range(3))):
            if key == (k1, k2):
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                out.append((*key, state.hexdigest()))
            key, state = (k1, k2), hashlib.sha256(ids.encode())
        if out:
            yield batch()
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield batch()


def _chain_sums(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes with w_saved and w_leaves, sums of their chain from them downwards; and the sums of whole chains by conv."""
    nodes = nodes.withColumn("cell", F.shiftright("depth", CELL_BITS)).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    cells = nodes.groupBy("conv", "cell").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    below = Window.partitionBy("conv").orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    later = cells.select("conv", "cell", *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"below_{c}") for c in ("saved", "leaf")))
    here = Window.partitionBy("conv", "cell").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.select("*", F.sum("saved").over(here).alias("here_saved"), F.sum("leaf").over(here).alias("here_leaf")).join(later, ["conv", "cell"])
    out = out.select("k1", "k2", (F.col("here_saved") + F.col("below_saved")).alias("w_saved"), (F.col("here_leaf") + F.col("below_leaf")).alias("w_leaves"))
    return out, cells.groupBy("conv").agg(F.sum("saved").alias("t_saved"), F.sum("leaf").alias("t_leaves"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations has conv_id, turn, role and text. Turns are in order of turn, null first; rows of one turn in order of
    a digest of role and text, and repeated rows are repeated turns. Null roles and texts count as empty, rows without
    conv_id are no conversation's, ids may be negative. A conversation shorter than what it would take from its base
    holds those turns only, and none if the base is not there; it then ends at the root. Texts of any length count
    whole. Other columns, whatever their names, are ignored. An empty table has no node, not even a root.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.table(_turns(conversations), "turns")

    counts = turns.groupBy("conv", "cell").agg(F.count("*").alias("rows"))
    convs = counts.groupBy("conv").agg(F.sum("rows").alias("turns"))
    base = (F.col("conv") - F.col("conv") % FAMILY).alias("base")
    bases = convs.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.select("conv", "turns", base, (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h")).join(bases, "base", "left")
    convs = convs.withColumn("shift", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = convs.select("base", "conv", "h", "shift", (F.col("shift") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))).alias("length"))
    convs = scratch.table(convs, "convs")
    before = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.select("conv", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))

    heads = _ranked(turns.where(F.col("conv") % FAMILY == 0), cells).where(F.col("rank") < HEADS)
    heads = heads.select(F.col("conv").alias("base"), F.lit(0).cast("long").alias("block"), *(F.col(c).alias(c) for c in ("rank", "digest", "chars")))
    own = _ranked(turns, cells.join(convs, "conv")).where("rank > h")
    own = own.select("base", "conv", (F.col("shift") + F.col("rank") - F.col("h")).alias("pos"), "digest", "chars", "length")

    whole = lambda at: F.expr(f"{at} <= (length - 1) div {BLOCK} * {BLOCK}")
    opening = heads.join(convs.where(F.col("length") > BLOCK), "base").where("rank <= shift")
    long = own.where(whole("pos")).select("base", "conv", "pos", "digest", "length")
    seams = _seams(long.unionByName(opening.where(whole("rank")).select("base", "conv", F.col("rank").alias("pos"), "digest", "length")))
    none = lambda kind: F.lit(None).cast(kind)
    rows = own.select("base", F.expr(f"(pos - 1) div {BLOCK}").alias("block"), "conv", "pos", "digest", "chars", none("string").alias("seam"), none("long").alias("p1"), none("long").alias("p2"), none("long").alias("shift"), "length")
    rows = rows.unionByName(convs.select("base", F.lit(0).cast("long").alias("block"), "conv", F.lit(0).cast("long").alias("pos"), none("binary").alias("digest"), none("long").alias("chars"),
                                         F.lit("").alias("seam"), none("long").alias("p1"), none("long").alias("p2"), "shift", "length"))
    rows = rows.unionByName(seams.select("base", "block", "conv", (F.col("block") * BLOCK).alias("pos"), none("binary").alias("digest"), none("long").alias("chars"),
                                         "seam", "p1", "p2", none("long").alias("shift"), "length"))
    family = rows.groupBy("base", "block").cogroup(heads.groupBy("base", "block")).applyInArrow(_family, _NODE)
    family = scratch.table(family, "family")

    key = ["k1", "k2"]
    merged = family.groupBy(*key).agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("p1", "p2", "depth", "chars")))
    merged = scratch.table(merged.withColumn("saved", (F.col("n") - 1) * F.col("chars")), "merged")
    children = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.table(nodes, "nodes")

    chains, totals = _chain_sums(nodes)
    others = family.select(*key, F.explode("members").alias("conv")).join(totals, "conv")
    others = others.groupBy(*key).agg(F.sum("t_saved").alias("m_saved"), F.sum("t_leaves").alias("m_leaves"))
    pieces = family.where("size(ends) > 0").select(*key, F.explode("ends").alias("id"))
    pieces = pieces.groupBy(*key, F.shiftright("id", PIECE_BITS).alias("piece")).agg(F.expr("array_join(transform(array_sort(collect_list(id)), x -> cast(x AS string)), ',')").alias("ids"))
    ends = pieces.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "ids").mapInArrow(_hash_lists, "k1 long, k2 long, ends_sha256 string")

    out = nodes.join(totals, "conv", "left").join(chains, key).join(others, key, "left").join(ends, key, "left")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    out = out.join(parents, ["p1", "p2"], "left")
    nil = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        (nil("m_leaves") - nil("t_leaves") + F.col("w_leaves")).alias("n_leaves"),
        (nil("m_saved") - nil("t_saved") + F.col("w_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: SQL has no CRC-32; its table of 256 entries is made from the polynomial.
OP11_SQL = """
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
tab AS (SELECT i, c FROM bits WHERE k = 8),
t AS (SELECT conv_id AS c, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS r FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
crc(c, s, r, k) AS (SELECT c, c::VARCHAR, 4294967295::BIGINT, 0 FROM n UNION ALL
  SELECT crc.c, s, xor(r >> 8, tab.c), k + 1 FROM crc JOIN tab ON tab.i = (xor(r, ascii(substr(s, k + 1, 1))) & 255) WHERE k < length(s)),
h AS (SELECT crc.c, crc.c - crc.c % 100 AS b, xor(r, 4294967295) % 6 AS h, least(h, coalesce(n.n, 0)) AS shift FROM crc LEFT JOIN n ON n.c = crc.c - crc.c % 100 WHERE k = length(s)),
rebuilt AS (SELECT h.c, t.r AS d, text, g FROM h JOIN t ON t.c = h.b AND t.r <= h.h UNION ALL SELECT h.c, h.shift + t.r - h.h, text, g FROM h JOIN t ON t.c = h.c AND t.r > h.h),
path AS (SELECT c, d, length(text) AS chars, string_agg(g, '') OVER (PARTITION BY c ORDER BY d) AS p FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM h),
placed AS (SELECT *, min(c) OVER (PARTITION BY p) AS m, count(*) OVER (PARTITION BY p) AS n, max(d) OVER (PARTITION BY c) AS last FROM path),
node AS (SELECT m, d, any_value(n) AS n, any_value((n - 1) * chars) AS saved, coalesce(string_agg(CASE WHEN d = last THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM placed GROUP BY m, d),
kids AS (SELECT q.m, q.d, count(*) AS n FROM node JOIN placed q ON q.c = node.m AND q.d = node.d - 1 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS kids, q.m AS parent FROM node LEFT JOIN kids USING (m, d) LEFT JOIN placed q ON q.c = node.m AND q.d = node.d - 1),
sums AS (SELECT q.m, q.d, sum(saved) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM full_node f JOIN placed q ON q.c = f.m AND q.d <= f.d GROUP BY ALL)
SELECT m::BIGINT AS conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves,
  sums.saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_node JOIN sums USING (m, d)
"""
