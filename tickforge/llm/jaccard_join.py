"""Exact Jaccard join of documents on word shingles in a metric space.

Jaccard distance d is a metric; two documents link at d <= R. The join goes from coarse regions to fine ones:

1. Equal sets become one document. The first pivots are sets of a single shingle: a document is nearer than 1
   to those of its own shingles only, and linked documents share one of the first n - ceil(0.8 n) + 1 shingles of
   any common order (and k more of k more), so a document is replicated to the regions of these. Documents that
   share fewer of them with others link with nothing and are left out. For the rest the order is made exact, rare shingles first
   (by the number of documents that have them), and a pair is compared only if enough shingles follow the one it meets
   at in both sets. Regions with the same members are one region.
2. A region of up to SMALL documents is joined directly. Larger ones whose first member in a random order of documents is the
   same, which two are with the chance that a member of either is one of both, become one region where its size squared is no more
   than the sum of theirs: near copies share many shingles, so many regions hold them all but a few. A region elects document
   pivots, every member is
   measured against them, and those within R are linked. Its members then go to the Voronoi cell of the nearest
   pivot p if that is within NEAR, and as replicas to each other cell q with d(x, q) <= d(x, nearest) + 2 R and
   d(x, q) <= NEAR + R: if x links with a y of cell q, both hold. Members far from all pivots make one more cell, which
   needs no replicas, as its pairs with nearer documents are found in the cells of these. Pivots say nothing about such
   members; they are divided again by single shingles, now in the order of how many of them have each, as those that are
   rare among them tell apart what the region's own shingle brought together. This is done wherever it at least
   halves the sum of squares of the sizes, so that texts of a few common lines divide by pairs of lines, then by three.
3. A cell whose documents are in one component is done. Where all but SPARSE documents are in one, these are taken
   to the others in rows of their own, and compared where the triangle inequality's window, |d(x, p) - d(y, p)| <= R,
   and the sizes let them link; only links come out. Other cells are regions of the
   next round, with twice as many pivots, so the number of rounds grows with the logarithm of a region.

A link between two components is never skipped, so components are exact. Sets are compared by fingerprints
of shingles, made of 62-bit prints of words modulo a prime: for 10**10 documents of 300 shingles, about 10**-3 of their sets
would hold two of the same print. Someone who knows the constants could write two words of one print.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, CHUNK_BYTES, PrimePrints, block_root, cut_blocks, in_sorted, load_block, mixed, pack48, save_block, unpack48
from .components import connected_components
from .scratch import Scratch
from .worker import begin, bound_batches, trim

SHINGLE_WORDS, LINK = 5, 80  # words of a shingle; per cent of the union that two linked documents share
R = 1 - LINK / 100
PART_DOCS, LEAST_PARTS = 20_000, 256
#: Frequent shingles: found at least so often in a block; kept by so many bits, the most frequent first.
OFTEN, TABLE_BITS, TABLE_KEYS = 2, 24, 1 << 18
#: Documents of a region that is joined directly, pivots of a larger one in the first round, farthest distance to a cell's pivot.
SMALL, PIVOTS, NEAR = 24, 8, 0.4
#: Documents of a cell outside its largest component, up to which they are measured against the others.
SPARSE = 256
#: Bytes of sets in a row that is compared with a cell's documents, on average.
PACKED_BYTES = 1 << 20
KEY = np.uint64((1 << 48) - 1)
_U = np.uint64
_WORDS = PrimePrints()
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FACTORS = [_U(pow(0x8EBC6AF09C88C6E3, k + 1, 1 << 64)) for k in range(SHINGLE_WORDS)]


def shingle_sets(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Document and fingerprint of the distinct shingles of all texts, sorted."""
    docs, prints = [], []
    part, first, held = [], 0, 0
    for k, t in enumerate(texts):
        part.append((t or "").encode())
        held += len(part[-1])
        if held >= CHUNK_BYTES or k + 1 == len(texts):
            d, p = _shingles_of(part)
            docs.append(d + first)
            prints.append(p)
            part, first, held = [], k + 1, 0
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(docs), np.concatenate(prints)


def _shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = b" ".join(texts).translate(_LOWER) + b" "
    data = np.frombuffer(raw, np.uint8)
    starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    word = mixed(_WORDS(data.astype(np.uint64) + _U(1), begin, end) + (end - begin).astype(np.uint64) * _U(0x9FB21C651E98DF25))
    doc = np.searchsorted(starts, begin, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    k = SHINGLE_WORDS
    h, where = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(word) >= k:
        h = word[:len(word) - k + 1] * _FACTORS[0]
        for i in range(1, k):
            h += word[i:len(word) - k + 1 + i] * _FACTORS[i]
        same = doc[:len(word) - k + 1] == doc[k - 1:]
        h, where = mixed(h[same]), doc[:len(word) - k + 1][same]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        at = np.cumsum(n) - n
        whole = []
        for d in short.tolist():
            v = int(n[d]) * 0x2545F4914F6CDD1D
            for w in word[at[d]:at[d] + n[d]].tolist():
                v = (v * 0x9E3779B97F4A7C15 + w + 1) & (1 << 64) - 1
            whole.append(v & (1 << 64) - 1)
        h, where = np.concatenate([h, mixed(np.array(whole, np.uint64))]), np.concatenate([where, short])
    order = np.lexsort((h, where))
    h, where = h[order], where[order]
    new = np.append(True, (h[1:] != h[:-1]) | (where[1:] != where[:-1])) if len(h) else np.empty(0, bool)
    return where[new], h[new]


def _bit(prints: np.ndarray) -> np.ndarray:
    return (prints >> _U(64 - TABLE_BITS)).astype(np.int64)


def _ranks(doc: np.ndarray, prints: np.ndarray, weight: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each shingle its place in its document's order (by weight, then fingerprint) and the document's number of shingles."""
    n = np.bincount(doc, minlength=docs)
    order = np.lexsort((prints, weight, doc))
    rank = np.empty(len(doc), np.int64)
    rank[order] = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return rank, n[doc]


def _prefix(n, several=0):
    """Number of a set's first shingles, of which linked sets share one, and `several` more of as many more."""
    return n - -(-LINK * n // 100) + 1 + several


def _several(n):
    """How many shared shingles more than one are asked of a longer prefix in the first pass."""
    return n // 20


def _set_keys(doc: np.ndarray, prints: np.ndarray, docs: int) -> tuple[np.ndarray, ...]:
    """For each document its number of shingles and a 128-bit key of its set."""
    n = np.bincount(doc, minlength=docs)
    keys = [np.zeros(docs, np.uint64), np.zeros(docs, np.uint64)]
    if len(doc):
        full = n > 0
        at = (np.cumsum(n) - n)[full]
        for out, c in zip(keys, (0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB)):
            out[full] = np.add.reduceat(mixed(prints * _U(c) + _U(c >> 7)), at)
    return n, keys[0].view(np.int64), keys[1].view(np.int64)


def _firsts(s: np.ndarray, s2: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which documents are the first of their set in a block; none of an empty set."""
    order = np.lexsort((s2, s))
    new = np.append(True, (s[order][1:] != s[order][:-1]) | (s2[order][1:] != s2[order][:-1])) if len(s) else np.empty(0, bool)
    out = np.zeros(len(s), bool)
    out[order[new]] = True
    return out & (n > 0)


def _by_part(name: str, keys: np.ndarray, count: np.ndarray, own: np.ndarray, parts: int) -> dict:
    """Rows (part, block, keys, counts up to 255, own) of one block's sorted keys; own goes with one row, which each block has."""
    part = (keys & _U(parts - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keys, count, part = keys[order], count[order], part[order]
    at = np.searchsorted(part, np.arange(parts + 1))
    rows = [p for p in range(parts) if at[p + 1] > at[p]] or [0]
    return {"part": pa.array(rows, pa.int32()), "block": pa.array([name] * len(rows)), "keys": pa.array([pack48(keys[at[p]:at[p + 1]]) for p in rows], pa.binary()),
            "counts": pa.array([np.minimum(count[at[p]:at[p + 1]], 255).astype("u1").tobytes() for p in rows], pa.binary()), "own": pa.array([own.astype("<i4").tobytes()] + [None] * (len(rows) - 1), pa.binary())}


_BY_PART = "part int, block string, keys binary, counts binary, own binary"


def _meet(t: pa.Table) -> pa.Table:
    """For each block of a part those of its keys that are there twice or more, with their total counts."""
    begin("jaccard_join")
    keys = [unpack48(k) for k in t.column("keys").to_pylist()]
    count = np.concatenate([np.frombuffer(c, "u1") for c in t.column("counts").to_pylist()]).astype(np.int64)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(every[order]) != 0)) if len(every) else np.empty(0, np.int64)
    total = np.add.reduceat(count[order], start) if len(every) else np.empty(0, np.int64)
    shared, total = every[order][start][total > 1], total[total > 1]
    names, own = t.column("block").to_pylist(), t.column("own").to_pylist()
    rows = []
    for k, x in enumerate(keys):
        found = x[in_sorted(x, shared)]
        if len(found) or own[k] is not None:
            rows.append((names[k], pack48(found), np.minimum(total[np.searchsorted(shared, found)], (1 << 32) - 1).astype("<u4").tobytes(), own[k]))
    kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["block", "keys", "counts", "own"])


_MET = "block string, keys binary, counts binary, own binary"


def _met(t: pa.Table) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Name, keys in order, their counts and own of one block."""
    keys = np.concatenate([unpack48(k) for k in t.column("keys").to_pylist()])
    count = np.concatenate([np.frombuffer(c, "<u4") for c in t.column("counts").to_pylist()]).astype(np.int64)
    own = next(np.frombuffer(o, "<i4") for o in t.column("own").to_pylist() if o is not None)
    order = np.argsort(keys, kind="stable")
    return t.column("block")[0].as_py(), keys[order], count[order], own


def _enough(left, sizes):
    """Whether so many shingles shared leave a link possible between sets of so many in sum."""
    return left * (100 + LINK) >= sizes * LINK


def link_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, small: int = SMALL, sparse: int = SPARSE) -> DataFrame:
    """Columns id_col, n_shingles and component_id for every row of docs.

    Two documents link when 100 * shared shingles >= LINK * all shingles of the two. A text with fewer words than
    a shingle has one shingle, its whole sequence; a null text or one without words has none and links with
    nothing, so it is its own component. Rows with a null id link with nothing and have a null component. Equal
    texts always share a component; rows of equal ids count as one document if their texts are equal, else the
    links of each are links of that id. Texts of any length are taken whole. An empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "jaccard_join")
    root = block_root(scratch)
    parts = 1 << max(LEAST_PARTS - 1, docs.count() // PART_DOCS).bit_length()
    inner = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))

    def store(batches):
        """Blocks in the shared folder; a row for each, with its documents and the bits of its frequent shingles."""
        begin("jaccard_join")
        for block in cut_blocks(batches, 1, block_bytes):
            name = save_block(root, block)
            doc, prints = shingle_sets(block.column(1).to_pylist())
            n, s, s2 = _set_keys(doc, prints, block.num_rows)
            first = _firsts(s, s2, n)
            bit, count = np.unique(_bit(prints[first[doc]]), return_counts=True)
            bit, count = bit[count >= OFTEN], count[count >= OFTEN]
            ids = pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([name]), ids, *[pa.array([x], pa.list_(pa.int64())) for x in (n, s, s2)], *[pa.array([x], pa.list_(pa.int32())) for x in (bit, count)]], names=["block", "ids", "n", "s", "s2", "bits", "counts"])

    stored = scratch.table(inner.mapInArrow(store, "block string, ids array<long>, n array<long>, s array<long>, s2 array<long>, bits array<int>, counts array<int>"), "stored")
    often = stored.select(F.explode(F.arrays_zip("bits", "counts")).alias("x")).groupBy("x.bits").agg(F.sum("x.counts").alias("n"))
    often = often.orderBy(F.desc("n"), "bits").limit(TABLE_KEYS).toArrow()  # TABLE_KEYS rows at most
    classes = spark.sparkContext.broadcast((often.column(0).to_numpy(), np.array([min(255, int(8 * math.log2(n))) for n in often.column(1).to_pylist()], np.uint8)))
    members = stored.select("block", F.posexplode(F.arrays_zip("ids", "n", "s", "s2")).alias("pos", "x")).select("block", "pos", F.col("x.ids").alias("id"), "x.n", "x.s", "x.s2")
    placed = members.where("n > 0 AND id IS NOT NULL")
    same = placed.groupBy("s", "s2", "n").agg(F.min(F.struct("id", "block", "pos")).alias("lead"), F.count("*").alias("copies"))
    same = scratch.table(same, "same")  # a row for each distinct set
    leads = same.select("lead.block", "lead.pos").groupBy("block").agg(F.collect_list("pos").alias("pos"))  # no more than a block's documents
    names = scratch.table(stored.select("block").join(leads, "block"), "names")

    def weights() -> np.ndarray:
        out = np.zeros(1 << TABLE_BITS, np.uint8)
        out[classes.value[0]] = classes.value[1]
        return out

    def sets_of(name: str, live: np.ndarray) -> tuple[np.ndarray, ...]:
        block = load_block(root, name)
        doc, prints = shingle_sets(block.column(1).to_pylist())
        keep = np.zeros(block.num_rows, bool)
        keep[live] = True
        keep = keep[doc]
        return np.array(block.column(0).fill_null(0), np.int64), doc[keep], prints[keep]

    def regions(batches):
        begin("jaccard_join")
        weight = weights()
        for batch in batches:
            for name, pos in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                live = np.array(pos, np.int64)
                ids, doc, prints = sets_of(name, live)
                often = weight[_bit(prints)]
                rank, n = _ranks(doc, prints, often, len(ids))
                # a frequent shingle counts as shared without being sent
                keys, count = np.unique(prints[(rank < _prefix(n, _several(n))) & (often == 0)] & KEY, return_counts=True)
                yield pa.RecordBatch.from_pydict(_by_part(name, keys, count, live, parts))
                trim()

    def census(t: pa.Table) -> pa.Table:
        """Counts of all shingles of documents that share enough of their first."""
        begin("jaccard_join")
        name, keys, _, live = _met(t)
        ids, doc, prints = sets_of(name, live)
        often = weights()[_bit(prints)]
        rank, n = _ranks(doc, prints, often, len(ids))
        hit = (rank < _prefix(n, _several(n))) & ((often > 0) | in_sorted(prints & KEY, keys))
        size = np.bincount(doc, minlength=len(ids))
        live = np.flatnonzero((np.bincount(doc[hit], minlength=len(ids)) > _several(size)) & (size > 0))
        keep = np.zeros(len(ids), bool)
        keep[live] = True
        keys, count = np.unique(prints[keep[doc] & (often == 0)] & KEY, return_counts=True)
        return pa.table(_by_part(name, keys, count, live, parts))

    def enter(t: pa.Table) -> pa.Table:
        """Rows with a region: an entry; with shingles: a set."""
        begin("jaccard_join")
        trim()
        name, keys, count, live = _met(t)
        ids, doc, prints = sets_of(name, live)
        often = weights()[_bit(prints)].astype(np.int64)
        found = in_sorted(prints & KEY, keys)
        many = np.ones(len(doc), np.int64)
        many[found] = count[np.searchsorted(keys, prints[found] & KEY)]
        rank, n = _ranks(doc, prints, (often << 40) + many, len(ids))
        hit = np.flatnonzero((rank < _prefix(n)) & (found | (often > 0)))
        involved = np.unique(doc[hit])
        start, stop = np.searchsorted(doc, involved), np.searchsorted(doc, involved, "right")
        none = [None] * len(involved)
        own = pa.array(np.concatenate([ids[doc[hit]], ids[involved]]))
        sizes = pa.array(np.concatenate([n[hit], stop - start]))
        keep = np.zeros(len(ids), bool)
        keep[involved] = True
        values = pa.array(prints[keep[doc]].view(np.int64))
        offsets = np.concatenate([np.zeros(len(hit) + 1, np.int64), np.cumsum(stop - start)]).astype(np.int32)
        sets = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(np.arange(len(offsets) - 1) < len(hit)))
        return pa.table({"region": pa.array(prints[hit].view(np.int64).tolist() + none, pa.int64()), "id": own, "n": sizes, "left": pa.array((n - rank)[hit].tolist() + none, pa.int64()), "shingles": sets})

    step = names.repartition(max(1, min(names.count(), 100_000)), "block").mapInArrow(regions, _BY_PART)
    step = step.groupBy("part").applyInArrow(_meet, _MET).groupBy("block").applyInArrow(census, _BY_PART)
    step = step.groupBy("part").applyInArrow(_meet, _MET).groupBy("block").applyInArrow(enter, "region long, id long, n long, left long, shingles array<long>")
    step = scratch.table(step, "entered")
    scratch.drop("blocks")
    scratch.release()
    sets = step.where("region IS NULL").select("id", "n", "shingles")
    entries = step.where("region IS NOT NULL").select("region", "id", "n", "left")
    print_ = [F.bit_xor(F.xxhash64(F.lit(k), "id", "n")).alias(f"h{k}") for k in range(2)]
    size = entries.groupBy("region").agg(F.count("*").alias("size"), F.max(_enough(F.col("left"), F.col("n") * 2)).alias("any"), *print_).where("size > 1 AND any")
    size = size.select("region", "size", F.min("region").over(Window.partitionBy("size", "h0", "h1")).alias("lead"))  # regions of the same documents are one
    entries = entries.join(size, "region").groupBy(F.col("lead").alias("region"), "id", "n", "size").agg(F.max("left").alias("left"))
    entries = scratch.table(entries, "regions")  # a large region is a skewed key, which Spark splits

    def measured(pairs: DataFrame, own: DataFrame, name: str) -> DataFrame:
        """(a, b, linked, d) of pairs (a, b); sets are joined in one way at every size, as they soon outgrow a broadcast."""
        x, y = (own.select(F.col("id").alias(i), F.col("n").alias("n" + i), F.col("shingles").alias(c)).hint("merge") for i, c in ("ax", "by"))
        both = pairs.distinct().join(x, "a").join(y, "b")
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"), (F.col("na") + F.col("nb")).alias("all"))
        union = F.col("all") - F.col("shared")
        both = both.select("a", "b", (F.col("shared") * 100 >= union * LINK).alias("linked"), (1 - F.col("shared") / union).alias("d"))
        return scratch.table(both.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.min("d").alias("d")), f"measured-{name}")

    def crossing(rows: DataFrame, own: DataFrame) -> DataFrame:
        """Links (a, b) between documents outside a cell's main component and the cell's others."""
        rows = rows.join(own.hint("merge"), ["id", "n"])
        apart = rows.where("component <> main")
        chunks = apart.groupBy("region").agg(F.ceil(F.sum("n") * 8 / PACKED_BYTES).alias("chunks"))
        packed = apart.join(chunks, "region").groupBy("region", F.pmod(F.xxhash64("id"), F.col("chunks"))).agg(F.collect_list(F.struct("id", "n", "left", "d", "home", "component", "shingles")).alias("others")).select("region", "others")

        def linked(o):
            window = (F.abs(F.col("d") - o["d"]) <= R + 1e-9) & (F.col("home") | o["home"])
            fit = _enough(F.least(F.col("left"), o["left"]), F.col("n") + o["n"])
            both = F.size(F.array_intersect(F.col("shingles"), o["shingles"]))
            once = (o["component"] != F.col("component")) & ((F.col("component") == F.col("main")) | (o["id"] < F.col("id")))
            return once & fit & window & (both * 100 >= (F.col("n") + o["n"] - both) * LINK)

        out = rows.join(packed, "region").select(F.col("id").alias("a"), F.explode(F.transform(F.filter("others", linked), lambda o: o["id"])).alias("b"))
        return out.distinct()

    def divided(rows: DataFrame, number: int) -> DataFrame:
        """Regions (region, id, n, left) of the members of far cells by the shingles that are rare in a cell; cells that these don't divide stay."""
        size = rows.groupBy("region").agg(F.count("*").alias("size"))
        each = rows.join(own.hint("merge"), ["id", "n"]).select("region", "id", "n", "left", F.explode("shingles").alias("shingle"))
        often = each.groupBy("region", "shingle").agg(F.count("*").alias("c")).where("c > 1")
        had = each.join(often.hint("merge"), ["region", "shingle"]).groupBy("region", "id", "n", "left").agg(F.array_sort(F.collect_list(F.struct("c", "shingle"))).alias("s"))  # a set at most
        alone = F.col("n") - F.size("s")  # these come first and meet none
        prefix = F.greatest(F.lit(0), (F.col("n") - F.ceil(F.col("n") * LINK / 100) + 1 - alone).cast("int"))
        met = had.select("region", "id", "n", "left", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), prefix)).alias("place", "x"))
        met = met.select("region", F.xxhash64("region", "x.shingle").alias("part"), "id", "n", F.least("left", F.col("n") - F.col("alone") - F.col("place")).alias("left"))
        met = scratch.table(met, f"met-{number}")
        part = met.groupBy("region", "part").agg(F.count("*").alias("c"), *print_).where("c > 1")
        part = part.withColumn("lead", F.min("part").over(Window.partitionBy("region", "c", "h0", "h1")))  # parts of the same documents are one
        pairs = part.where("part = lead").groupBy("region").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        plan = size.join(pairs, "region", "left").select("region", (F.coalesce("pairs", F.lit(0)) * 2 <= F.col("size") * F.col("size")).alias("smaller"))
        plan = scratch.table(plan, f"plan-{number}")
        whole = rows.join(plan.where("NOT smaller"), "region", "left_semi")
        finer = met.join(plan.where("smaller"), "region", "left_semi").join(part.select("part", "lead"), "part")
        return whole.unionByName(finer.groupBy(F.col("lead").alias("region"), "id", "n").agg(F.max("left").alias("left")))

    def united(rows: DataFrame, share: Column, number: int) -> tuple[DataFrame, DataFrame]:
        """Regions (region, least, size) and their members, where regions of nearly the same members are one."""
        least = rows.groupBy("region").agg(F.min_by("id", share).alias("least"), F.count("*").alias("size"))
        least = scratch.table(least, f"least-{number}")
        union = scratch.table(rows.join(least, "region").groupBy("least", "id", "n").agg(F.max("left").alias("left")), f"union-{number}")
        pairs = least.groupBy("least").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
        one = union.groupBy("least").agg(F.count("*").alias("size")).join(pairs, "least").where(F.col("size") * F.col("size") <= F.col("pairs"))
        one = scratch.table(one.select(F.xxhash64(F.lit("union"), "least").alias("region"), "least", "size"), f"one-{number}")
        apart = least.join(one.select("least"), "least", "left_anti").select("region", "least", "size")
        members = union.join(one.select("region", "least"), "least").select("region", "id", "n", "left")
        return one.unionByName(apart), members.unionByName(rows.join(apart.select("region"), "region", "left_semi").select("region", "id", "n", "left"))

    def sided(rows: DataFrame, side: str) -> DataFrame:
        return rows.select("region", *[F.col(c).alias(c + side) for c in rows.columns if c != "region"])

    fit = _enough(F.least("leftx", "lefty"), F.col("nx") + F.col("ny"))  # all that two sets share follows the first shingle they share
    rows = entries.where(F.col("size") <= small).select("region", "id", "n", "left")
    pairs = sided(rows, "x").join(sided(rows, "y"), "region").where("idx < idy").where(fit)
    links = measured(pairs.select(F.col("idx").alias("a"), F.col("idy").alias("b")), sets, "small").where("linked").select("a", "b")
    rest = entries.where(F.col("size") > small).select("region", "id", "n", "left")
    own = scratch.table(sets.join(rest.select("id").distinct(), "id", "left_semi"), "own")  # sets of large regions
    number = 0
    while rest.limit(1).count():
        share = F.pmod(F.xxhash64(F.lit(number), "id"), F.lit(1 << 40)) / (1 << 40)
        size, here = united(rest, share, number)
        here = here.join(size, "region").withColumn("elected", (F.col("id") == F.col("least")) | (share * F.col("size") < PIVOTS << number))
        here = scratch.table(here, f"here-{number}")
        pivots = here.where("elected").select("region", F.col("id").alias("pivot")).distinct()
        once = F.when(F.col("elected"), F.col("id") < F.col("pivot")).otherwise(F.col("id") != F.col("pivot"))
        star = scratch.table(here.join(pivots, "region").where(once).select("region", "id", "n", "left", "elected", "pivot"), f"star-{number}")
        seen = measured(star.select(F.col("id").alias("a"), F.col("pivot").alias("b")), own, str(number))
        links = scratch.table(links.unionByName(seen.where("linked").select("a", "b")), f"links-{number}")
        components = scratch.table(connected_components(links, scratch, f"stars-{number}"), f"components-{number}")
        # pivots leave: all their links in the region are known
        near = star.where("NOT elected").join(seen.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "d"), ["id", "pivot"])
        near = near.withColumn("best", F.min(F.struct("d", "pivot")).over(Window.partitionBy("region", "id", "n")))
        home = F.col("pivot") == F.col("best.pivot")
        far = home & (F.col("best.d") > NEAR)
        inside = (home & ~far) | ((F.col("d") <= F.col("best.d") + 2 * R + 1e-9) & (F.col("d") <= NEAR + R + 1e-9))
        # cells of one pivot are one, whatever regions they come from
        cells = near.where(inside).groupBy(F.xxhash64("pivot").alias("region"), "id", "n").agg(F.max("left").alias("left"), F.min("d").alias("d"), F.max(home & ~far).alias("home"), F.lit(False).alias("far"))
        cells = cells.unionByName(near.where(far).select(F.xxhash64("region", F.lit("far")).alias("region"), "id", "n", "left", "d", F.lit(True).alias("home"), F.lit(True).alias("far")))
        least = cells.groupBy("region").agg(F.min("n").alias("least"))
        partner = F.greatest("least", F.ceil(F.col("n") * LINK / 100))  # the smallest set that may be a partner
        cells = cells.join(least, "region").where(_enough(F.col("left"), F.col("n") + partner)).join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
        cells = scratch.table(cells.drop("least"), f"cells-{number}")
        parted = cells.groupBy("region", "component").agg(F.count("*").alias("c")).groupBy("region").agg(F.sum("c").alias("size"), F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        few = F.col("size") - F.col("main.c") <= sparse
        parted = scratch.table(parted.select("region", F.col("main.component").alias("main"), few.alias("few")), f"parted-{number}")
        unsettled = cells.join(parted, "region")
        rows = unsettled.where("few")
        found = scratch.table(crossing(rows, own), f"found-{number}")
        links = scratch.table(links.unionByName(found), f"all-links-{number}")
        rest = scratch.table(unsettled.where("NOT few").select("region", "id", "n", "left", "far"), f"rest-{number}")
        if rest.where("far").limit(1).count():
            rest = scratch.table(divided(rest.where("far").drop("far"), number).unionByName(rest.where("NOT far").drop("far")), f"divided-{number}")
        rest = rest.select("region", "id", "n", "left")
        for name in ("least", "union", "one", "here", "star", "cells", "parted"):
            scratch.drop(f"{name}-{number}")
        number += 1
    components = scratch.table(connected_components(links, scratch, "all-stars"), "components")
    group = same.select("s", "s2", "n", F.col("lead.id").alias("id")).join(components, "id", "left").select("s", "s2", "n", F.coalesce("component", "id").alias("component"))
    group = scratch.table(group, "groups")
    scratch.drop("entered")
    scratch.drop("regions")
    out = members.join(group, ["s", "s2", "n"], "left")
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.id = d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
