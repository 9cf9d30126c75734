"""Removal of passages that occur in an earlier document, by previous factors of 50 bytes over a distributed order of suffixes.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id: the suffix at that
place has a previous factor of 50 bytes or more. Only suffixes that can have one are put in order. Each 50-byte
string names one of its 20-byte grams, that of the least hash (equal strings name equal grams), so:

0. a text of 50 bytes or more that equals, by SHA-256, one of a smaller id goes as a whole and is not looked at further;
1. texts are stored in blocks in the shared folder, and the named grams of each block meet by hash;
2. grams that two blocks share go back to their blocks, where runs of strings naming such a gram (or one that
   two documents of the block share) are cut out; of runs equal in a block, byte by byte, only the first is sent;
   Strings of a gram that very many blocks share are sent one by one and meet by their own hash, so that the
   contexts of a frequent gram don't come to one task;
3. the runs that share a gram meet, and their suffixes are sorted by their first 50 bytes, then by document. A
   suffix has a previous factor of 50 bytes or more if it equals the neighbour before it in those bytes and its
   document isn't the first of such equals. That is all that the cut needs: the array of longest previous factors
   with its previous and next smaller positions is not built, lengths beyond or below 50 bytes are never known;
4. the places found go back to the blocks, where the bytes they cover are removed.

What steps 2 and 3 found is written to the shared folder, so that the shuffle files before it can go.

Apart from the digests of whole texts, hashes choose what meets; bytes alone decide what goes. Whole texts are never shuffled; what is shuffled are grams
(6 bytes each) and the runs. A passage in a third of all documents is one entry per block, not per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, CHUNK_BYTES, Powers, block_root, cut_blocks, in_sorted, load_block, mixed, pack48, save_block, text_bytes, unpack48
from .scratch import Scratch
from .worker import begin, bound_batches, trim

LENGTH, GRAM = 50, 20
#: Documents whose grams make one part, and the least number of parts.
PART_DOCS, LEAST_PARTS = 20_000, 256
#: Strings of a run, one bit of a mask each; suffixes that are sorted at once.
RUN, SLICE = 32, 1 << 20
#: Blocks of a gram beyond which its strings meet one by one.
HOT_BLOCKS = 2048
#: Tasks that the copies of one text are dealt to.
SALTS = 8
KEY = np.uint64((1 << 48) - 1)
_U = np.uint64


_GRAMS, _PREFIXES = Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


def _sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers.upto(len(data))[0], out=out[1:])
    return out


def _window_hashes(data: np.ndarray, size: int, powers: Powers) -> np.ndarray:
    s = _sums(data, powers)
    h = s[size:] - s[:-size]
    h *= powers.upto(len(data))[1][:len(h)]
    return mixed(h)


def _segments(bounds: np.ndarray, chunk_bytes: int, skip: np.ndarray | None = None):
    """Chunks of (document, start, end): whole texts, or overlapping parts of long ones, of LENGTH bytes at least."""
    chunk, held = [], 0
    use = np.diff(bounds) >= LENGTH
    if skip is not None:
        use[skip] = False
    for d in np.flatnonzero(use).tolist():
        a, end = int(bounds[d]), int(bounds[d + 1])
        while end - a >= LENGTH:
            b = min(end, a + chunk_bytes)
            chunk.append((d, a, b))
            held += b - a
            if held >= chunk_bytes:
                yield chunk
                chunk, held = [], 0
            a = b - LENGTH + 1
    if chunk:
        yield chunk


def runs_of_strings(data: np.ndarray, bounds: np.ndarray, chunk_bytes: int = CHUNK_BYTES, skip: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of consecutive 50-byte strings that name the same gram: document, place, number of strings, gram, fingerprint of the run's bytes. Documents of skip are left out."""
    out = []
    for chunk in _segments(bounds, chunk_bytes, skip):
        text = np.concatenate([data[a:b] for _, a, b in chunk]) if len(chunk) > 1 else data[chunk[0][1]:chunk[0][2]]
        sizes = np.array([b - a for _, a, b in chunk])
        ends = np.cumsum(sizes)
        least = _window_hashes(text, GRAM, _GRAMS)
        span = 1
        while 2 * span <= LENGTH - GRAM + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = LENGTH - GRAM + 1 - span
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        n = len(least)  # a string starts at each place, but for those across two texts
        new = np.ones(n + 1, bool)
        new[1:n] = least[1:] != least[:-1]
        for e in ends[:-1].tolist():
            new[max(0, e - LENGTH + 1)] = new[min(e, n)] = True
        at = np.flatnonzero(new[:n])
        count = np.diff(np.append(at, n))
        if (count > RUN).any():
            pieces = -(-count // RUN)
            first = np.repeat(np.cumsum(pieces) - pieces, pieces)
            inner = np.arange(pieces.sum()) - first
            left = np.repeat(count, pieces) - RUN * inner
            at, count = np.repeat(at, pieces) + RUN * inner, np.minimum(left, RUN)
        seg = np.searchsorted(ends, at, "right")
        whole = at + LENGTH <= ends[seg]
        at, count, seg = at[whole], count[whole], seg[whole]
        s = _sums(text, _PREFIXES)
        h = (s[at + count + LENGTH - 1] - s[at]) * _PREFIXES.upto(len(text))[1][at]
        print_ = mixed(h + count.astype(np.uint64) * _U(0x9FB21C651E98DF25))
        shift = np.array([a for _, a, _ in chunk]) - (ends - sizes)
        out.append((np.array([d for d, _, _ in chunk])[seg], at + shift[seg], count, least[at], print_))
    if not out:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def previous_factors(text: np.ndarray, place: np.ndarray, owner: np.ndarray, most: int = SLICE) -> np.ndarray:
    """Whether the suffix at each place has a previous factor of LENGTH bytes or more: one in a document that stands before its owner.

    More suffixes than most are sorted in ranges of their first bytes, one after the other.
    """
    out = np.zeros(len(place), bool)
    start = (text[place].astype(np.int32) << 16) | (text[place + 1].astype(np.int32) << 8) | text[place + 2]
    ranged = np.lexsort((owner, start)) if len(place) > most else np.argsort(owner, kind="stable")
    bound = [0]
    if len(place) > most:
        new = np.flatnonzero(np.diff(start[ranged])) + 1
        while len(place) - bound[-1] > most and len(new) and new[-1] > bound[-1]:
            k = np.searchsorted(new, bound[-1] + most, "right")
            bound.append(int(new[k - 1] if k and new[k - 1] > bound[-1] else new[k]))
    for a, b in zip(bound, [*bound[1:], len(place)]):
        by_owner = ranged[a:b]
        strings = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[place[by_owner]]
        order = np.argsort(strings.view(f"S{LENGTH}").ravel(), kind="stable")  # suffixes by bytes, equal ones by owner
        strings, owners = strings[order], owner[by_owner][order]
        common = np.append(False, (strings[1:] == strings[:-1]).all(axis=1))  # LENGTH bytes in common with the neighbour before
        first = np.maximum.accumulate(np.where(common, 0, np.arange(len(order))))
        out[by_owner[order]] = owners > owners[first]
    return out


def _singles(data: np.ndarray, place: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The single strings of runs: which run, place and fingerprint."""
    of = np.repeat(np.arange(len(count)), count)
    at = np.repeat(place, count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    up = _PREFIXES.upto(LENGTH)[0]
    views, out = np.lib.stride_tricks.sliding_window_view(data, LENGTH), np.empty(len(at), np.uint64)
    for a in range(0, len(at), 1 << 14):
        out[a:a + (1 << 14)] = ((views[at[a:a + (1 << 14)]].astype(np.uint64) + _U(1)) * up).sum(axis=1, dtype=np.uint64)
    return of, at, mixed(out)


def _equal_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of these sizes at x and y are equal."""
    out = np.zeros(len(x), bool)
    for n in np.unique(size).tolist():
        for part in np.array_split(np.flatnonzero(size == n), max(1, int((size == n).sum()) >> 14)):
            views = np.lib.stride_tricks.sliding_window_view(data, n)
            out[part] = (views[x[part]] == views[y[part]]).all(axis=1)
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, whole: bool = False,
                   block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Columns id_col (and those of keep), n_bytes, n_removed, n_spans and kept (binary) for every row of docs.

    kept holds the remaining bytes; a cut may split a character, of which kept has no byte if whole is set. A null text counts as empty (0 bytes, nothing
    removed). A row with a null id neither loses bytes nor makes others lose any; rows of equal ids don't
    affect one another, and each row comes out once. Texts under 50 bytes stay whole; longer ones of any
    length are processed whole. An empty table gives no rows. Names in docs may clash with those
    used here; a column of keep that has the name of one given out here is left out. Blocks are written once a call,
    under names of their own for each attempt of a task, and stay in the shared folder for as long as the result may
    be read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "suffix_dedup")
    root = block_root(scratch)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    columns = [c for c in (keep or [id_col]) if c == id_col or c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    columns = columns if id_col in columns else [id_col, *columns]
    id_at = columns.index(id_col)
    parts = 1 << max(LEAST_PARTS - 1, docs.count() // PART_DOCS).bit_length()
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col(f"`{text_col}`").alias("t"), F.col(f"`{id_col}`").cast("long").alias("i"))
    text_at = len(columns)

    def scan(batch, copies):
        data, bounds = text_bytes(batch.column(text_at))
        ids, known = batch.column(text_at + 1), np.array(batch.column(text_at + 1).is_valid(), dtype=bool)
        ids = np.array(ids.fill_null(0), np.int64)
        doc, place, count, gram, print_ = runs_of_strings(data, bounds, chunk_bytes, copies)
        live = known[doc] if len(doc) else np.empty(0, bool)
        return data, bounds, ids, doc[live], place[live], count[live], gram[live] & KEY, print_[live]

    def store(batches):
        begin("suffix_dedup")
        for block in cut_blocks(batches, text_at, block_bytes):
            texts, ids = block.column(text_at), block.column(text_at + 1)
            long = np.flatnonzero(np.array(pc.and_(ids.is_valid(), pc.greater_equal(pc.fill_null(pc.binary_length(texts), 0), LENGTH)), bool))
            digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts.take(pa.array(long))]
            lists = [pa.array([x], pa.list_(t)) for x, t in ((long, pa.int64()), (ids.take(pa.array(long)).to_pylist(), pa.int64()), (digests, pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.array([save_block(root, block)]), *lists], names=["block", "pos", "ids", "digests"])

    def grams(batches):
        begin("suffix_dedup")
        for name, copies in (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            copies = np.array(copies or [], np.int64)
            gram = scan(load_block(root, name), copies)[6]
            keys = np.unique(gram)
            part = (keys & _U(parts - 1)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, part = keys[order], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            rows = [p for p in range(parts) if at[p + 1] > at[p]] or [0]  # each block sends a row at least
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([name] * len(rows)), pa.array([pack48(keys[at[p]:at[p + 1]]) for p in rows], pa.binary()), pa.array([copies.astype("<i8").tobytes()] + [None] * (len(rows) - 1), pa.binary())], names=["part", "block", "keys", "copies"])

    def shared(table: pa.Table) -> pa.Table:
        names, copies = table.column("block").to_pylist(), table.column("copies").to_pylist()
        keys = [unpack48(k) for k in table.column("keys").to_pylist()]
        every, blocks = np.unique(np.concatenate(keys), return_counts=True)
        twice, hot = every[blocks > 1], every[blocks > hot_blocks]
        found = [k[in_sorted(k, twice)] for k in keys]
        use = [i for i, f in enumerate(found) if len(f) or copies[i] is not None]
        return pa.table({"block": pa.array([names[i] for i in use], pa.string()), "keys": pa.array([pack48(found[i]) for i in use], pa.binary()), "hot": pa.array([pack48(found[i][in_sorted(found[i], hot)]) for i in use], pa.binary()), "copies": pa.array([copies[i] for i in use], pa.binary())})

    def cut(table: pa.Table) -> pa.Table:
        begin("suffix_dedup")
        trim()
        name = table.column("block")[0].as_py()
        keys = np.sort(np.concatenate([unpack48(k) for k in table.column("keys").to_pylist()]))
        copies = next(c for c in table.column("copies").to_pylist() if c is not None)
        data, _, ids, doc, place, count, gram, print_ = scan(load_block(root, name), np.frombuffer(copies, "<i8"))
        own = ids[doc] if len(doc) else np.empty(0, np.int64)
        order = np.argsort(gram, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(gram[order]) != 0)) if len(order) else np.empty(0, np.int64)
        several = np.zeros(len(doc), bool)
        if len(order):
            apart = np.minimum.reduceat(own[order], start) != np.maximum.reduceat(own[order], start)
            several[order] = np.repeat(apart, np.diff(np.append(start, len(order))))
        use = np.flatnonzero(several | in_sorted(gram, keys))
        own, place, count, gram, print_ = own[use], place[use], count[use], gram[use], print_[use]
        hot = in_sorted(gram, np.sort(np.concatenate([unpack48(k) for k in table.column("hot").to_pylist()])))
        if hot.any():
            of, at, single = _singles(data, place[hot], count[hot])
            own, place, count = (np.concatenate([x[~hot], y]) for x, y in ((own, own[hot][of]), (place, at), (count, np.ones(len(at), count.dtype))))
            gram, print_ = np.concatenate([gram[~hot], single & KEY]), np.concatenate([print_[~hot], single])
        order = np.lexsort((place, own, print_))
        own, place, count, gram, print_ = own[order], place[order], count[order], gram[order], print_[order]
        head = np.append(True, print_[1:] != print_[:-1]) if len(order) else np.empty(0, bool)
        lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) if len(order) else np.empty(0, np.int64)
        same = np.flatnonzero(~head)
        other = same[~((count[same] == count[lead[same]]) & _equal_bytes(data, place[same], place[lead[same]], count[same] + LENGTH - 1))]
        head[other], lead[other] = True, other
        later = own > own[lead] if len(order) else head
        every = ((1 << count[later].astype(np.uint64)) - 1).astype(np.uint64)
        alias = ~head & ~later
        rows = [(0, name, 1, b"", place[later].astype("<i8").tobytes(), every.astype("<u4").tobytes(), b""),
                (0, name, 2, b"", place[alias].astype("<i8").tobytes(), place[lead[alias]].astype("<i8").tobytes(), b""), (0, name, 3, b"", copies, b"", b"")]
        own, place, count, gram = own[head], place[head], count[head], gram[head]
        part = (gram & _U(parts - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        own, place, count, part = own[order], place[order], count[order], part[order]
        at = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            a, b = int(at[p]), int(at[p + 1])
            if b > a:
                texts = b"".join(data[x:x + n + LENGTH - 1].tobytes() for x, n in zip(place[a:b].tolist(), count[a:b].tolist()))
                rows.append((p, name, 0, own[a:b].astype("<i8").tobytes(), place[a:b].astype("<i8").tobytes(), count[a:b].astype("u1").tobytes(), texts))
        spread = int.from_bytes(hashlib.sha1(name.encode()).digest()[:4], "big") % parts
        rows[:3] = [(spread, *r[1:]) for r in rows[:3]]
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["part", "block", "kind", "owners", "places", "counts", "texts"])

    def factors(table: pa.Table) -> pa.Table:
        begin("suffix_dedup")
        trim()
        rows = table.select(["block", "kind", "owners", "places", "counts", "texts"]).to_pylist()
        out = [(r["block"], r["kind"], r["places"], r["counts"]) for r in rows if r["kind"]]
        rows = [r for r in rows if not r["kind"]]
        if rows:
            owner = np.concatenate([np.frombuffer(r["owners"], "<i8") for r in rows])
            count = np.concatenate([np.frombuffer(r["counts"], "u1") for r in rows]).astype(np.int64)
            size = count + LENGTH - 1
            text = np.frombuffer(b"".join(r["texts"] for r in rows), np.uint8)
            head, first = np.cumsum(size) - size, np.cumsum(count) - count
            place = np.repeat(head - first, count) + np.arange(int(count.sum()))
            found = previous_factors(text, place, np.repeat(owner, count)).astype(np.uint64)
            bit = np.arange(len(found)) - np.repeat(first, count)
            mask = np.bitwise_or.reduceat(found << bit.astype(np.uint64), first)
            at = 0
            for r in rows:
                n = len(r["counts"])
                hit = np.flatnonzero(mask[at:at + n])
                if len(hit):
                    out.append((r["block"], 1, np.frombuffer(r["places"], "<i8")[hit].tobytes(), mask[at:at + n][hit].astype("<u4").tobytes()))
                at += n
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["block", "kind", "places", "masks"])

    def remove(table: pa.Table) -> pa.Table:
        begin("suffix_dedup")
        trim()
        name = table.column("block")[0].as_py()
        block = load_block(root, name)
        data, bounds = text_bytes(block.column(text_at))
        rows = list(zip(table.column("kind").to_pylist(), table.column("places").to_pylist(), table.column("masks").to_pylist()))
        place = np.concatenate([np.empty(0, "<i8"), *[np.frombuffer(p, "<i8") for k, p, _ in rows if k == 1]])
        mask = np.concatenate([np.empty(0, "<u4"), *[np.frombuffer(m, "<u4") for k, _, m in rows if k == 1]])
        alias = [(np.frombuffer(p, "<i8"), np.frombuffer(m, "<i8")) for k, p, m in rows if k == 2 and p]
        if alias and len(place):
            copy, lead = (np.concatenate(x) for x in zip(*alias))
            order = np.argsort(place)
            hit = in_sorted(lead, place[order])
            place, mask = np.concatenate([place, copy[hit]]), np.concatenate([mask, mask[order][np.searchsorted(place[order], lead[hit])]])
        starts = np.concatenate([np.empty(0, np.int64), *[place[(mask >> b) & 1 == 1] + b for b in range(RUN)]]).astype(np.int64)
        copies = np.concatenate([np.empty(0, "<i8"), *[np.frombuffer(p, "<i8") for k, p, _ in rows if k == 3]]).astype(np.int64)
        first, end = np.concatenate([starts, bounds[copies]]), np.concatenate([starts + LENGTH, bounds[copies + 1]])
        change = np.bincount(first, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
        gone = np.cumsum(change)[:-1] > 0
        n = np.diff(bounds)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[bounds[1:]] - total[bounds[:-1]]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = bounds[:-1][n > 0]
        opens[edge] = gone[edge]
        total = np.concatenate([[0], np.cumsum(opens)])
        spans = total[bounds[1:]] - total[bounds[:-1]]
        if whole:
            first = (data & 0xC0) != 0x80
            first[edge] = True
            character = np.cumsum(first) - 1
            gone = (np.bincount(character, gone) > 0)[character]
        raw, kept = data.tobytes(), []
        for a, b, r in zip(bounds[:-1].tolist(), bounds[1:].tolist(), removed.tolist()):
            kept.append(raw[a:b] if not r else data[a:b][~gone[a:b]].tobytes())
        return pa.table([*block.columns[:text_at], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=[*[f"c{i}" for i in range(text_at)], "n_bytes", "n_removed", "n_spans", "kept"])

    stored = scratch.table(inner.mapInArrow(store, "block string, pos array<long>, ids array<long>, digests array<binary>"), "stored")  # blocks are written once, whatever is done with the result
    texts = stored.select("block", F.explode(F.arrays_zip("pos", "ids", "digests")).alias("x")).select("block", "x.pos", F.col("x.ids").alias("id"), F.col("x.digests").alias("digest"))
    several = texts.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    several = several.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = texts.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(several, ["digest", "salt"]).where("id > first")
    copies = copies.groupBy("block").agg(F.collect_list("pos").alias("copies"))  # no more than a block's documents
    names = scratch.table(stored.select("block").join(copies, "block", "left"), "names")
    step = names.repartition(max(1, min(names.count(), 100_000)), "block").mapInArrow(grams, "part int, block string, keys binary, copies binary")
    step = step.groupBy("part").applyInArrow(shared, "block string, keys binary, hot binary, copies binary")
    step = scratch.table(step, "shared")
    scratch.release()
    step = step.groupBy("block").applyInArrow(cut, "part int, block string, kind int, owners binary, places binary, counts binary, texts binary")
    step = step.groupBy("part").applyInArrow(factors, "block string, kind int, places binary, masks binary")
    step = scratch.table(step, "factors")
    scratch.drop("shared")
    scratch.release()
    step = step.groupBy("block").applyInArrow(remove, ", ".join(f"c{i} {fields[c]}" for i, c in enumerate(columns)) + ", n_bytes long, n_removed long, n_spans long, kept binary")
    return step.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "n_bytes", "n_removed", "n_spans", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings of earlier ones."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
