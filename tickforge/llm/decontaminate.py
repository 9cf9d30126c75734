"""Benchmark decontamination: documents that hold a passage within a small edit distance of a benchmark item.

Texts and items are normalized (A-Z lower-cased, runs of ASCII signs and white space to one space). Windows of
an item's size start where enough parts of that item agree on a place. Windows and items are mapped by random
CGK walks, which turn edit distance into Hamming distance: a walk copies the character under its pointer and
moves on or stays by a random bit drawn for the step and the character, so two strings that differ by an edit
fall into step again. Tables of sampled coordinates of the walks are the buckets of a locality-sensitive hash,
in a fixed number that the tests hold to TARGET_RECALL at MAX_EDIT; a window that meets an item of its size in a bucket is verified by an
exact edit distance, which also finds where the passage starts and ends.

The filter of parts loses nothing: an item of n bytes is cut into n // PART parts, of which k = MAX_EDIT * n edits
spoil k at most, wherever they are. The others are in the passage, and their places in the text less those in the
item differ by k at most, so they fall into two neighbours of cells of k + 1 places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import text_bytes
from .worker import begin, bound_batches, trim

#: Edits for each character of an item; bytes of the least item that may have edits; bytes of a part, where as many leave a part whole.
MAX_EDIT, GRAM, PART = 0.15, 12, (5, 4)
#: Recall that the tests ask for at MAX_EDIT; walks, tables of each and coordinates of a table, which aren't derived from it.
TARGET_RECALL, WALKS, TABLES, SAMPLED = 0.99, 3, 32, 2
#: Bytes of items that are broadcast at once; larger benchmarks are handled in slices. Text bytes handled together.
SLICE_BYTES, CHUNK_BYTES = 8 << 20, 1 << 17
#: Bytes of items whose parts are looked up at once, and hits or cells that are; windows of a passage.
PARTS_BYTES, MOST_CELLS, STARTS = 1 << 20, 1 << 23, 9
SEED = 11
NONE, SEVERAL = -1, -2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 32


def normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalized bytes, and the place of each in data."""
    folded = _FOLD[data]
    space = folded == 32
    keep = np.flatnonzero(~(space & np.append(True, space[:-1])))
    return folded[keep], keep


def edit_search(pattern: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """Least edit distance (at most `most`) of pattern to a part of text, and where that part starts and ends."""
    def ends(p: bytes, t: bytes) -> tuple[int, int]:
        m = len(p)
        masks: dict[int, int] = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        full, top = (1 << m) - 1, 1 << (m - 1)
        pv, mv, score, best, at = full, 0, m, m, 0
        for j, c in enumerate(t):
            eq = masks.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if score < best:
                best, at = score, j + 1
        return best, at

    best, end = ends(pattern, text)
    if best > most:
        return None
    again, back = ends(pattern[::-1], text[:end][::-1])
    return best, end - back, end


def _fours(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def may_be_near(pattern: bytes, text: bytes, most: int) -> bool:
    """False only if no part of text is within `most` edits of pattern: an edit spoils four of its 4-grams at most."""
    least = len(pattern) - 3 - 4 * most
    return least <= 0 or len(text) > 3 and int(np.isin(_fours(pattern), _fours(text)).sum()) >= least


def _codes(data: np.ndarray, size: int) -> np.ndarray:
    """The size bytes (8 at most) at each place as a number."""
    n = max(0, len(data) - size + 1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((n,), "<u8", padded.data, strides=(1,)) & np.uint64((1 << 8 * size) - 1)


class Parts:
    """Disjoint parts of items of like size."""

    def __init__(self, part: int, items: list[bytes]):
        self.part, self.size = part, np.array([len(d) for d in items])
        edits = (MAX_EDIT * self.size).astype(int)
        self.longest, self.cell, self.need = int(self.size.max()), edits + 1, self.size // part - edits
        codes = np.concatenate([_codes(np.frombuffer(d, np.uint8), part)[::part] for d in items])
        owner = np.repeat(np.arange(len(items)), self.size // part)
        rank = np.arange(len(codes)) - np.repeat(np.cumsum(self.size // part) - self.size // part, self.size // part)
        order = np.argsort(codes, kind="stable")
        self.codes, first, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.first, self.owner, self.rank = first.astype(np.int32), owner[order].astype(np.int32), rank[order].astype(np.int32)
        # slots of a hash of codes: the code's place, NONE or SEVERAL
        self.shift = np.uint64(64 - min(24, max(16, len(self.codes).bit_length() + 6)))
        slot = self.slot(self.codes)
        self.table = np.full(1 << (64 - int(self.shift)), NONE, np.int32)
        self.table[slot] = np.arange(len(self.codes))
        self.table[slot[self.table[slot] != np.arange(len(self.codes))]] = SEVERAL
        # an item may start before the text does
        self.back, self.width = (self.size[self.owner] - self.rank * part).astype(np.int32), self.cell[self.owner].astype(np.int32)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int32)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the codes that items have, and which codes they are."""
        entry = self.table[self.slot(codes)]
        hit = np.flatnonzero(entry != NONE)
        entry, mine = entry[hit], codes[hit]
        several = np.flatnonzero(entry == SEVERAL)
        entry[several] = np.minimum(np.searchsorted(self.codes, mine[several]), len(self.codes) - 1)
        good = self.codes[entry] == mine
        return hit[good].astype(np.int32), entry[good]

    def find(self, text: np.ndarray, codes: np.ndarray | None = None) -> np.ndarray:
        """Distinct (start, size, low, high) of windows where enough parts of an item agree; its passages there are between low and high."""
        none = np.empty((0, 4), np.int64)
        hit, entry = self.hits(_codes(text, self.part) if codes is None else codes)
        n = self.count[entry]
        cells = (len(text) + self.size) // self.cell + 3
        if max(int(n.sum()), int(cells.sum())) > MOST_CELLS and len(text) > 4 * self.longest:
            half, lap = len(text) // 2, int(self.longest * (1 + MAX_EDIT)) + 1
            return np.unique(np.concatenate([self.find(text[:half + lap]), self.find(text[half:]) + [half, 0, half, half]]), axis=0)
        if not len(hit):
            return none
        base = np.cumsum(cells) - cells
        entry = np.repeat((self.first[entry] - np.cumsum(n) + n).astype(np.int32), n) + np.arange(n.sum(), dtype=np.int32)
        place = np.repeat(hit, n) + self.back[entry]
        key = place // self.width[entry] + base.astype(np.int32)[self.owner][entry]
        held = np.bincount(key, minlength=int(cells.sum()) + 1)
        both = held[:-1] + held[1:]
        pair = np.flatnonzero(both >= self.need.min())
        item = np.searchsorted(base, pair, "right") - 1
        pair, item = (x[both[pair] >= self.need[item]] for x in (pair, item))
        out = [none]
        for a in range(0, len(pair), 1 << 14):
            out.append(self.agreeing(pair[a:a + (1 << 14)], item[a:a + (1 << 14)], base, key, place, entry, len(held)))
        return np.unique(np.concatenate(out), axis=0)

    def agreeing(self, pair: np.ndarray, item: np.ndarray, base: np.ndarray, key: np.ndarray, place: np.ndarray, entry: np.ndarray, cells: int) -> np.ndarray:
        """Windows of the pairs of cells with hits of enough different parts."""
        number = np.full(cells + 1, -1, np.int32)
        number[pair] = np.arange(len(pair))
        near = number[:-1] >= 0
        near[1:] |= near[:-1].copy()
        hit = np.flatnonzero(near[key])
        seen = np.zeros((len(pair) + 1, int((self.size[item] // self.part).max(initial=1))), bool)
        of = [number[key[hit]], number[key[hit] - 1]]
        rank = np.minimum(self.rank[entry[hit]], seen.shape[1] - 1)
        for x in of:
            seen[x, rank] = True
        good = np.append(seen[:-1].sum(1) >= self.need[item], False)
        of, hit = np.concatenate(of), np.append(hit, hit)
        of, hit = of[good[of]], hit[good[of]]
        order = np.lexsort((place[hit], of))
        of, start = of[order], place[hit][order].astype(np.int64)
        head = np.flatnonzero(np.diff(of, prepend=-1))
        last = np.diff(np.append(head, len(of))) - 1
        at = np.unique(head[:, None] + last[:, None] * np.arange(STARTS) // (STARTS - 1))
        own = item[of[at]]
        size, edge = self.size[own], 2 * self.cell[own]
        middle = (pair[of[at]] - base[own] + 1) * self.cell[own] - size
        return np.stack([start[at] - size, size, middle - edge, middle + size + edge], 1)


class Benchmark:
    """Items, their parts and their buckets."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = []
        for item, text in sorted(items):
            data = normal(np.frombuffer((text or "").encode(), np.uint8))[0].tobytes().strip(b" ")
            if data:
                self.items.append((item, data))
        self.size = np.array([len(d) for _, d in self.items], np.int64)
        self.short = [k for k, n in enumerate(self.size.tolist()) if n < GRAM]
        groups: dict[tuple[int, int, int], list[bytes]] = {}
        held: dict[tuple[int, int], int] = {}
        for _, d in self.items:
            if len(d) >= GRAM:
                kind = next(p for p in PART if len(d) // p > int(MAX_EDIT * len(d))), len(d).bit_length() // 3
                held[kind] = held.get(kind, 0) + len(d)
                groups.setdefault((*kind, held[kind] // PARTS_BYTES), []).append(d)
        self.parts = [Parts(part, own) for (part, *_), own in sorted(groups.items())]
        self.bits_of: dict[int, list[np.ndarray]] = {}
        self.buckets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.by_size: dict[int, list[int]] = {}
        for k, n in enumerate(self.size.tolist()):
            self.by_size.setdefault(n, []).append(k)

    def keys(self, strings: list[bytes]) -> np.ndarray:
        """Bucket of each string in each table; strings of one size have the same tables."""
        size = np.array([len(x) for x in strings])
        longest = int(size.max())
        padded = np.frombuffer(b"".join(x.ljust(longest + 1, b"\0") for x in strings), np.uint8).reshape(len(strings), longest + 1)
        flat, base = padded.ravel(), np.arange(len(strings)) * (longest + 1)
        out = np.empty((len(strings), WALKS * TABLES), np.uint64)
        for walk in range(WALKS):
            moves = self.moves(walk, longest)
            path = np.empty((2 * longest, len(strings)), np.uint8)
            at, end = base.copy(), base + size
            for step in range(2 * longest):
                c = flat[at]
                path[step] = c
                at = np.minimum(at + moves[step][c], end)
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                # later steps of a walk mostly lie behind the string's end
                sampled = np.random.default_rng([SEED, walk, n]).integers(0, 2 * n, (TABLES, SAMPLED))
                key = np.full((TABLES, len(rows)), walk, np.uint64)
                for j in range(SAMPLED):
                    key = (key * np.uint64(257) + path[sampled[:, j]][:, rows]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= np.arange(TABLES, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
                out[rows, walk * TABLES:(walk + 1) * TABLES] = key.T
        return out

    def moves(self, walk: int, size: int) -> np.ndarray:
        """Random bits of a walk for each step and character, 1 KB of steps at a time so that they don't depend on the size."""
        known = self.bits_of.setdefault(walk, [])
        while len(known) * 1024 < 2 * size:
            known.append(np.random.default_rng([SEED, walk, 1 << 40 | len(known)]).integers(0, 2, (1024, 256), dtype=np.uint8))
        return np.concatenate(known) if len(known) > 1 else known[0]

    def bucket(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted bucket keys of the items of a size, and the items."""
        if size not in self.buckets:
            own = self.by_size[size]
            keys = self.keys([self.items[k][1] for k in own])
            order = np.argsort(keys.ravel(), kind="stable")
            self.buckets[size] = keys.ravel()[order], np.repeat(own, keys.shape[1])[order]
        return self.buckets[size]

    def windows(self, text: np.ndarray) -> np.ndarray:
        """Distinct (start, size, low, high) of item-sized windows where enough parts of an item agree."""
        codes = {part: _codes(text, part) for part in {p.part for p in self.parts}}
        return np.unique(np.concatenate([np.empty((0, 4), np.int64), *[p.find(text, codes[p.part]) for p in self.parts]]), axis=0)

    def candidates(self, text: np.ndarray, bounds: np.ndarray):
        """(document, string, context, place of the context in its document) of each window; documents lie between bounds."""
        for at, size, a, b in self.windows(text).tolist():
            # an item's parts may agree across the end of a document
            for d in range(max(0, int(np.searchsorted(bounds, a, "right")) - 1), min(len(bounds) - 1, int(np.searchsorted(bounds, b)))):
                low, high = int(bounds[d]), int(bounds[d + 1])
                context = text[max(a, low):min(b, high)].tobytes()
                if len(context) >= size - int(MAX_EDIT * size):
                    string = text[min(max(at, low), high):max(min(at + size, high), low)].tobytes()
                    yield d, string.rjust(size if at < low else 0, b"\0").ljust(size, b"\0"), context, max(a, low) - low

    def verified(self, found: list[tuple[int, bytes, bytes, int]]):
        """(document, item, start, end, distance) of the candidates that meet an item in a bucket and are near it."""
        pairs: dict[tuple[int, int, int, int], bytes] = {}
        found = sorted(found, key=lambda x: len(x[1]))
        for at in range(0, len(found), 1000):
            part = found[at:at + 1000]
            mine = self.keys([x[1] for x in part])
            for r, (d, string, context, place) in enumerate(part):
                keys, owner = self.bucket(len(string))
                a, b = np.searchsorted(keys, mine[r]), np.searchsorted(keys, mine[r], "right")
                for t in np.flatnonzero(b > a).tolist():
                    for k in owner[a[t]:b[t]].tolist():
                        pairs[d, k, place, len(context)] = context
        for (d, k, place, _), context in sorted(pairs.items()):
            item, pattern = self.items[k]
            most = int(MAX_EDIT * len(pattern))
            if may_be_near(pattern, context, most) and (m := edit_search(pattern, context, most)) is not None:
                yield d, item, place + m[1], place + m[2], m[0]

    def exact(self, text: np.ndarray, bounds: np.ndarray):
        """Items too short for edits: whole words only."""
        raw = b" " + text.tobytes() if self.short else b""
        for k in self.short:
            item, pattern = self.items[k]
            at = raw.find(b" " + pattern + b" ")
            while at >= 0:
                d = int(np.searchsorted(bounds, at, "right") - 1)
                yield d, item, at - int(bounds[d]), at - int(bounds[d]) + len(pattern), 0
                at = raw.find(b" " + pattern + b" ", at + 1)


def contaminated(bench: Benchmark, texts: pa.Array):
    """(row, item, start, end, distance, size) for each passage; places are bytes of the row's text."""
    candidates, found = [], []
    for a, b in _pieces(texts):
        data, at = text_bytes(texts.slice(a, b - a))
        parts, bounds = [], [0]
        for d in range(b - a):
            parts += [normal(data[at[d]:at[d + 1]])[0], np.array([32], np.uint8)]
            bounds.append(bounds[-1] + len(parts[-2]) + 1)
        text, bounds = np.concatenate(parts), np.array(bounds)
        candidates += [(a + d, *x) for d, *x in bench.candidates(text, bounds)]
        found += [(a + d, *x) for d, *x in bench.exact(text, bounds)]
    spans: dict[tuple[int, int], set] = {}
    for d, item, x, y, distance in [*found, *bench.verified(candidates)]:
        spans.setdefault((d, item), set()).add((distance, x, y))
    for (d, item), own in sorted(spans.items()):
        data = np.frombuffer((texts[d].as_py() or "").encode(), np.uint8)
        place = np.append(normal(data)[1], len(data))
        taken: list[tuple[int, int]] = []
        for distance, x, y in sorted(own):
            if all(y <= p or x >= q for p, q in taken):
                taken.append((x, y))
                yield d, item, int(place[min(x, len(place) - 1)]), min(len(data), int(place[min(y - 1, len(place) - 1)]) + 1), distance, y - x


def _pieces(texts: pa.Array):
    a, held = 0, 0
    for k, n in enumerate(len(t.as_py() or "") if t.is_valid else 0 for t in texts):
        held += n
        if held >= CHUNK_BYTES:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def benchmark_slices(items: DataFrame, *, item_col: str = "item_id", text_col: str = "text"):
    """Benchmarks of about SLICE_BYTES of items, one after the other; null ids and texts without a letter or digit have no part."""
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    slices = total // SLICE_BYTES + 1
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k)
        yield Benchmark([(r.i, r.t) for r in part.collect()])


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Columns id_col, item_col, start, end (bytes of the text), distance and similarity for each passage of an item.

    distance is at most MAX_EDIT of the item's normalized length. Items of one normalized text are all reported;
    of overlapping passages of an item the nearest. Items under GRAM characters match exactly, as whole words.
    Null and empty texts hold nothing; rows with null or repeated ids are searched like others; no items or an
    empty table give no rows; other columns are ignored. Texts of any length are searched whole. Where both id
    columns have one name, the item's is given out with item_ before it.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    item_name = item_col if item_col != id_col else f"item_{item_col}"
    out = None
    for bench in benchmark_slices(items, item_col=item_col, text_col=item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches, shared=shared):
            begin("decontaminate")
            for batch in batches:
                trim()
                found = list(contaminated(shared.value, batch.column(1)))
                if found:
                    row, item, start, end, distance, size = (list(x) for x in zip(*found))
                    like = [1 - d / max(n, 1) for d, n in zip(distance, size)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(distance, pa.int32()), pa.array(like)], names=[id_col, item_name, "start", "end", "distance", "similarity"])

        part = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, `{item_name}` long, start long, end long, distance int, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no passage of an item.

    Null and empty texts hold nothing and stay; rows with null or repeated ids are judged like others; no items
    leave all rows, an empty table stays empty, and names of columns don't matter.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for bench in benchmark_slices(items, item_col=item_col, text_col=item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches, shared=shared):
            begin("decontaminate")
            for batch in batches:
                trim()
                bad = {row for row, *_ in contaminated(shared.value, batch.column(at))}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)])) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of benchmark items in all documents."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
