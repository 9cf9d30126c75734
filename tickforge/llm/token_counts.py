"""Token counts by a deterministic finite-state transducer of pre-tokens and a memo of merges.

The transducer reads classes of
characters and marks where the pre-tokens (contractions, letters, single digits, other signs) start; one of
its states waits for what follows an apostrophe, so its output may fall one character back. A stream is cut in
chunks, each chunk gives a map from every start state to an end state, the maps compose through a parallel
prefix scan, and a second pass with the known start states gives the output. Token
counts are not on its transitions: the merges of all new pre-tokens of a batch run side by
side on a matrix of symbols, lowest rank first, and the counts are kept under a 64-bit hash of the pre-token. A
second hash of 62 bits, modulo a prime, is compared before a count is used.

Character classes are asked of the tokenizers library once per character and worker, and texts that aren't ASCII
are normalized by it, as its Unicode tables are newer than Python's; everything else is compiled from the
vocabulary file.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .blocks import PrimePrints
from .worker import begin, keeps

CHUNK = 64
#: Characters that are processed together, and merged words longer than this many bytes, which take a heap.
STREAM_CHARS, MATRIX_BYTES = 1_000_000, 64
TABLE_BITS = 21

#: Classes of characters; the letters that contractions are made of have classes of their own.
SPACE, DIGIT, OTHER, APOSTROPHE, SINGLE, R, V, L, E, LETTER = range(10)
#: States: nothing open, letters, other signs, an apostrophe, and an apostrophe with r, v or l.
OPEN, WORD, SIGNS, MAYBE, MAYBE_R, MAYBE_V, MAYBE_L = range(7)
STARTS, STARTED_BEFORE = 1, 2


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and output[class, state]."""
    to, out = np.zeros((10, 7), np.uint8), np.zeros((10, 7), np.uint8)
    letters = (SINGLE, R, V, L, E, LETTER)
    for c in range(10):
        fresh = {SPACE: (OPEN, 0), DIGIT: (OPEN, STARTS), OTHER: (SIGNS, STARTS), APOSTROPHE: (MAYBE, STARTS)}.get(c, (WORD, STARTS))
        in_word = (WORD, 0) if c in letters else fresh
        for s in range(7):
            if s == OPEN:
                to[c, s], out[c, s] = fresh
            elif s == WORD:
                to[c, s], out[c, s] = in_word
            elif s == SIGNS:
                to[c, s], out[c, s] = (SIGNS, 0) if c in (OTHER, APOSTROPHE) else fresh
            elif s == MAYBE:
                wait = {SINGLE: OPEN, R: MAYBE_R, V: MAYBE_V, L: MAYBE_L, OTHER: SIGNS, APOSTROPHE: SIGNS}
                to[c, s], out[c, s] = (wait[c], 0) if c in wait else fresh
            elif c == {MAYBE_R: E, MAYBE_V: E, MAYBE_L: L}[s]:
                to[c, s], out[c, s] = OPEN, 0
            else:  # the apostrophe stood alone; its letter opened a word
                to[c, s], out[c, s] = in_word[0], in_word[1] | STARTED_BEFORE
    return to, out


def run_transducer(classes: np.ndarray) -> np.ndarray:
    """Output for each character of a stream that starts in state OPEN."""
    to, out = _transitions()
    flat_to, flat_out = to.ravel(), out.ravel()
    n = len(classes)
    m = -(-n // CHUNK)
    padded = np.zeros(m * CHUNK, np.uint8)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(m, CHUNK).T) * np.uint8(7)
    maps = np.repeat(np.arange(7, dtype=np.uint8)[None, :], m, 0)
    for c in columns:
        maps = flat_to.take(maps + c[:, None])
    step = 1
    while step < m:  # maps[i] becomes the composition of the maps of all chunks up to i
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.concatenate([[OPEN], maps[:-1, OPEN]]).astype(np.uint8)
    found = np.empty((CHUNK, m), np.uint8)
    for k, c in enumerate(columns):
        at = state + c
        found[k] = flat_out.take(at)
        state = flat_to.take(at)
    return found.T.reshape(-1)[:n]


class CountTable:
    """64-bit hash, with a second one to compare -> small count; open addressing, emptied when half full."""

    def __init__(self, bits: int = TABLE_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)
        self.checks = np.zeros(1 << bits, np.uint64)
        self.used = 0

    def get(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Counts; -1 where there is none, or one of another check."""
        slot = (keys & self.mask).astype(np.intp)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & int(self.mask)
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (held != 0)]
        out[self.checks[slot] != checks] = -1
        return out

    def put(self, keys: np.ndarray, checks: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys; one that is held with another check is replaced."""
        if self.used + len(keys) > len(self.keys) // 2:
            self.keys[:] = 0
            self.used = 0
            if len(keys) > len(self.keys) // 2:
                return
        self.used += len(keys)
        slot = (keys & self.mask).astype(np.intp)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            self.checks[slot[left[won]]] = checks[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & int(self.mask)


class TokenCounter:
    """Counts of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or spec["model"]["end_of_word_suffix"] != "</w>" or spec["model"]["ignore_merges"]:
            raise ValueError("another kind of tokenizer than is compiled here")
        library = Tokenizer.from_file(path)
        self.pre, self.normalizer = library.pre_tokenizer, library.normalizer
        self.special = [x["content"] for x in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        shown = self._byte_characters()
        self.plain = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[shown[b] + "</w>"] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pair = np.array([vocab[a] << 17 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs = pair[order]
        self.ranks = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = dict(zip(pair.tolist(), range(len(pair))))
        self.classes = np.full(0x110000, 255, np.uint8)
        for c, k in {"'": APOSTROPHE, "r": R, "v": V, "l": L, "e": E} .items():
            self.classes[ord(c)] = k
        for c in "stmd":
            self.classes[ord(c)] = SINGLE
        self.table = CountTable()
        self.base, self.prints = 0x9E3779B97F4A7C15, PrimePrints()
        self._powers(1 << 16)

    @staticmethod
    def _byte_characters() -> list[str]:
        """The printable character that stands for each byte: printable Latin-1 stand for themselves, the others follow from U+0100."""
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        more = iter(range(256, 512))
        return [chr(b) if b in own else chr(next(more)) for b in range(256)]

    def _powers(self, n: int) -> None:
        self.powers = [np.full(n, b, np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64))]
        for p in self.powers:
            p[0] = 1
            np.cumprod(p, out=p)

    def classify(self, points: np.ndarray) -> np.ndarray:
        out = self.classes[points]
        if (out == 255).any():
            for p in np.unique(points[out == 255]).tolist():
                c = chr(p)
                spans = [b for _, b in self.pre.pre_tokenize_str("a" + c)]
                if spans[-1] == (0, 2):
                    kind = LETTER
                elif len(spans) == 1:
                    kind = SPACE
                else:
                    kind = DIGIT if len(self.pre.pre_tokenize_str(c + c)) == 2 else OTHER
                self.classes[p] = kind
            out = self.classes[points]
        return out

    def normal(self, text: str) -> str:
        """NFC, and lower case character by character; other than ASCII by the library, in parts cut before spaces, which nothing composes with."""
        if text.isascii():
            return text.lower()
        out, at = [], 0
        while at < len(text):
            end = text.find(" ", at + STREAM_CHARS) if len(text) - at > STREAM_CHARS else -1
            end = len(text) if end < 0 else end
            out.append(self.normalizer.normalize_str(text[at:end]))
            at = end
        return "".join(out)

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        out = np.zeros(len(words), np.int32)
        size = np.array([len(w) for w in words])
        for i in np.flatnonzero(size > MATRIX_BYTES).tolist():
            out[i] = self._merge_long(words[i])
        order = np.flatnonzero(size <= MATRIX_BYTES)
        order = order[np.argsort(size[order], kind="stable")]
        for part in np.array_split(order, max(1, len(order) // 4000)):
            if len(part):
                out[part] = self._merge_matrix([words[i] for i in part.tolist()], size[part])
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        none = np.int32(1 << 30)
        key = (a << 17) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((b >= 0) & (self.pairs[at] == key), self.ranks[at], none)

    def _merge_matrix(self, words: list[bytes], size: np.ndarray) -> np.ndarray:
        m, width = len(words), int(size.max())
        if width == 1:
            return np.ones(m, np.int32)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(m, width)
        ids = self.plain[raw]
        ids[np.arange(m), size - 1] = self.last[raw[np.arange(m), size - 1]]
        ids[np.arange(width)[None, :] >= size[:, None]] = -1
        none = 1 << 30
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        left, rows = size.astype(np.int32), np.arange(m)
        while True:
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            on = best < none
            if not on.all():
                keep = np.flatnonzero(on)
                if not len(keep):
                    return left
                ids, rank, rows, at, best = ids[keep], rank[keep], rows[keep], at[keep], best[keep]
            k = len(rows)
            r = np.arange(k)
            column = np.arange(ids.shape[1])[None, :]
            shifted = np.concatenate([ids[:, 1:], np.full((k, 1), -1)], 1)
            ids = np.where(column > at[:, None], shifted, ids)
            ids[r, at] = self.merged[best]
            shifted = np.concatenate([rank[:, 1:], np.full((k, 1), none, np.int32)], 1)
            rank = np.where(column[:, :-1] > at[:, None], shifted, rank)
            w = ids.shape[1]
            inside = at < w - 1
            rank[r[inside], at[inside]] = self._rank(ids[r[inside], at[inside]], ids[r[inside], at[inside] + 1])
            before = at > 0
            rank[r[before], at[before] - 1] = self._rank(ids[r[before], at[before] - 1], ids[r[before], at[before]])
            left[rows] -= 1
            if w > 2 and (ids[:, -1] < 0).all():
                ids, rank = ids[:, :-1], rank[:, :-1]

    def _merge_long(self, word: bytes) -> int:
        import heapq

        sym = [int(self.plain[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        n, size, get = len(sym), [1] * len(sym), self.rank_of.get
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(k, i, sym[i], sym[i + 1]) for i in range(n - 1) if (k := get(sym[i] << 17 | sym[i + 1])) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = nxt[i] if size[i] else n
            if not size[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], size[j], nxt[i] = int(self.merged[k]), 0, nxt[j]
            count -= 1
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                if x >= 0 and nxt[x] < n and (q := get(sym[x] << 17 | sym[nxt[x]])) is not None:
                    heapq.heappush(heap, (q, x, sym[x], sym[nxt[x]]))
        return count

    def stream(self, text: str, starts: np.ndarray) -> np.ndarray:
        """Tokens between one start and the next of a normalized stream; a space stands before each start."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if n == 0:
            return np.zeros(len(starts), np.int64)
        if n >= len(self.powers[0]):
            self._powers(2 * n)
        classes = self.classify(points)
        found = run_transducer(classes)
        first = (found & STARTS).astype(bool)
        first[:-1] |= (found[1:] & STARTED_BEFORE).astype(bool)
        breaks = np.flatnonzero(first | (classes == SPACE))
        is_first = first[breaks]
        ends = np.append(breaks[1:], n)[is_first]
        begins = breaks[is_first]
        values, (up, down) = points.astype(np.uint64) + np.uint64(1), self.powers
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=sums[1:])
        h = (sums[ends] - sums[begins]) * down[begins]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= (h >> np.uint64(29)) ^ (ends - begins).astype(np.uint64)
        h[h == 0] = 1
        check = self.prints(values, begins, ends)
        counts = self.table.get(h, check)
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            keys, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[where]
            words = lambda at: [text[b:e].encode() for b, e in zip(begins[at].tolist(), ends[at].tolist())]
            new = self.merge_counts(words(at))
            counts[missing] = new[back]
            other = missing[check[missing] != check[at][back]]
            if len(other):
                counts[other] = self.merge_counts(words(other))
            self.table.put(keys, check[at], new)
        doc = np.searchsorted(starts, begins, "right") - 1
        return np.bincount(doc, counts, len(starts)).astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        parts, owner, starts, size = [], [], [], 0

        def flush():
            nonlocal parts, owner, starts, size
            if parts:
                np.add.at(total, np.array(owner), self.stream(" ".join(parts), np.array(starts)))
            parts, owner, starts, size = [], [], [], 0

        for k, text in enumerate(texts):
            pieces = [text]
            for s in self.special:
                if s in text:
                    pieces = [y for x in pieces for y in x.split(s)]
            total[k] += len(pieces) - 1
            for piece in pieces:
                piece = self.normal(piece)
                while piece:
                    cut = len(piece)
                    if cut > STREAM_CHARS and (cut := piece.find(" ", STREAM_CHARS)) < 0:
                        cut = len(piece)
                    parts.append(piece[:cut])
                    owner.append(k)
                    starts.append(size)
                    size += cut + 1
                    piece = piece[cut:]
                    if size >= STREAM_CHARS:
                        flush()
        flush()
        return total


_COUNTERS: dict[str, TokenCounter] = {}
keeps("token_counts", _COUNTERS.clear)


def counter(path: str | None = None) -> TokenCounter:
    """The counter of a vocabulary file, once for each worker."""
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, limit: int = 2048, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_bytes, n_tokens and over_limit for every row of docs.

    A null text counts as empty: 0 bytes, 0 tokens. Strings of special tokens inside a text count as one token
    each. Texts of any length are counted whole, in streams cut at spaces. Rows with null or repeated ids are
    kept; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        begin("token_counts")
        c = counter(path)
        for batch in batches:
            texts = batch.column(1)
            bytes_, tokens = [], []
            for at in range(0, len(texts), 512):
                part = [t or "" for t in texts.slice(at, 512).to_pylist()]
                bytes_ += [len(t.encode()) for t in part]
                tokens.append(c.count(part))
            if bytes_:
                n = np.concatenate(tokens)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bytes_, pa.int64()), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
