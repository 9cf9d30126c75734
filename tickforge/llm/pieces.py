"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

A unit of text starts as single characters; an agenda ordered by score, then by place, holds the adjacent
symbol pairs whose union is a piece, and the best is merged until none is left. Characters without a piece
become byte pieces. Units are cut where no piece can span (before a space that follows another character, and
around characters that occur in no longer piece), so a memo of units gives the ids of whole texts.

The ids of a unit are decoded once, and a text decodes to the decoded units in a row: a unit begins and ends with
whole characters, so bytes of one never join those of the next. Every unit that is compiled, and the first whole
text of each ROWS texts of an Arrow batch, is compared with the sentencepiece library; where one differs, the library encodes and
decodes that batch and all later ones of the worker.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .worker import begin, bound_batches, keeps

SPACE = "▁"
#: Units kept in each of a worker's two memos; a full one becomes the older one, from which units in use return. Longer units than UNIT_CHARS are not kept.
MEMO_UNITS, UNIT_CHARS = 200_000, 48
#: Texts that are encoded, and checked, together.
ROWS = 1024
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at:at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + n]
            at += n


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, check: bool = True):
        import struct

        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in model if k == 1]
        norm = dict(next((_fields(v) for k, v in model if k == 3), ()))
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1):
            raise ValueError("only the identity normalizer with a dummy prefix and all white space kept is compiled")
        self.text = [p[1].decode().replace(SPACE, " ") for p in pieces]
        self.kind = [p.get(3, NORMAL) for p in pieces]
        score = [struct.unpack("<f", p.get(2, b"\0" * 4))[0] for p in pieces]
        if {USER_DEFINED, UNUSED} & set(self.kind):
            raise ValueError("user-defined and unused pieces are not compiled")
        self.ids = {t: i for i, t in enumerate(self.text) if self.kind[i] == NORMAL}
        self.score = {t: -score[i] for t, i in self.ids.items()}
        self.bytes = {int(self.text[i][1:-1], 16): i for i, k in enumerate(self.kind) if k == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i, k in enumerate(self.kind) if k != NORMAL}
        self.eos = next(i for i, t in enumerate(self.text) if t == "</s>")
        if any(re.search("[^ ] ", t) for t in self.ids):
            raise ValueError("a piece holds a space after another character")
        joined = {c for t in self.ids if len(t) > 1 for c in t}
        alone = "".join(c for c in "\n\r\t" if c not in joined)
        self.units = re.compile(f" *[^ {alone}]+|[{alone}]| +" if alone else " *[^ ]+| +").findall
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}  # of units that don't decode to themselves
        self.fresh: list[tuple[str, list[int]]] = []  # compiled, not yet compared with the library
        self.agrees = True
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def merge(self, unit: str) -> list[str]:
        """The symbols left when the agenda is empty. A symbol is where it starts and ends in the unit."""
        n, get = len(unit), self.score.get
        end, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(s, i, i + 2) for i in range(n - 1) if (s := get(unit[i:i + 2])) is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            _, i, e = pop(agenda)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue  # one of the two has been merged since
            end[i], end[j] = e, 0
            if e < n:
                left[e] = i
                s = get(unit[i:end[e]])
                if s is not None:
                    push(agenda, (s, i, end[e]))
            k = left[i]
            if k >= 0:
                s = get(unit[k:e])
                if s is not None:
                    push(agenda, (s, k, e))
        out, i = [], 0
        while i < n:
            out.append(unit[i:end[i]])
            i = end[i]
        return out

    def compile(self, unit: str) -> bytes:
        """Decimal ids of a unit, joined by a space."""
        symbols = self.merge(unit) if len(unit) > 1 else [unit]
        out = list(map(self.ids.get, symbols))
        if None in out:  # ids of symbols decode to the symbols, those of bytes need not
            out = [i for s, k in zip(symbols, out) for i in ([k] if k is not None else [self.bytes[b] for b in s.replace(" ", SPACE).encode()])]
            text = self.decode(out)
            if text != unit:
                self.decoded[unit] = text
        if self.library is not None and unit[0] == " " and len(unit) > 1:
            self.fresh.append((unit[1:], out))
            if len(self.fresh) >= 5000:
                self.check_units()
        return " ".join(map(str, out)).encode()

    def check_units(self) -> None:
        """Compare the units compiled since the last call with the library."""
        if self.fresh:
            want = self.library.encode([u for u, _ in self.fresh], num_threads=1)
            self.agrees &= all(ids == w for (_, ids), w in zip(self.fresh, want))
            self.fresh = []

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with the spaces of all pieces; invalid bytes as U+FFFD."""
        if not any(map(self.special.__contains__, ids)):
            return "".join(map(self.text.__getitem__, ids))
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode(errors="replace").replace(SPACE, " "))
                held.clear()
            if self.kind[i] == NORMAL:
                out.append(self.text[i])
            elif self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
        if held:
            out.append(held.decode(errors="replace").replace(SPACE, " "))
        return "".join(out)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Decimal ids of a text with the end id, joined by a space, and the text that they decode to."""
        if not text:
            return b"%d" % self.eos, ""
        text = " " + text.replace(SPACE, " ")  # the dummy prefix, which decoding takes off again
        memo = self.memo
        units = self.units(text)
        parts = list(map(memo.get, units))
        if None in parts:
            for k, p in enumerate(parts):
                if p is None:
                    u = units[k]
                    p = parts[k] = memo.get(u) or self.older.get(u) or self.compile(u)
                    if len(u) <= UNIT_CHARS:
                        if len(memo) >= MEMO_UNITS:
                            self.older, self.memo = memo, (memo := {})
                        memo[u] = p
        parts.append(b"%d" % self.eos)
        if self.decoded:
            units = [self.decoded.get(u, u) for u in units]
        return b" ".join(parts), "".join(units)[1:]

    def by_library(self, text: str) -> tuple[bytes, str]:
        """The same by the library."""
        ids = self.library.encode(text, add_eos=True)
        return b" ".join(b"%d" % i for i in ids), self.library.decode(ids)

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded texts of a batch, those of the library once the two have differed."""
        if self.agrees:
            out = [self.encode(t) for t in texts]
            self.check_units()
            self.agrees &= not texts or out[0] == self.by_library(texts[0])
            if self.agrees:
                return out
        return [self.by_library(t) for t in texts]


_CODECS: dict[str, PieceCodec] = {}
keeps("pieces", _CODECS.clear)


def codec(path: str) -> PieceCodec:
    """The codec of a model file, once for each worker."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_pieces(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Columns id_col, ids array<int> and decoded for every row of docs; with digests n_tokens, ids_sha256 and decoded_sha256 instead.

    ids end with the end id. A null text counts as empty: the end id alone, decoded to an empty text. Rows with
    null or repeated ids are kept as they are; an empty table gives no rows; other columns are ignored. A unit
    of any length is merged whole. The model's path is resolved on the executors, where the file must be.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches):
        begin("pieces")
        c = codec(path or model_path())
        for batch in batches:
            found, texts = [], batch.column(1)
            for at in range(0, len(texts), ROWS):
                for ids, decoded in c.encode_batch([t or "" for t in texts.slice(at, ROWS).to_pylist()]):
                    if digests:
                        found.append((ids.count(b" ") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        found.append((list(map(int, ids.split())), decoded))
            columns = [pa.array(x, t) for x, t in zip(zip(*found), [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()])] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[f.split("` ")[0].strip("`") if f[0] == "`" else f.split()[0] for f in schema.split(", ")])

    bound_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of all documents."""
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
