r"""Secrets in texts and in what is wrapped inside them: a worklist of decoded layers.

The text is the first layer. A layer is scanned for secrets, then unwrapped: its URL escapes (%41) and Unicode escapes
(\u0041, \u{41}, \U00000041, \x41, &#65;, &#x41;) all at once, which gives one layer with the rest of the text around them;
each run of base64 (either alphabet), at each of the four places where its groups of four may begin, as what was encoded
need not start the run; and gzip, zlib, bzip2, xz and Zstandard data in decoded bytes. New layers go to the worklist until none
comes out. A layer is known by its text and by the part of the document that it covers, so data that unwraps to itself ends there.

Each layer holds, for each of its characters, the first and the last place in the document that it comes from, so what is
found in any layer is told as a span of the document: of escapes and base64 to the character, of compressed data as a whole.

Every unwrapping but decompression makes a text shorter. Escapes that hide escapes are unwrapped PASSES times, each scanned, and
then to the end in one walk with a stack, as a text can hold half its length of levels.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .worker import begin

KINDS = ("assign", "access", "hex")
#: Shortest secrets of each kind: characters of the assigned value, of the access key, of the hexadecimal run.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Characters of which at least one secret can be made: `token=12345678`; and the base64 of it.
LEAST_LAYER, LEAST_BASE64 = 14, 19
#: Passes over nested escapes that are scanned one by one.
PASSES = 16
#: Bytes that may come out of the compressed data of one document; what is left of a larger one is counted as unopened.
MAX_INFLATED = 16 << 20

_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = re.compile(rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of 32 or more is found at the same place as the run of any length that is dropped if shorter.
_HEX = re.compile(r"[0-9a-f]{32,}")
_ESCAPE = re.compile(r"((?:%[0-9A-Fa-f]{2})+)|\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_BASE64},}}")
_PLAIN = str.maketrans("-_", "+/")
#: Text as it comes out of decoded bytes: no control characters, no bytes that are not UTF-8.
_READABLE = re.compile("[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ud800-\udfff]{%d,}" % LEAST_LAYER)
#: First bytes of gzip, zlib, bzip2, xz and Zstandard data; and the same where bytes that are not UTF-8 are surrogates.
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_MAGIC_TEXT = re.compile("\x1f\udc8b\x08|x[\x01^\udc9c\udcda]|BZh[1-9]1AY&SY|\udcfd7zXZ\x00|\\(\udcb5/\udcfd")
SPAN = "struct<kind: string, start: long, end: long, depth: int, layer: string>"


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the secrets in the text itself, leftmost and not overlapping in each kind."""
    out = [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A text, and for each character its first place and the place after its last one in the document; None: the document itself."""

    __slots__ = ("text", "first", "after", "depth", "name", "passes", "raw")

    def __init__(self, text, first=None, after=None, depth=0, name="text", passes=0, raw=False):
        self.text, self.first, self.after, self.depth, self.name, self.passes, self.raw = text, first, after, depth, name, passes, raw

    def cover(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.first is None else (int(self.first[a]), int(self.after[b - 1]))

    def places(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.arange(a, b), np.arange(a + 1, b + 1)) if self.first is None else (self.first[a:b], self.after[a:b])

    def key(self) -> tuple:
        return hashlib.sha1(self.text.encode("utf-8", "surrogatepass")).digest(), self.cover(0, 1), self.cover(len(self.text) - 1, len(self.text))


def _byte(b: int) -> str:
    return chr(b) if b < 128 else chr(0xDC00 + b)


def _code(value: int) -> str:
    return "\ufffd" if value > 0x10FFFF or 0xD800 <= value < 0xE000 else chr(value)


def unescaped(layer: Layer) -> Layer | None:
    """The layer without one level of escapes, the rest of its text as it is; None if it holds none."""
    parts, first, after, end = [], [], [], 0
    for m in _ESCAPE.finditer(layer.text):
        a, b = m.span()
        if a > end:
            parts.append(layer.text[end:a])
            f, n = layer.places(end, a)
            first.append(f)
            after.append(n)
        f, n = layer.places(a, b)
        if m[1]:
            new = bytes.fromhex(m[1].replace("%", "")).decode("utf-8", "surrogateescape")
            width = np.array([3 * (1 if "\udc80" <= c <= "\udcff" else len(c.encode())) for c in new])
            last = np.cumsum(width)
            first.append(f[last - width])
            after.append(n[last - 1])
        else:
            new = _byte(int(m[5], 16)) if m[5] else _code(int(m[7])) if m[7] else _code(int(m[2] or m[3] or m[4] or m[6], 16))
            first.append(f[:1])
            after.append(n[-1:])
        parts.append(new)
        end = b
    if not end:
        return None
    f, n = layer.places(end, len(layer.text))
    return Layer("".join([*parts, layer.text[end:]]), np.concatenate([*first, f]), np.concatenate([*after, n]), layer.depth + 1, layer.name + "/escapes", layer.passes + 1, True)


_TAILS = [(re.compile(r"%([0-9A-Fa-f]{2})\Z"), 3, _byte), (re.compile(r"\\x([0-9A-Fa-f]{2})\Z"), 4, _byte), (re.compile(r"\\u([0-9A-Fa-f]{4})\Z"), 6, _code), (re.compile(r"\\U([0-9A-Fa-f]{8})\Z"), 10, _code)]
_CLOSED = [(re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}\Z"), 16), (re.compile(r"&#[xX]([0-9A-Fa-f]{1,6});\Z"), 16), (re.compile(r"&#([0-9]{1,7});\Z"), 10)]


def settled(layer: Layer) -> Layer:
    """The layer without escapes of any level: each that is complete is replaced at once, which may complete the one around it."""
    f, n = layer.places(0, len(layer.text))
    out, first, after = [], [], []
    for c, a, b in zip(layer.text, f.tolist(), n.tolist()):
        out.append(c)
        first.append(a)
        after.append(b)
        while True:
            c, new, size = out[-1], None, 0
            if c in "};":
                tail = "".join(out[-12:])
                for form, base in _CLOSED:
                    if m := form.search(tail):
                        new, size = _code(int(m[1], base)), len(m[0])
                        break
            elif c in "0123456789abcdefABCDEF":
                tail = "".join(out[-10:])
                for form, size, decode in _TAILS:
                    if m := form.search(tail):
                        new = decode(int(m[1], 16))
                        break
            if new is None:
                break
            a, b = first[-size], after[-1]
            del out[-size:], first[-size:], after[-size:]
            out.append(new)
            first.append(a)
            after.append(b)
    return Layer("".join(out), np.array(first), np.array(after), layer.depth + 1, layer.name + "/escapes*", PASSES + 1, True)


def _opener(data: bytes):
    """A decompressor with decompress(data, most) for data that begins so."""
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return zlib.decompressobj(47)


def inflated(data: bytes, most: int) -> tuple[bytes, int, bool]:
    """What compressed data at the start of data gives, at most `most` bytes, as far as it is sound; the bytes it took; whether more is left."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import io

        import zstandard

        out, reader = bytearray(), zstandard.ZstdDecompressor(max_window_size=128 << 20).stream_reader(io.BytesIO(data), read_across_frames=False)
        try:
            while len(out) <= most and (part := reader.read(min(1 << 20, most + 1 - len(out)))):
                out += part
        except zstandard.ZstdError:
            pass
        return bytes(out[:most]), len(data), len(out) > most
    opener, out, at, pending = _opener(data), bytearray(), 0, b""
    try:
        while not opener.eof and len(out) <= most:
            if not pending and getattr(opener, "needs_input", True):
                if at >= len(data):
                    break
                pending, at = data[at:at + 4096], at + 4096
            out += opener.decompress(pending, max(1, most + 1 - len(out)))
            pending = getattr(opener, "unconsumed_tail", b"")
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        pass
    return bytes(out[:most]), min(at, len(data)) - len(opener.unused_data) if opener.eof else len(data), len(out) > most


class Scan:
    """The worklist of one document."""

    def __init__(self, text: str, most: int):
        self.left, self.unopened, self.seen, self.work, self.found = most, 0, set(), [], {}
        self.base = base_matches(text)
        for kind, a, b in self.base:
            self.found[a, kind, b] = (0, "text")
        self.unwrap(Layer(text))
        while self.work:
            layer = self.work.pop()
            for kind, a, b in base_matches(layer.text):
                a, b = layer.cover(a, b)
                self.found[a, kind, b] = min(self.found.get((a, kind, b), (1 << 30, "")), (layer.depth, layer.name))
            self.unwrap(layer)

    def push(self, layer: Layer) -> None:
        if len(layer.text) >= LEAST_LAYER and (key := layer.key()) not in self.seen:
            self.seen.add(key)
            self.work.append(layer)

    def unwrap(self, layer: Layer) -> None:
        text = layer.text
        if layer.passes <= PASSES and ("%" in text or "\\" in text or "&#" in text):
            if layer.passes == PASSES:
                self.push(settled(layer))
            elif new := unescaped(layer):
                self.push(new)
        for m in _BASE64.finditer(text):
            self.unwrap_base64(layer, m.start(), m[0].translate(_PLAIN))
        if layer.raw:
            end = 0
            for m in _MAGIC_TEXT.finditer(text):
                if m.start() >= end:
                    data = text[m.start():].encode("utf-8", "surrogateescape") if not re.search("[\ud800-\udc7f\udd00-\udfff]", text) else b""
                    if used := self.unpack(layer, data, m.start(), None):
                        end = m.start() + len(data[:used].decode("utf-8", "surrogateescape"))

    def unwrap_base64(self, layer: Layer, at: int, run: str) -> None:
        for o in range(4):
            part = run[o:]
            part = part[:len(part) - (len(part) % 4 == 1)]
            data = binascii.a2b_base64(part + "=" * (-len(part) % 4))
            if len(data) >= LEAST_LAYER // 2 and _MAGIC.match(data) and self.unpack(layer, data, at + o, at + o + len(part)):
                continue
            decoded = data.decode("utf-8", "surrogateescape")
            for m in _READABLE.finditer(decoded):
                width = np.array([len(c.encode()) for c in m[0]]) if not m[0].isascii() else np.ones(len(m[0]), np.int64)
                ends = len(decoded[:m.start()].encode("utf-8", "surrogateescape")) + np.cumsum(width)
                f, n = layer.places(at + o, at + o + len(part))
                self.push(Layer(m[0], f[8 * (ends - width) // 6], n[np.minimum((8 * ends - 1) // 6, len(n) - 1)], layer.depth + 1, layer.name + "/base64"))

    def unpack(self, layer: Layer, data: bytes, a: int, b: int | None) -> int:
        """Adds the layer of compressed data that begins at a; bytes it took, or 0 if it is not sound."""
        out, used, more = inflated(data, self.left)
        if len(out) < LEAST_LAYER:
            return 0
        self.left -= len(out)
        self.unopened += more
        b = b if b is not None else a + len(data[:used].decode("utf-8", "surrogateescape"))
        first, after = layer.cover(a, b)
        text = out.decode("utf-8", "surrogateescape")
        self.push(Layer(text, np.broadcast_to(np.int64(first), len(text)), np.broadcast_to(np.int64(after), len(text)), layer.depth + 1, layer.name + "/compressed", raw=True))
        return used


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_inflated: int = MAX_INFLATED) -> DataFrame:
    """Columns id_col, base, spans and unopened for every row of docs.

    base: spans (kind, start, end, depth 0) found in the text itself, in code points, by start and kind; spans: these and the
    parts of the text from which a secret unwraps, with the number of layers and their names; unopened: compressed data of which
    only the first part was looked at, as more than max_inflated bytes come out of a document.

    A null text counts as empty and holds nothing; a text of any length is scanned whole; rows with null or repeated ids are
    scanned like others, and equal texts get equal spans; an empty table gives no rows. Other columns, whatever their
    names, are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32()), ("layer", pa.string())])

    def run(batches):
        begin("secret_scan")
        for batch in batches:
            texts, out = batch.column(1), ([], [], [])
            for at in range(0, len(texts), 256):
                for text in texts.slice(at, 256).to_pylist():
                    s = Scan(text or "", max_inflated)
                    out[0].append([{"kind": KINDS[k], "start": a, "end": b, "depth": 0, "layer": "text"} for a, k, b in sorted((a, k, b) for k, a, b in s.base)])
                    out[1].append([{"kind": KINDS[k], "start": a, "end": b, "depth": d, "layer": n} for (a, k, b), (d, n) in sorted(s.found.items())])
                    out[2].append(s.unopened)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.list_(span)), pa.array(out[1], pa.list_(span)), pa.array(out[2], pa.int64())], names=["id", "base", "spans", "unopened"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, base array<{SPAN}>, spans array<{SPAN}>, unopened long")
    return found.select(F.col("id").alias(id_col), "base", "spans", "unopened")


def _told(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, cast(s.start AS string), cast(s.end AS string))), ',')")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: counts and digest of those in the text itself, and all spans."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_told("base").cast("binary"), 256).alias("base_sha256"), _told("spans").alias("spans"), F.col("unopened").alias("n_unopened"))
