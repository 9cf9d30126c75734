"""FLAC columns: 8-bit mono streams of arbitrary bytes, encoded and decoded with numpy.

The encoder takes, for each frame, the cheapest of the fixed linear predictors of order 0 to 2 and a quantized
LPC predictor of order 2, and Rice-codes the residuals. A seek table has a point for each frame, so the decoder
knows where frames start and reads all frames of a batch side by side: one step decodes one Rice code of every
frame, another one predicts one sample of every frame. CRC-8 of headers, CRC-16 of frames and the MD5 of the
samples are verified. Decoded PCM comes with the sample and byte offset of each block.

Streams that other encoders wrote (other predictor orders, partitioned Rice codes, constant and verbatim
subframes, no seek table) are decoded by decode_stream, one code at a time, as long as they are 8-bit mono.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples of a frame, and bytes of payload that are coded side by side.
BLOCK, BATCH_BYTES = 1024, 1_500_000
SAMPLE_RATE = 8000
PAD = 64
#: Precision and shift of quantized LPC coefficients.
PRECISION, SHIFT = 10, 7
ORDERS = 2


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        r = b << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & mask
        out.append(r)
    return np.array(out, np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
#: CRC-16 of a byte followed by a zero byte, to take two bytes a step.
CRC16_NEXT = CRC16[(CRC16 >> 8)] ^ (CRC16 << 8)


def _crc(rows: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each row; zero bytes before the data change nothing."""
    crc = np.zeros(len(rows), np.uint16)
    columns = np.ascontiguousarray(rows.T)
    if bits == 8:
        for c in columns:
            crc = table[(crc ^ c) & 255]
        return crc
    if len(columns) % 2:
        columns = np.concatenate([np.zeros((1, len(rows)), columns.dtype), columns])
    for a, b in zip(columns[0::2], columns[1::2]):
        crc = CRC16_NEXT[(crc >> 8) ^ a] ^ CRC16[(crc & 255) ^ b]
    return crc


def _coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 128:
        return bytes([n])
    tail = []
    lead = 0x40
    while n >= lead >> 1 or not tail:
        tail.append(0x80 | n & 63)
        n >>= 6
        lead = 0x80 >> (len(tail))
        if n < lead >> 1 or len(tail) == 6:
            break
    k = len(tail)
    return bytes([(0xFF00 >> (k + 1)) & 0xFF | n, *tail[::-1]])


_HEADERS: dict[tuple[int, int], bytes] = {}


def _frame_header(number: int, size: int) -> bytes:
    """Sync code to CRC-8 of a fixed-size frame, 8 kHz, mono, 8 bits."""
    key = (number, size)
    if key not in _HEADERS:
        short = size != BLOCK
        head = bytes([0xFF, 0xF8, (7 if short else 10) << 4 | 4, 1 << 1]) + _coded_number(number) + ((size - 1).to_bytes(2, "big") if short else b"")
        crc = 0
        for b in head:
            crc = int(CRC8[crc ^ b])
        if len(_HEADERS) > 100_000:
            _HEADERS.clear()
        _HEADERS[key] = head + bytes([crc])
    return _HEADERS[key]


def _predict(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Residuals, predictor kind (0 to 2 fixed, 3 LPC), and the LPC coefficients of each row of samples."""
    f = len(x)
    e1 = x.copy()
    e1[:, 1:] -= x[:, :-1]
    e2 = e1.copy()
    e2[:, 1:] -= e1[:, :-1]
    y = x.astype(np.float32)
    r0, r1, r2 = (y * y).sum(1) + 1e-3, (y[:, 1:] * y[:, :-1]).sum(1), (y[:, 2:] * y[:, :-2]).sum(1)
    det = np.maximum(r0 * r0 - r1 * r1, 1e-3)
    a, b = (r1 * r0 - r1 * r2) / det, (r0 * r2 - r1 * r1) / det
    lim = (1 << (PRECISION - 1)) - 1
    q = np.clip(np.rint(np.stack([a, b], 1) * (1 << SHIFT)), -lim, lim).astype(np.int32)
    lpc = x.copy()
    lpc[:, 2:] -= (q[:, :1] * x[:, 1:-1] + q[:, 1:] * x[:, :-2]) >> SHIFT
    kinds = [x, e1, e2, lpc]
    cost = np.stack([np.abs(k[:, o:]).sum(1) + (0 if i < 3 else 8) for i, (k, o) in enumerate(zip(kinds, (0, 1, 2, 2)))])
    kind = cost.argmin(0)
    out = np.choose(kind[:, None], kinds) if f else x
    return out, kind, q, np.array([0, 1, 2, 2])[kind]


def _encode_frames(x: np.ndarray, headers: list[bytes]) -> list[bytes]:
    """Frames of equal size."""
    f, n = x.shape
    residual, kind, q, order = _predict(x)
    u = (residual << 1) ^ (residual >> 31)
    column = np.arange(n)[None, :]
    live = column >= order[:, None]
    mean = np.where(live, u, 0).sum(1) / np.maximum(n - order, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int32)
    quotient = u >> k[:, None]
    bits = np.where(live, quotient + 1 + k[:, None], 0)
    size = np.array([len(h) for h in headers])
    lpc_bits = np.where(kind == 3, 4 + 5 + 2 * PRECISION, 0)
    fixed = 8 * size + 8 + 8 * order + lpc_bits + 10  # header, subframe header, warm-up, coefficients, method, Rice parameter
    total = fixed + bits.sum(1)
    octets = (total + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(octets)[:-1]]) * 8
    field = np.zeros(int(octets.sum()) * 8, np.uint8)

    def put(at, value, width):
        for j in range(width):
            field[at + j] = (value >> (width - 1 - j)) & 1

    raw = np.frombuffer(b"".join(headers), np.uint8).astype(np.int32)
    where = np.repeat(start - 8 * np.concatenate([[0], np.cumsum(size)[:-1]]), size) + 8 * np.arange(len(raw))
    put(where, raw, 8)
    at = start + 8 * size
    put(at, np.where(kind == 3, 0x20 | 1, 0x08 | order) << 1, 8)
    at = at + 8
    for o in range(2):
        on = order > o
        put((at + 8 * o)[on], x[on, o] & 255, 8)
    at = at + 8 * order
    on = kind == 3
    put(at[on], np.full(on.sum(), PRECISION - 1), 4)
    put(at[on] + 4, np.full(on.sum(), SHIFT), 5)
    for o in range(2):
        put(at[on] + 9 + PRECISION * o, q[on, o] & ((1 << PRECISION) - 1), PRECISION)
    at = at + lpc_bits
    put(at + 6, k, 4)
    at = at + 10
    place = np.cumsum(bits, 1) - bits + at[:, None] + quotient
    field[place[live]] = 1
    for width in np.unique(k):
        rows = k == width
        if width:
            p, v = place[rows][live[rows]], u[rows][live[rows]]
            for j in range(width):
                field[p + 1 + j] = (v >> (width - 1 - j)) & 1
    data = np.packbits(field)
    first = start // 8
    widest = int(octets.max())
    index = first[:, None] + octets[:, None] - 2 - np.arange(widest - 2, 0, -1)[None, :]
    rows = np.where(index >= first[:, None], data[np.maximum(index, 0)], 0)
    crc = _crc(rows, CRC16, 16)
    data[first + octets - 2], data[first + octets - 1] = crc >> 8, crc & 255
    whole = data.tobytes()
    return [whole[a:a + b] for a, b in zip(first.tolist(), octets.tolist())]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload, whose lengths are positive multiples of 64."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for p, data in enumerate(payloads):
        whole, rest = divmod(len(data), BLOCK)
        by_size.setdefault(BLOCK, []).extend((p, i) for i in range(whole))
        if rest:
            by_size.setdefault(rest, []).append((p, whole))
    frames: dict[tuple[int, int], bytes] = {}
    for size, keys in by_size.items():
        step = max(1, BATCH_BYTES // size)
        for at in range(0, len(keys), step):
            part = keys[at:at + step]
            x = np.frombuffer(b"".join(payloads[p][i * BLOCK:i * BLOCK + size] for p, i in part), np.uint8).reshape(len(part), size).astype(np.int32) - 128
            frames.update(zip(part, _encode_frames(x, [_frame_header(i, size) for _, i in part])))
    out = []
    for p, data in enumerate(payloads):
        own = [frames[p, i] for i in range(-(-len(data) // BLOCK))]
        sizes = [len(x) for x in own]
        signed = (np.frombuffer(data, np.uint8) ^ 128).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (SAMPLE_RATE << 44 | 0 << 41 | 7 << 36 | len(data)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points = np.zeros(len(own), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
        points["sample"] = np.arange(len(own)) * BLOCK
        points["offset"] = np.cumsum([0, *sizes[:-1]])
        points["samples"] = [min(BLOCK, len(data) - i * BLOCK) for i in range(len(own))]
        # a block's length has 24 bits, so long streams have several seek tables
        tables = [points[i:i + 900_000].tobytes() for i in range(0, len(points), 900_000)]
        blocks = [(0, info), *((3, t) for t in tables)]
        meta = b"".join(bytes([kind | (128 if i == len(blocks) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for i, (kind, b) in enumerate(blocks))
        out.append(b"fLaC" + meta + b"".join(own))
    return out


def _metadata(data: bytes) -> tuple[int, int, bytes, np.ndarray | None]:
    """Where frames start, the number of samples, the MD5 and the seek points."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, points, total, md5 = 4, False, [], 0, b""
    while not last:
        kind, size = data[at], int.from_bytes(data[at + 1:at + 4], "big")
        last, kind, body = kind >= 128, kind & 127, data[at + 4:at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise ValueError("only 8-bit mono streams are decoded")
            total, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            points.append(np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])))
        at += 4 + size
    return at, total, md5, np.concatenate(points) if points else None


def _decode_frames(data: np.ndarray, first: np.ndarray, octets: np.ndarray, n: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """Samples of frames with one Rice partition and predictors as the encoder makes them."""
    widest = int(octets.max())
    index = (first + octets)[:, None] - np.arange(widest, 0, -1)[None, :]
    if _crc(np.where(index >= first[:, None], data[np.maximum(index, 0)], 0), CRC16, 16).any():
        raise ValueError("the CRC-16 of a frame differs")
    headers = [_frame_header(i, s) for i, s in zip(number.tolist(), n.tolist())]
    whole = data.tobytes()
    for h, a in zip(headers, first.tolist()):
        if whole[a:a + len(h)] != h:  # sync, sizes, number and CRC-8
            raise ValueError("a frame's header differs from the seek table")
    order_by = np.argsort(-n, kind="stable")
    first, n = first[order_by], n[order_by]
    skip = np.array([len(headers[i]) for i in order_by.tolist()])
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-4] << 24 | padded[1:-3] << 16 | padded[2:-2] << 8 | padded[3:-1]  # 32 bits from each byte on
    at = first + skip
    kind = padded[at].astype(np.int64) >> 1
    lpc = kind >= 32
    order = np.where(lpc, (kind & 31) + 1, kind & 7).astype(np.int64)
    if (padded[at] & 1).any() or ((kind < 8) | (kind > 8 + ORDERS) & ~lpc).any() or (order > ORDERS).any():
        raise ValueError("a subframe of another kind")
    f, longest = len(n), int(n.max())
    out = np.zeros((longest + ORDERS, f), np.int32)  # a row for each sample, and rows before the first
    for o in range(ORDERS):
        on = order > o
        out[ORDERS + o, on] = padded[(at + 1 + o)[on]].astype(np.uint8).view(np.int8)
    pos = (at + 1 + order) * 8

    def take(pos, width):
        return (window[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - width)

    c = np.zeros((2, f), np.int32)
    shift = np.zeros(f, np.int32)
    fixed = ~lpc
    c[0] = np.where(fixed & (order == 1), 1, np.where(fixed & (order == 2), 2, 0))
    c[1] = np.where(fixed & (order == 2), -1, 0)
    if lpc.any():
        if (take(pos[lpc], 4) != PRECISION - 1).any():
            raise ValueError("coefficients of another precision")
        shift[lpc] = take(pos[lpc] + 4, 5)
        for o in range(2):
            v = take(pos[lpc] + 9 + PRECISION * o, PRECISION).astype(np.int32)
            c[o, lpc] = np.where(v >= 1 << (PRECISION - 1), v - (1 << PRECISION), v)
        pos = pos + np.where(lpc, 9 + 2 * PRECISION, 0)
    if take(pos, 6).any():
        raise ValueError("a partitioned residual")
    k = take(pos + 6, 4).astype(np.int64)
    pos = pos + 10
    bits = np.flatnonzero(np.unpackbits(data))
    following = np.full(len(data) * 8 + 1, len(data) * 8, np.int32)
    following[bits] = bits
    following = np.minimum.accumulate(following[::-1])[::-1]  # the next set bit at or after each
    low_shift = (32 - k).astype(np.uint32)
    active = np.searchsorted(-n, -np.arange(longest), "left")  # frames that have a sample of this index
    residual = np.zeros((longest, f), np.int32)
    for i in range(longest):
        m = int(active[i])
        p = pos[:m]
        one = following[p].astype(np.int64)
        low = one + 1
        v = (window[low >> 3] << (low & 7).astype(np.uint32)).astype(np.uint64) >> low_shift[:m]
        u = ((one - p) << k[:m]) | v.astype(np.int64)
        r = (u >> 1) ^ -(u & 1)
        end = low + k[:m]
        if i < ORDERS:
            skipped = order[:m] > i
            r, end = np.where(skipped, 0, r), np.where(skipped, p, end)
        residual[i, :m] = r
        pos[:m] = end
    for i in range(longest):
        m = int(active[i])
        p = (c[0, :m] * out[i + 1, :m] + c[1, :m] * out[i, :m]) >> shift[:m]
        if i < ORDERS:
            p = np.where(order[:m] > i, out[i + 2, :m], p)
        out[i + 2, :m] = p + residual[i, :m]
    found = np.ascontiguousarray((out[ORDERS:].T + 128).astype(np.uint8))
    back = np.empty(f, np.int64)
    back[order_by] = np.arange(f)
    return [found[j, :n[j]] for j in back.tolist()]


def decode_streams(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload and seek points (sample, offset from the start of the stream, samples) of each stream of encode_streams."""
    meta = [_metadata(s) for s in streams]
    parts: list[tuple[int, np.ndarray]] = []
    for i, (_, total, _, points) in enumerate(meta):
        if points is None or int(points["samples"].sum()) != total:
            raise ValueError("the seek table doesn't cover the stream")
        parts += [(i, np.arange(a, min(a + BATCH_BYTES // BLOCK, len(points)))) for a in range(0, len(points), BATCH_BYTES // BLOCK)]
    samples: dict[int, list[np.ndarray]] = {}
    group, size = [], 0

    def flush():
        first, octets, n, number, chunks, base = [], [], [], [], [], 0
        for i, rows in group:
            start, _, _, points = meta[i]
            offset = points["offset"].astype(np.int64)
            ends = np.append(offset[1:], len(streams[i]) - start)
            a, b = int(offset[rows[0]]), int(ends[rows[-1]])
            chunks.append(streams[i][start + a:start + b])
            first.append(offset[rows] - a + base)
            octets.append(ends[rows] - offset[rows])
            n.append(points["samples"][rows].astype(np.int64))
            number.append(rows)
            base += b - a
        found = _decode_frames(np.frombuffer(b"".join(chunks), np.uint8), *map(np.concatenate, (first, octets, n, number)))
        at = 0
        for i, rows in group:
            samples.setdefault(i, []).extend(found[at:at + len(rows)])
            at += len(rows)

    for i, rows in parts:
        group.append((i, rows))
        size += len(rows) * BLOCK
        if size >= BATCH_BYTES:
            flush()
            group, size = [], 0
    if group:
        flush()
    out = []
    for i, (start, total, md5, points) in enumerate(meta):
        payload = np.concatenate(samples[i])
        if len(payload) != total or hashlib.md5((payload ^ 128).tobytes()).digest() != md5:
            raise ValueError("the MD5 of the samples differs")
        seek = np.stack([points["sample"].astype(np.int64), points["offset"].astype(np.int64) + start, points["samples"].astype(np.int64)], 1)
        out.append((payload.tobytes(), seek))
    return out


def decode_stream(data: bytes) -> bytes:
    """Payload of any 8-bit mono stream, read code by code without a seek table."""
    start, total, md5, _ = _metadata(data)
    at, out = start * 8, []
    whole = int.from_bytes(data, "big")
    length = len(data) * 8

    def take(n):
        nonlocal at
        at += n
        return whole >> (length - at) & ((1 << n) - 1)

    def signed(n):
        v = take(n)
        return v - (1 << n) if v >> (n - 1) else v

    while at < length:
        begin = at // 8
        if take(15) != 0x7FFC:
            raise ValueError("no frame where one is due")
        take(1)
        size_code, rate_code, channels, _ = take(4), take(4), take(4), take(4)
        if channels:
            raise ValueError("only mono streams are decoded")
        lead = take(8)
        for _ in range(max(0, next(i for i in range(9) if not lead << i & 128) - 1)):
            take(8)
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else take(8) + 1 if size_code == 6 else take(16) + 1 if size_code == 7 else 256 << (size_code - 8)
        take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        head = data[begin:at // 8]
        crc = 0
        for b in head:
            crc = int(CRC8[crc ^ b])
        if take(8) != crc:
            raise ValueError("the CRC-8 of a header differs")
        take(1)
        kind, wasted = take(6), 0
        if take(1):
            wasted = 1
            while not take(1):
                wasted += 1
        width = 8 - wasted
        if kind == 0:
            x = [signed(width)] * size
        elif kind == 1:
            x = [signed(width) for _ in range(size)]
        else:
            order = (kind & 31) + 1 if kind >= 32 else kind & 7
            x = [signed(width) for _ in range(order)]
            if kind >= 32:
                precision, shift = take(4) + 1, signed(5)
                c = [signed(precision) for _ in range(order)]
            else:
                shift, c = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
            wide = 5 if take(2) else 4
            parts = 1 << take(4)
            for p in range(parts):
                k, count = take(wide), size // parts - (order if p == 0 else 0)
                raw = take(5) if k == (1 << wide) - 1 else None
                for _ in range(count):
                    if raw is not None:
                        r = signed(raw) if raw else 0
                    else:
                        q = 0
                        while not take(1):
                            q += 1
                        u = q << k | (take(k) if k else 0)
                        r = (u >> 1) ^ -(u & 1)
                    x.append((sum(a * b for a, b in zip(c, reversed(x[-order:] if order else []))) >> shift) + r)
        at = -(-at // 8) * 8
        crc = 0
        for b in data[begin:at // 8]:
            crc = (crc << 8 & 0xFFFF) ^ int(CRC16[crc >> 8 ^ b])
        if take(16) != crc:
            raise ValueError("the CRC-16 of a frame differs")
        out += [v << wasted for v in x]
    payload = np.array(out, np.int64)
    if len(payload) != total or hashlib.md5(payload.astype(np.int8).tobytes()).digest() != md5:
        raise ValueError("the MD5 of the samples differs")
    return (payload + 128).astype(np.uint8).tobytes()


def text_payload(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty) with bytes 0 up to a positive multiple of 64."""
    data = (text or "").encode()
    return data + b"\0" * (-len(data) % PAD or (0 if data else PAD))


def feature(payload: bytes) -> str:
    """Exact statistics of the samples: number, sum, energy, sum of absolute differences, sign changes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    d = np.abs(np.diff(x))
    return f"n={len(x)};sum={int(x.sum(dtype=np.int64))};energy={int((x * x).sum(dtype=np.int64))};diff={int(d.sum(dtype=np.int64))};cross={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _groups(values: list, size=len):
    """Runs of a list of about BATCH_BYTES."""
    part, held = [], 0
    for v in values:
        part.append(v)
        held += size(v)
        if held >= BATCH_BYTES:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_flac(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_bytes (of the text) and flac (the stream of its padded payload) for every row of docs.

    A null or empty text gives 64 bytes 0. Texts of any length become one stream. Rows with null or repeated
    ids are kept; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for part in _groups([text_payload(t) for t in batch.column(1).to_pylist()]):
                texts = batch.column(1).slice(at, len(part)).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(encode_streams(part), pa.binary())], names=[id_col, "n_bytes", "flac"])
                at += len(part)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, flac binary")


def decode_flac(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Adds pcm (the payload, unsigned 8-bit), blocks (sample offset, byte offset in flac and samples of each block) and feature to the rows of encode_flac.

    A stream whose checksums don't match raises an error. A null flac gives nulls. Rows with null or repeated ids are
    decoded each for itself, equal streams to equal values; an empty table gives no rows; other columns are ignored.
    """
    kind = media.schema[id_col].dataType.simpleString()
    block = pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("samples", pa.int32())])

    def run(batches):
        for batch in batches:
            at = 0
            for part in _groups(batch.column(2).to_pylist(), lambda s: 2 * len(s or b"")):
                found = iter(decode_streams([s for s in part if s is not None]))
                rows = [next(found) if s is not None else None for s in part]
                out = batch.slice(at, len(part))
                at += len(part)
                points = [[{"sample_offset": a, "byte_offset": b, "samples": c} for a, b, c in r[1].tolist()] if r else None for r in rows]
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([r and r[0] for r in rows], pa.binary()), pa.array(points, pa.list_(block)), pa.array([r and feature(r[0]) for r in rows], pa.string())], names=[id_col, "n_bytes", "flac", "pcm", "blocks", "feature"])

    return media.select(id_col, "n_bytes", "flac").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, flac binary, pcm binary, blocks array<struct<sample_offset: bigint, byte_offset: bigint, samples: int>>, feature string")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as FLAC and read back; digests come from the stored and the decoded bytes."""
    media = decode_flac(encode_flac(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    tail = F.expr(f"substring(pcm, -{PAD}, {PAD})")
    return media.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("flac").cast("long").alias("media_bytes"), F.sha2("flac", 256).alias("media_sha256"), "feature", F.size("blocks").alias("n_blocks"))
