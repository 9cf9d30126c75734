"""Blocks of texts in the shared folder, and numpy helpers of the operators that hash them."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a block, and bytes that are hashed together.
BLOCK_BYTES, CHUNK_BYTES = 4 << 20, 1 << 18
_U = np.uint64


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK_BYTES + 4096)
            self.up, self.down = (np.full(self.n, b, np.uint64) for b in (self.base, pow(self.base, -1, 1 << 64)))
            for a in (self.up, self.down):
                a[0] = 1
                np.cumprod(a, out=a)
        return self.up[:n], self.down[:n]


class PrimePrints:
    """62-bit prints of stretches of a row of values below 2**31: polynomials at two places modulo the prime 2**31 - 1.

    Modulo 2**64 words like 0110 1001 and their complements agree at every odd place; modulo a prime a pair of words agrees at
    few places only, at both of these with a chance near 2**-62.
    """

    P = (1 << 31) - 1
    PLACES = 1_580_030_173, 590_558_003

    def __init__(self):
        self.n = 0

    @classmethod
    def _series(cls, place: int, n: int) -> np.ndarray:
        out, step = np.ones(1, np.uint64), place
        while len(out) < n:
            out, step = np.concatenate([out, out * _U(step) % _U(cls.P)]), step * step % cls.P
        return out[:n]

    def __call__(self, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(values) > self.n:
            self.n = max(len(values), CHUNK_BYTES + 4096)
            self.series = [(self._series(x, self.n), self._series(pow(x, -1, self.P), self.n)) for x in self.PLACES]
        p, out = _U(self.P), np.zeros(len(begin), np.uint64)
        for up, down in self.series:
            terms = values * up[:len(values)]
            terms = (terms & p) + (terms >> _U(31))  # under 2**32, so a sum of 2**31 of them is exact
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(terms, out=sums[1:])
            out = (out << _U(31)) | (sums[end] - sums[begin]) % p * down[begin] % p
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each starts; null as empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    size = np.where(np.array(column.is_valid()), np.diff(offsets), 0) if len(column) else np.empty(0, np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else np.empty(0, np.uint8)
    if len(column) and int(size.sum()) == offsets[-1] - offsets[0]:
        return raw[offsets[0]:offsets[-1]], offsets - offsets[0]
    parts = [raw[a:a + n] for a, n in zip(offsets[:-1].tolist(), size.tolist())]
    return np.concatenate([np.empty(0, np.uint8), *parts]), np.concatenate([[0], np.cumsum(size)])


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def pack48(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view("<u8")


def block_root(scratch) -> str:
    """Where the blocks of a run lie, as a URI."""
    root = scratch.path("blocks")
    return root if "://" in root or root.startswith("file:") else "file://" + root


def save_block(root: str, batch: pa.RecordBatch) -> str:
    """Writes one block and returns its name, which no other block or attempt of a task has."""
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    name = uuid.uuid4().hex
    with files.open_output_stream(f"{base}/{name}") as f:
        f.write(sink.getvalue())
    return name


def load_block(root: str, name: str) -> pa.RecordBatch:
    from pyarrow import fs

    files, base = fs.FileSystem.from_uri(root)
    with files.open_input_stream(f"{base}/{name}") as f:
        return pa.ipc.open_stream(f.read()).read_next_batch()


def cut_blocks(batches, text_at: int, block_bytes: int):
    """Record batches cut at about block_bytes of text, small ones joined."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.add(pc.fill_null(pc.binary_length(batch.column(text_at)), 0), 16)  # rows without text fill a block too
        a, total = 0, size
        for k, n in enumerate(lengths.to_pylist()):
            total += n
            if total >= block_bytes:
                held.append(batch.slice(a, k + 1 - a))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, a, total = [], k + 1, 0
        if a < batch.num_rows:
            held.append(batch.slice(a))
        size = total
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
