"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by id. Where a shard starts follows from the counts of payload bytes per range of ids,
not from samples, so the same table gives the same files whatever the cluster. Each record is a gzip member;
a file ends when its compressed size reaches the limit. Headers and SHA-1 digests are made anew from the
payload. A task writes files under a name of its own attempt and reports them in a manifest, whose rows Spark
keeps of successful attempts only; a second job renames the files that the manifest names, and a manifest of
final names makes the archive visible. A lost executor repeats its task under another temporary name; the
rename finds a file either under its temporary or under its final name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Compressed bytes at which a file ends; payload bytes of a shard lie between these bounds, and about a 256th of the table.
FILE_BYTES, SHARD_BYTES = 32 << 20, (2 << 20, 64 << 20)
#: Ids of one cell of the histogram that places the shards.
CELL_IDS = 256
#: Cells up to this number are broadcast (12 bytes each); more are joined by a shuffle. The cell of rows without an id.
BROADCAST_CELLS, NO_ID = 2_000_000, -(1 << 60)
#: Cells of a range, more if there would be more ranges than RANGES.
RANGE_CELLS, RANGES = 100_000, 10_000
SALTS = 32
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # that of URLs, a fixed value
MANIFEST = "temporary string, file string, records long, bytes long, sha256 string"


def _files(uri: str):
    """A pyarrow file system and the path of a URI on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page {page_id}')}>"


def make_record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """An uncompressed record; with refers_to a revisit, which holds no payload."""
    revisit = refers_to is not None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = b"" if revisit else payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {clean}", "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_records(read):
    """(headers, body) of each record; read(n) gives bytes of a file of gzip members. Digests are verified."""
    inflate, held, ended = zlib.decompressobj(31), bytearray(), False
    raw = b""

    def more() -> bool:
        nonlocal inflate, raw, ended
        while not ended:
            if not raw and not (raw := read(1 << 20)):
                ended = True
                if held or not inflate.eof and inflate.unconsumed_tail:
                    raise ValueError("the archive ends inside a record")
                return False
            out = inflate.decompress(raw)
            raw = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            if out:
                held.extend(out)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        first, *lines = bytes(held[:end]).decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines)
        size = int(headers["Content-Length"])
        while len(held) < end + 8 + size:
            if not more():
                raise ValueError("the archive ends inside a record")
        body = bytes(held[end + 4:end + 4 + size])
        del held[:end + 8 + size]
        if "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode() != headers["WARC-Block-Digest"]:
            raise ValueError(f"a block's digest differs: {headers['WARC-Record-ID']}")
        yield headers, body


def _write_shard(root: str, file_bytes: int):
    """Writes the rows (shard, page_id, url, html) of a shard; repeats has the revisits among them; gives manifest rows."""

    def run(rows: pa.Table, repeats: pa.Table) -> pa.Table:
        attempt = uuid.uuid4().hex
        files, base = _files(root)
        files.create_dir(f"{base}/tmp", recursive=True)
        shard = rows.column("shard")[0].as_py() if rows.num_rows else None
        known = {(p, bytes(d)): r for p, d, r in zip(*(repeats.column(c).to_pylist() for c in ("page_id", "digest", "refers_to")))}
        ids, urls = rows.column("page_id").to_pylist(), rows.column("url").to_pylist()
        digests = [hashlib.sha256(_payload(h)).digest() for h in rows.column("html")]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, digests[k], urls[k] or ""))
        made, out, part, records, size, sha, earlier = [], None, 0, 0, 0, None, None

        def close():
            if out is not None:
                out.close()
                made.append((f"{root}/tmp/{attempt}-{shard:08d}-{part:05d}.warc.gz", f"{root}/pages-{shard:08d}-{part:05d}.warc.gz", records, size, sha.hexdigest()))

        for k in order:
            if out is None or size >= file_bytes:
                close()
                part += out is not None
                records, size, sha = 0, 0, hashlib.sha256()
                out = files.open_output_stream(f"{base}/tmp/{attempt}-{shard:08d}-{part:05d}.warc.gz")
            key = ids[k], digests[k]
            refers_to = known.get(key)
            if refers_to is None and earlier == key:
                refers_to = ids[k]  # a row that is there twice
            earlier = key
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = pack.compress(make_record(ids[k], urls[k], _payload(rows.column("html")[k]), refers_to)) + pack.flush()
            out.write(data)
            sha.update(data)
            records, size = records + 1, size + len(data)
        close()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*made) if made else [[]] * 5, kinds)], names=["temporary", "file", "records", "bytes", "sha256"])

    return run


def _payload(html: pa.Scalar) -> bytes:
    return (html.as_py() or "").encode()


def _commit(batches):
    """Renames the files of a manifest; a repeated task finds them renamed."""
    for batch in batches:
        for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            files, source = _files(old)
            target = _files(new)[1]
            kind = files.get_file_info([source, target])
            if kind[0].is_file:
                files.move(source, target)
            elif not kind[1].is_file:
                raise FileNotFoundError(old)
        yield batch


def _read(verify_files: bool = True):
    def run(batches):
        for batch in batches:
            for path, records, want in zip(*(batch.column(c).to_pylist() for c in (1, 2, 4))):
                files, at = _files(path)
                sha, seen, rows, held = hashlib.sha256(), 0, [], 0
                with files.open_input_stream(at) as f:
                    def read(n):
                        sha.update(data := f.read(n))
                        return data

                    for h, body in read_records(read):
                        seen += 1
                        page, refers = h["X-Page-Id"], h.get("X-Refers-To-Page")
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if refers is None and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                            raise ValueError(f"a payload's digest differs: page {page}")
                        rows.append((int(page) if page else None, h["WARC-Target-URI"], h["WARC-Type"], int(h["X-Payload-Length"]), digest, int(refers) if refers else None, body if refers is None else None))
                        held += len(body)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield _rows(rows)
                            rows, held = [], 0
                if seen != records or sha.hexdigest() != want:
                    raise ValueError(f"{path} differs from the manifest")
                if rows:
                    yield _rows(rows)

    return run


RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in RECORDS.split(", ")])


def plan_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that are revisits: of equal payloads of at least least_bytes the page of the largest id is the response."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.where(F.octet_length(html) >= least_bytes).select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"))
    groups = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    groups = groups.select("digest", F.col("last").alias("refers_to"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return rows.join(groups, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to")


def write_warc(pages: DataFrame, root: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) under root; the manifest as a table.

    A null html is an empty payload, a null url an empty target, a null page_id an empty id (such rows sort
    first; a group whose ids are all null is all responses). Rows that agree in id and payload: the first is
    the response or revisit that its group makes it, the others revisit it. Payloads of any length are one record
    each. Other columns, whatever their names, are ignored. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    cell = F.floor(F.col("page_id") / CELL_IDS)
    sizes = pages.groupBy(cell.alias("cell")).agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 512).alias("bytes"))
    sizes.write.parquet(f"{root}/sizes")
    sizes = spark.read.schema("cell long, bytes long").parquet(f"{root}/sizes")
    total, cells = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    target = min(max(total // 256, SHARD_BYTES[0]), SHARD_BYTES[1])
    # prefix sums inside ranges of cells, and over the ranges, of which there are RANGES at most
    ranges = max(1, min(cells // RANGE_CELLS, RANGES))
    sizes.repartitionByRange(ranges, F.col("cell").asc_nulls_first()).withColumn("range", F.spark_partition_id()).write.parquet(f"{root}/ranges")
    sizes = spark.read.schema("cell long, bytes long, range int").parquet(f"{root}/ranges")
    up = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.groupBy("range").agg(F.sum("bytes").alias("bytes")).select("range", up(Window.orderBy("range")).alias("start"))
    before = F.col("start") + up(Window.partitionBy("range").orderBy(F.col("cell").asc_nulls_first()))
    shards = sizes.join(F.broadcast(starts), "range").select("cell", F.floor(before / F.lit(target)).cast("int").alias("shard"))
    shards.select(F.coalesce("cell", F.lit(NO_ID)).alias("cell"), "shard").write.parquet(f"{root}/shards")
    shards = spark.read.schema("cell long, shard int").parquet(f"{root}/shards")
    shards = F.broadcast(shards) if shards.count() <= BROADCAST_CELLS else shards
    cell = F.coalesce(cell, F.lit(NO_ID)).alias("cell")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", cell).join(shards, "cell").select("shard", "page_id", "url", "html")
    repeats = plan_revisits(pages, least_bytes).select("*", cell).join(shards, "cell").select(F.col("shard").alias("to_shard"), "page_id", "digest", "refers_to").distinct()
    # the payloads are shuffled once, by shard; a shard is small enough for one task
    written = rows.groupBy("shard").cogroup(repeats.groupBy("to_shard")).applyInArrow(_write_shard(root, file_bytes), MANIFEST)
    written.write.parquet(f"{root}/attempts")
    attempts = spark.read.schema(MANIFEST).parquet(f"{root}/attempts")
    files = max(1, min(attempts.count(), 2_000))
    attempts.repartition(files).mapInArrow(_commit, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records of an archive (RECORDS); digests, counts and files are verified against headers and manifest.

    A row for each row that was written, repeated ones too; null ids, urls and payloads come back as null, null and
    empty; an empty archive gives no rows.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    files = max(1, min(manifest.count(), 20_000))
    return manifest.repartition(files, "file").mapInArrow(_read(), RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    root = Scratch(spark, "warc").path("archive")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), root)
    return read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SQL has no base32, so the digest is made of the hexadecimal SHA-1, 5 bits at a time.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS last FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda x: CASE x WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011'
  WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011'
  WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' WHEN 'f' THEN '1111' END), '') AS bits FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
