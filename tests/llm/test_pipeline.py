"""The pipeline over a small corpus, against what plain Python keeps."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickforge.llm import pieces, worker

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    good = {i: text(r.randint(60, 120)) for i in range(300)}
    bad = {1000 + i: " ".join(w.upper() + "!!" for w in text(60).split()) for i in range(120)}
    item = text(25)
    passage = text(20)
    good[1] = good[0].replace(good[0].split()[30], "changed")  # a near copy
    good[2] = good[0]
    good[10] = good[10] + " " + item + " end"
    good[20], good[21] = good[20] + " " + passage, good[21] + " " + passage + " end"
    docs = good | bad
    at = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 1000), 0) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    got = {row.doc_id: row for row in corpus_pipeline.run(spark, at).collect()}
    held = {i for i in good if zlib.crc32(str(i).encode()) % 4 == 2}
    want = set(good) - {1, 2, 10}
    assert set(got) <= want and len(want - set(got)) <= 0.05 * len(held) + 3
    library = pieces.codec(pieces.model_path()).library
    for i in sorted(set(got) - {20, 21})[:50]:
        ids = library.encode(good[i], add_eos=True)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    if {20, 21} <= set(got):  # the second copy of the passage is cut, with the space before it
        cut = good[21].encode().replace((" " + passage).encode(), b"")
        assert got[21].decoded_sha256 == hashlib.sha256(cut).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and corpus_pipeline.ORACLE_SQL is None


def test_rows_of_one_id_are_one_document(spark):
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text + " more", "en", "s", 9), (3, "b other words in this text here", "en", "s", 1), (3, "a first words of another text there", "en", "s", 1), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (4, None, "en", "s", 0), (4, None, "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("rows", F.lit(1))
    got = sorted(((r.doc_id, (r.text or "")[:1]) for r in corpus_pipeline.near_duplicate_stage(spark, frame, "").collect()), key=repr)
    assert got == [(1, "w"), (3, "a"), (4, ""), (None, "w"), (None, "w")]


def test_passages_cut_whole_characters_only(spark):
    passage = "this sentence of more than fifty bytes is in several of the documents here"
    docs = [(1, "one é" + passage + "Ʃ 1"), (2, "mojibake \uFFFD two ũ" + passage + "Ƹ \uFFFD 2"), (3, "three \uFFFD"), (4, "ũ" + passage + "Ƹ"), (5, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {row.doc_id: row.text for row in corpus_pipeline.passage_stage(spark, frame, "").collect()}
    assert got == {1: docs[0][1], 2: "mojibake \uFFFD two  \uFFFD 2", 3: docs[2][1], 5: ""}


def test_batches_are_bounded_by_bytes(spark):
    """A worker gets batches of about BATCH_BYTES, whatever the number and the size of rows; a size that the session was given stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = [f"text {i} " + "some words of a row " * 150 for i in range(3000)] + ["a long row " * (worker.BATCH_BYTES // 8), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).cache()
    spark.conf.unset(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    try:
        out = {r.doc_id: tuple(r)[1:] for r in pieces.encode_pieces(docs, digests=True).collect()}
        found = docs.mapInArrow(sizes, "rows long, size long").collect()
        assert sum(r.rows for r in found) == len(texts)
        assert all(r.size <= worker.BATCH_BYTES + 10_000 for r in found if r.size < worker.BATCH_BYTES * 5 // 4), "batches of ordinary rows"
        assert sum(r.size >= worker.BATCH_BYTES * 5 // 4 for r in found) == 1, "only the long row's is larger"
        assert max(r.size for r in found) < 3 * worker.BATCH_BYTES
        codec = pieces.PieceCodec(pieces.model_path())
        for i, t in enumerate(texts):
            ids, decoded = codec.by_library(t or "")
            assert out[i] == (ids.count(b" ") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        spark.conf.set(key, "1m")
        worker.bound_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
        docs.unpersist()
