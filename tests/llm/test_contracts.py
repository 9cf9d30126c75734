"""Each registered query over a small folder of tables, every column against plain Python or the library: nulls, empty and very long texts, ties and repeated rows."""

import base64
import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tickforge.llm import decontaminate, quality, registry, sharding, suffix_dedup, warc

from test_frames import brute_components, brute_repeats, key

R = random.Random(31)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(400)]
sentence = lambda n, r=R: " ".join(r.choice(WORDS) for _ in range(n))
PASSAGE, ITEM = sentence(25), sentence(22)
LONG = " ".join(f"{w}{k}" for k, w in enumerate(R.choices(WORDS, k=230_000)))
DOCS = [(k, sentence(R.randint(1, 120)), "en", f"s{k % 3}") for k in range(60)]
DOCS += [(60, DOCS[5][1], "en", "s0"), (61, DOCS[5][1], "fr", None), (62, DOCS[7][1] + " one more", "en", "s1"), (63, "Ünï " + PASSAGE + " é", "de", "s1"), (64, sentence(9) + " " + PASSAGE, "en", "s1"), (65, sentence(30) + " " + ITEM + " end", "en", "s2")]
DOCS += [(70, None, "en", "s0"), (71, "", "en", "s0"), (72, " \n\t", "en", "s0"), (73, "Σ ΑΣ <|endoftext|> don't", None, "s9"), (74, LONG, "en", "s0"), (75, LONG[:1_200_000], "en", "s0"), (76, "日本語" * 50, "ja", "s4"), (77, "x" * 4000, "en", "s4")]
PAGES = [(k, f"https://Shop{k % 5}.example.com/{'en' if k % 2 else 'de'}/item/{k}?a=b", f"<html>{k % 7}</html>") for k in range(80)]
PAGES += [(80, None, None), (81, "no scheme", ""), (82, "http://a.net/es/x#f", "<html>1</html>"), (83, "http://a.net/fr/", "é" * 30), (10**15, "http://x.org", "far"), (90, "http://long.org/", LONG)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(k % 3 > 0), 0) for k, (i, *_) in enumerate(DOCS)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="module")
def empty_folder(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


def text(i):
    return next(t for j, t, *_ in DOCS if j == i) or ""


def rows(spark, folder, name):
    return registry.QUERIES[name](spark, folder).collect()


def test_op1(spark, folder):
    got = rows(spark, folder, "op1_quality")
    assert sorted(r.doc_id for r in got) == sorted(i for i, *_ in DOCS)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    by = {r.doc_id: r.score for r in got}
    assert by[5] == by[60] == by[61] and by[70] == by[71]
    assert {r.doc_id: r.score for r in rows(spark, folder, "op1_quality")} == by


def brute_edit(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_op2(spark, folder):
    got = {(r.doc_id, r.item_id) for r in rows(spark, folder, "op2_decontaminate")}
    fold = lambda s: " ".join("".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in s).split())
    small = [(i, t) for i, t, *_ in DOCS if t and len(t) < 3000]
    want = {(i, 1) for i, t in small if brute_edit(fold(ITEM), fold(t)) <= 0.15 * len(fold(ITEM))}
    assert want == {(65, 1)} == got


def test_leaks_equal_all_windows(spark):
    r = random.Random(4)
    items = [(k, sentence(r.randint(2, 9), r)) for k in range(6)]

    def spoiled(s, n):
        s = list(s)
        for _ in range(n):
            s[r.randrange(len(s))] = r.choice("abcz ")
        return "".join(s)

    docs = [(k, sentence(6, r) + " " + spoiled(items[k % 6][1], r.randint(0, len(items[k % 6][1]) // 6)) + " " + sentence(6, r)) for k in range(60)]
    fold = lambda s: " ".join(s.split())
    want = {(i, j) for i, t in docs for j, p in items if brute_edit(fold(p), fold(t)) <= int(0.15 * len(fold(p)))}
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert got <= want and len(got) >= 0.97 * len(want)
    clash = decontaminate.find_leaks(spark.createDataFrame(docs, "k long, text string"), spark.createDataFrame(items, "k long, text string"), id_col="k", item_col="k")
    assert {(x.k, x.item_k) for x in clash.collect()} == got


def test_op3(spark, folder):
    got = rows(spark, folder, "op3_flac")
    assert len(got) == len(DOCS)
    seen = {}
    for r in got:
        raw = text(r.doc_id).encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and isinstance(r.feature, str)
        assert seen.setdefault(payload, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_op4(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(spark, folder, "op4_token_counts")
    assert len(got) == len(DOCS)
    for r in got:
        n = len(library.encode(text(r.doc_id), add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text(r.doc_id).encode()), n, n > 2048)


def test_op5(spark, folder):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows(spark, folder, "op5_pieces")
    assert len(got) == len(DOCS)
    for r in got:
        ids = library.encode(text(r.doc_id), add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op6_url_filter", "op10_warc"])
def test_pages_equal_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = con.sql(registry.ORACLE_SQL[name])
    got = registry.QUERIES[name](spark, folder)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert key(tuple(r[n] for n in names) for r in got.collect()) == key(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall())


def test_op7(spark, folder):
    got = registry.QUERIES["op7_jaccard_join"](spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert key(got.collect()) == key(brute_components(DOCS))


def test_op8(spark, folder):
    got = rows(spark, folder, "op8_sharding")
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in DOCS)
    counts = [sum(r.shard == s for r in got) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_shards_follow_fractional_ranks(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = sharding.stratified_shards(docs, 7).orderBy("position").collect()
    place, size = {}, {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + 1
    for k, r in enumerate(out):  # the row of rank j of n stands near j / n of the whole, up to the phases of the sources
        j = place[r.source] = place.get(r.source, 0) + 1
        assert r.position == k and abs((k + 0.5) / len(out) - (j - 0.5) / size[r.source]) <= 0.5 / size[r.source] + len(size) / len(out)


def test_op9(spark, folder):
    got = registry.QUERIES["op9_suffix_dedup"](spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert key(got.collect()) == key(brute_repeats(DOCS))


def test_factors_in_slices():
    np = suffix_dedup.np
    data = np.frombuffer((PASSAGE + DOCS[5][1] + PASSAGE + "ab" * 200).encode(), np.uint8)
    place = np.arange(len(data) - 49)
    owner = np.random.default_rng(2).integers(0, 9, len(place))
    first = {}
    for p, o in zip(place.tolist(), owner.tolist()):
        s = data[p:p + 50].tobytes()
        first[s] = min(o, first.get(s, o))
    want = [o > first[data[p:p + 50].tobytes()] for p, o in zip(place.tolist(), owner.tolist())]
    for most in (7, 100, 1 << 20):
        assert suffix_dedup.previous_factors(data, place, owner, most).tolist() == want


def test_op10(spark, folder):
    got = rows(spark, folder, "op10_warc")
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", i), i)
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in PAGES]
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == key(want)


def test_ranges_of_shards(spark, folder, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CELLS", 1)
    monkeypatch.setattr(warc, "SHARD_BYTES", (600, 64 << 20))
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    root = warc.Scratch(spark, "test").path("ranges")
    warc.write_warc(pages.withColumn("page_id", F.col("page_id") * 1000), root)
    shards = spark.read.parquet(f"{root}/shards").orderBy("cell").collect()
    assert [s.shard for s in shards] == sorted(s.shard for s in shards) and len({s.shard for s in shards}) > 5
    assert warc.read_warc(spark, root).count() == len(PAGES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, empty_folder, name):
    assert registry.QUERIES[name](spark, empty_folder).count() == 0


def test_pipeline_of_empty_tables(spark, empty_folder):
    assert pytest.importorskip("corpus_pipeline").run(spark, empty_folder).count() == 0


def test_kept_columns_may_clash(spark):
    d = spark.createDataFrame([(1, "some text", "a", 2.0, 3)], "doc_id long, text string, held_out string, score double, n_bytes int")
    model = quality.fit_quality(d, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score_quality(d, model, keep=["score", "held_out", "n_bytes"]).columns == ["doc_id", "n_bytes", "held_out", "score", "predicted"]
    out = suffix_dedup.remove_repeats(d, keep=["doc_id", "score", "n_bytes"])
    assert out.columns == ["doc_id", "score", "n_bytes", "n_removed", "n_spans", "kept"] and out.collect()[0].n_bytes == 9


def test_classifier_of_repeated_ids(spark):
    d = spark.createDataFrame([(k % 30, f"text {k} " * 3) for k in range(90)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    scores = [key(quality.score_quality(d, quality.fit_quality(d.repartition(n), labels)).collect()) for n in (1, 4)]
    assert scores[0] == scores[1]


def test_no_machine_folder_on_a_cluster(spark):
    assert os.path.isdir(sharding.Scratch(spark, "x").root.replace("file://", "").rsplit("/", 1)[0])
