"""DataFrame operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickforge.llm import decontaminate, flac, jaccard_join, pieces, quality, sharding, suffix_dedup, token_counts, url_filter, warc

R = random.Random(11)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def sentence(n, r=R):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(n))


PASSAGE = sentence(30)
BASE = sentence(120)
ROWS = [(i, sentence(R.randint(1, 80)), "en", f"s{i % 3}") for i in range(30)]
ROWS += [(100 + i, BASE.replace(BASE.split()[i * 3], "changed", 1), "en", "s0") for i in range(6)]
ROWS += [(200, BASE, "en", "s0"), (201, BASE, "fr", None), (202, BASE.upper(), "en", "s1"), (203, sentence(10) + " " + PASSAGE, "en", "s1"), (204, PASSAGE + " " + sentence(15), "en", "s2"), (205, "Ünï " + PASSAGE, None, "s2")]
ROWS += [(300, None, "en", "s0"), (301, "", "en", "s0"), (302, " \n\t ", "en", "s0"), (303, "one two", "en", None), (304, "ONE two", "en", None), (None, BASE, "en", "s0"), (None, None, None, None), (305, "x" * 5000, "en", "s9"), (306, "ab " * 3000, "en", "s9"), (7, ROWS[7][1], "en", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    # names that operators use inside
    return d.select("*", F.lit("n").alias("n"), F.lit(1).alias("id"), F.lit("t").alias("t"), F.lit(2.5).alias("shard"), F.lit("c0").alias("c0"), F.lit(3).alias("score"), F.lit("k").alias("size"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def brute_components(rows):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [(i, len(s), root(i) if i is not None and s else i) for i, s in sets]


def test_jaccard_equals_brute_force(docs):
    got = jaccard_join.link_components(docs).collect()
    assert key(got) == key(brute_components(ROWS))


def test_jaccard_recursion(docs):
    assert key(jaccard_join.link_components(docs, block_bytes=2000, small=2, sparse=0).collect()) == key(brute_components(ROWS))


@pytest.mark.parametrize("small, sparse", [(jaccard_join.SMALL, jaccard_join.SPARSE), (3, 1)])
def test_jaccard_of_large_regions(spark, small, sparse):
    """Chains of near copies, texts around one common line and texts of two common lines."""
    r = random.Random(5)
    line, other = sentence(24, r).split(), sentence(24, r).split()
    rows = []
    for chain in range(3):
        words = sentence(60, r).split()
        for k in range(40):
            words[r.randrange(60)] = f"c{chain}k{k}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + k, " ".join([f"a{k}", f"b{k}", *line, *other[:k % 25]])) for k in range(60)]
    rows += [(2000 + k, " ".join([*other[k % 7:], *line[:24 - k % 5], f"e{k % 3}"])) for k in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert key(jaccard_join.link_components(d, block_bytes=20_000, small=small, sparse=sparse).collect()) == key(brute_components(rows))


def test_texts_of_few_common_lines_divide(spark, monkeypatch):
    """240 texts, each five of ten lines: a region's pairs are not all measured, and the components are right."""
    r = random.Random(3)
    lines = [" ".join(f"w{r.randrange(5000)}" for _ in range(40)) for _ in range(10)]
    rows = [(k, " ".join(lines[i] for i in sorted(r.sample(range(10), 5)))) for k in range(240)]
    measured, table = [], jaccard_join.Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        if name.startswith("measured"):
            measured.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join.Scratch, "table", counted)
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), small=8, sparse=0).collect()
    assert key(got) == key(brute_components(rows)) and len(measured) > 2
    assert sum(measured) < 240 * 239 // 2, measured



def test_regions_of_one_group_of_near_copies_are_one(spark, monkeypatch):
    """150 near copies share many first shingles: members meet pivots of a few regions, not of one for each shingle."""
    r = random.Random(8)
    words, rows = [f"w{r.randrange(5000)}" for _ in range(150)], []
    for k in range(150):
        w = list(words)
        for at in r.sample(range(150), 4):
            w[at] = f"x{k}y{at}"
        rows.append((k, " ".join(w)))
    star, table = [], jaccard_join.Scratch.table

    def counted(self, df, name):
        out = table(self, df, name)
        if name.startswith("star-"):
            star.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join.Scratch, "table", counted)
    got = jaccard_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), sparse=0).collect()
    assert key(got) == key(brute_components(rows))
    assert sum(star) < 3 * 150 * jaccard_join.PIVOTS, star


def brute_repeats(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k:k + 50]] = min(i, first.get(b[k:k + 50], i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1])), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("block, chunk", [(4 << 20, 1 << 18), (20_000, 1000), (3000, 500)])
def test_repeats_equal_brute_force(docs, block, chunk):
    for hot in (suffix_dedup.HOT_BLOCKS, 2, 1):
        got = suffix_dedup.remove_repeats(docs, block_bytes=block, chunk_bytes=chunk, hot_blocks=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert key(got) == key(brute_repeats(ROWS))


def test_repeats_carry_columns(docs):
    out = suffix_dedup.remove_repeats(docs, keep=["doc_id", "lang", "n", "c0"])
    assert out.columns == ["doc_id", "lang", "n", "c0", "n_bytes", "n_removed", "n_spans", "kept"] and out.count() == len(ROWS)


def brute_shards(rows, shards):
    n = len(rows)
    return [(k + 1) * n // shards - k * n // shards for k in range(shards)]


def test_shards_obey_the_law_and_the_mixture(spark):
    rows = [(i, "x" * (i % 7), "big" if i % 3 == 0 else f"s{i % 40}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sharding.stratified_shards(d, 24).toPandas()
    assert out.groupby("shard").size().tolist() == brute_shards(rows, 24)
    assert (out.sort_values(["shard", "slot"]).groupby("shard").slot.apply(list).map(lambda s: s == list(range(len(s))))).all()
    big = out[out.source == "big"].groupby("shard").size()
    assert big.max() - big.min() <= 4  # about a third of each shard, up to the phases of 40 small sources
    again = sharding.stratified_shards(d.repartition(7), 24).toPandas()
    assert out.sort_values("doc_id").position.tolist() == again.sort_values("doc_id").position.tolist()


def test_shards_of_odd_rows(docs):
    out = sharding.stratified_shards(docs, 5).toPandas()
    assert len(out) == len(ROWS) and sorted(out.position) == list(range(len(ROWS)))
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert sorted(zip(out["size"], out.text_crc32)) == want


def test_text_operators_keep_every_row(docs):
    n = sorted((i for i, *_ in ROWS), key=repr)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    assert ids(pieces.encode_pieces(docs)) == ids(pieces.encode_pieces(docs, digests=True)) == n
    assert ids(token_counts.count_tokens(docs)) == n
    media = flac.decode_flac(flac.encode_flac(docs)).collect()
    assert sorted((r.doc_id for r in media), key=repr) == n
    assert sorted(bytes(r.pcm) for r in media) == sorted(flac.text_payload(t) for _, t, *_ in ROWS)
    one = pieces.encode_pieces(docs.where("doc_id = 303")).collect()[0]
    assert pieces.codec(pieces.model_path()).library.decode(one.ids) == one.decoded == "one two"


def test_empty_tables(spark, empty):
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (pieces.encode_pieces(empty), token_counts.count_tokens(empty), flac.decode_flac(flac.encode_flac(empty)), suffix_dedup.remove_repeats(empty), jaccard_join.link_components(empty), sharding.stratified_shards(empty), decontaminate.find_leaks(empty, items), decontaminate.drop_leaks(empty, items)):
        assert out.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages).count() == 0


def test_no_items_leave_all_documents(spark, docs):
    assert decontaminate.drop_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(ROWS)
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    left = decontaminate.drop_leaks(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, *_ in ROWS} - {203, 204, 205}
    assert {r.doc_id for r in decontaminate.find_leaks(docs, items).collect()} == {203, 204, 205}


def test_classifier(spark, docs):
    r = random.Random(3)
    good = [(i, sentence(r.randint(20, 60), r)) for i in range(400)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in sentence(40, r).split())) for i in range(150)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit_quality(d, labels)
    out = quality.score_quality(d, model).toPandas()
    test = out[out.held_out]
    assert (test.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in test.doc_id]).all()
    assert ((test.doc_id < 1000) == (test.predicted == 1)).mean() > 0.97
    odd = quality.score_quality(docs, model, keep=["doc_id", "lang", "n"]).toPandas()
    assert len(odd) == len(ROWS) and odd.score.between(0, 1).all()


def test_classifier_without_labels(spark, docs):
    model = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert set(quality.score_quality(docs, model).toPandas().score) == {0.5}


def test_url_rules(spark):
    cases = [("http://WWW.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://a.example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"), ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
             ("http://x.com", "x.com", "", None, "allow"), ("http://x.com/", "x.com", "/", "com/", "allow"), (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), ("", "", "", None, "allow")]
    d = spark.createDataFrame([(i, c[0], i) for i, c in enumerate(cases)] + [(None, "http://x.net/fr/a", 0)], "page_id long, url string, host int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(d).collect()}
    assert got == {**{i: c[1:] for i, c in enumerate(cases)}, None: ("x.net", "/fr/a", "net/fr/", "block")}


def test_url_mining(spark):
    rows = [(i, f"http://shop{i % 4}.spam.net/es/{i}") for i in range(60)] + [(100 + i, f"http://shop{i % 4}.spam.net/pt/{i}") for i in range(8)] + [(200 + i, f"http://good.org/pt/{i}") for i in range(8)]
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[100 + i] == "block" and got[200 + i] == "allow" for i in range(8))


def test_warc(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 4}</p>") for i in range(40)] + [(50, None, None), (51, "u", ""), (52, "u", ""), (None, "n", "alone"), (None, "n", "<p>0</p>"), (3, "http://h/3", "<p>3</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("shard"), F.lit(2).alias("cell"))
    root = warc.Scratch(spark, "test").path("warc")
    manifest = warc.write_warc(d, root, file_bytes=2000)
    assert manifest.count() > 1
    got = warc.read_warc(spark, root).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    seen = set()
    for r in sorted(got, key=lambda r: (r.page_id is None, r.page_id or 0, r.record_type)):
        if r.page_id is not None and r.record_type == "response":
            html = bytes(r.payload).decode()
            assert last[html] == r.page_id and html not in seen
            seen.add(html)
    assert seen == {h or "" for i, _, h in rows if i is not None}
    one = next(r for r in got if r.page_id == 0)
    assert (one.record_type, one.refers_to, one.payload_bytes) == ("revisit", 36, 8)


def test_warc_of_nothing(spark):
    root = warc.Scratch(spark, "test").path("warc")
    assert warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), root).count() == 0
    assert warc.read_warc(spark, root).count() == 0


def test_copies_go_as_a_whole_and_send_nothing(spark):
    from tickforge.llm import suffix_dedup as S

    text = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(400))
    other = "0123456789" * 4 + text[:60]
    rows = [(5, text), (9, text), (9, text), (None, text), (2, "short"), (7, "short"), (5, text), (3, text + "x" * 80), (11, other), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(docs, block_bytes=300).collect())

    def plain(d, t):
        raw = (t or "").encode()
        before = {x[k:k + 50] for i, x in ((i, (x or "").encode()) for i, x in rows if i is not None) if d is not None and i < d for k in range(len(x) - 49)}
        gone = [False] * len(raw)
        for k in range(len(raw) - 49):
            if raw[k:k + 50] in before:
                gone[k:k + 50] = [True] * 50
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        return d or 0, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)

    assert got == sorted(plain(*r) for r in rows)
    data = np.frombuffer((text + text).encode(), np.uint8)
    doc = S.runs_of_strings(data, np.array([0, 400, 800]), skip=np.array([1]))[0]
    assert set(doc.tolist()) == {0}
