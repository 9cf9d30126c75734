"""Codecs and counters against the libraries, exact round trips and brute force."""

import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tickforge.llm import decontaminate as D
from tickforge.llm import flac, jaccard_join, pieces, token_counts, warc

TEXTS = ["", "a", " a  b ", "\n", "\t\n x", "a▁b", "▁", "é日本語 \U0001F600", "x\x00y", "aaaa" * 200, "don't we'll I've 're 'rx '", "Σ ΑΣ İ ß ﬁ", "<|endoftext|> a<|startoftext|>b", "12 3½²٣", "é", "<s> </s> <0x41>"]


def noise(seed, n=400):
    r = random.Random(seed)
    alphabet = ["'", "s", "t", "re", "ve", "ll", "d", "r", "v", "l", "e", "X", " ", "\n", "1", "22", ".", "!?", "é", "Σ", "日", "́", " ", "<|endoftext|>", "\x00"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_pieces_equal_the_library():
    c = pieces.codec(pieces.model_path())
    texts = TEXTS + noise(1)
    assert c.encode_batch(texts) == [c.by_library(t) for t in texts] and c.agrees


def test_pieces_of_the_library_where_it_differs():
    c = pieces.PieceCodec(pieces.model_path())
    c.memo[" two"] = b"1 2 3"
    assert c.encode_batch(["one two", "two"]) == [c.by_library("one two"), c.by_library("two")] and not c.agrees


def test_memo_may_overflow(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_UNITS", 5)
    c = pieces.PieceCodec(pieces.model_path())
    for t in noise(2, 60):
        assert c.encode(t) == c.by_library(t)


def test_token_counts_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = TEXTS + noise(3, 2000) + ["x" * 300, "ab" * 90, "'" * 90]
    assert token_counts.counter().count(texts).tolist() == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_streams_are_cut_at_spaces(monkeypatch):
    texts = noise(4, 200)
    want = token_counts.counter().count(texts).tolist()
    monkeypatch.setattr(token_counts, "STREAM_CHARS", 20)
    assert token_counts.counter().count(texts).tolist() == want


def test_transducer_maps_compose():
    import numpy as np

    r = np.random.default_rng(5)
    classes = r.integers(0, 10, 1000).astype(np.uint8)
    to, out = token_counts._transitions()
    state, want = 0, []
    for c in classes.tolist():
        want.append(out[c, state])
        state = to[c, state]
    assert token_counts.run_transducer(classes).tolist() == want


def test_table_that_fills_up():
    import numpy as np

    t = token_counts.CountTable(4)
    for k in range(1, 40):
        keys, checks = np.array([k * 16 + 1, k * 16 + 2], np.uint64), np.array([k, k + 1], np.uint64)
        new = t.get(keys, checks) < 0
        t.put(keys[new], checks[new], np.array([k, k + 1])[new])
        assert t.get(keys, checks).tolist() == [k, k + 1]
        assert t.get(keys, checks + np.uint64(1)).tolist() == [-1, -1]  # equal hashes of other words


def test_words_of_one_hash(monkeypatch):
    c = token_counts.TokenCounter(__import__("public_tokenizers").path("word_bpe_49k.json"))
    want = c.count(["alpha beta-gamma incomprehensibilities", "beta alpha lahpa xyzzy zyxzy"]).tolist()
    c.base = 1  # words of the same letters have one hash, and the other tells them apart
    c._powers(1 << 16)
    c.table = token_counts.CountTable()
    monkeypatch.setattr(c.table, "get", lambda keys, checks: -np_ones(len(keys)))
    assert c.count(["alpha beta-gamma incomprehensibilities", "beta alpha lahpa xyzzy zyxzy"]).tolist() == want


def np_ones(n):
    import numpy as np

    return np.ones(n, np.int32)


def test_token_counts_of_every_character():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"a{chr(p)}B {chr(p)}x" for p in range(1, 0x30000) if not 0xD800 <= p < 0xE000]
    assert token_counts.counter().count(texts).tolist() == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


PAYLOADS = [flac.text_payload(t) for t in [None, *TEXTS, "word " * 1000]] + [os.urandom(640), b"\0" * 6400, b"\0\xff" * 320, bytes(range(256)) * 20]


def test_flac_round_trip_both_decoders():
    streams = flac.encode_streams(PAYLOADS)
    assert [p for p, _ in flac.decode_streams(streams)] == PAYLOADS
    assert [flac.decode_stream(s) for s in streams] == PAYLOADS


def test_flac_seek_points_give_the_blocks():
    (s,) = flac.encode_streams([PAYLOADS[-1]])
    payload, points = flac.decode_streams([s])[0]
    assert points[:, 2].sum() == len(payload) and all(s[b:b + 2] == b"\xff\xf8" for b in points[:, 1].tolist())


def test_flac_damage_is_found():
    (s,) = flac.encode_streams([PAYLOADS[-2]])
    for at in (len(s) - 1, len(s) // 2, len(s) - 300):
        bad = bytearray(s)
        bad[at] ^= 1
        with pytest.raises((ValueError, IndexError)):
            flac.decode_streams([bytes(bad)])


def test_warc_records_round_trip():
    import io
    import zlib

    def member(x):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(x) + c.flush()

    data = member(warc.make_record(5, "http://x/\r\ny", b"body\r\n\r\nWARC/1.1")) + member(warc.make_record(4, None, b"body", 5)) + member(warc.make_record(None, "u", b""))
    got = list(warc.read_records(io.BytesIO(data).read))
    assert [(h["WARC-Type"], b) for h, b in got] == [("response", b"body\r\n\r\nWARC/1.1"), ("revisit", b""), ("response", b"")]
    assert got[1][0]["X-Refers-To-Page"] == "5" and got[2][0]["X-Page-Id"] == ""
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(io.BytesIO(data[:-10]).read))


ITEM = "The quick brown foxes are jumping over seventeen lazy dogs, while nobody at all is looking at them today."


def edited(text, rate, r):
    s = list(text)
    for _ in range(int(len(text) * rate)):
        p, k = r.randrange(len(s)), r.random()
        if k < 0.34:
            s[p] = r.choice("aeinot ")
        elif k < 0.67:
            del s[p]
        else:
            s.insert(p, r.choice("aeinot "))
    return "".join(s)


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_edit_search_equals_dynamic_programming():
    r = random.Random(6)
    for _ in range(200):
        p = bytes(r.choice(b"abc") for _ in range(r.randint(1, 12)))
        t = bytes(r.choice(b"abc") for _ in range(r.randint(0, 20)))
        d = brute_distance(p, t)
        got = D.edit_search(p, t, len(p))
        assert got[0] == d and brute_distance(p, t[got[1]:got[2]]) == d
        assert D.may_be_near(p, t, d)


def test_leak_recall_and_clean_texts():
    r = random.Random(7)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing"]
    items = [(k, " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(20))) for k in range(60)]
    bench = D.Benchmark(items + [(99, ITEM), (100, "tiny one")])
    pad = lambda: " ".join(r.choice(words) for _ in range(80))
    docs = [pad() + " " + edited(t, 0.1, r) + " " + pad() for _, t in items]
    found = {(row, item) for row, item, *_ in D.contaminated(bench, pa.array(docs))}
    assert sum((k, k) in found for k, _ in items) >= 57
    assert not list(D.contaminated(bench, pa.array([pad(), "", None, "tiny ones"])))


def test_leak_behind_a_repeat():
    item = "no no no no no no one has ever walked so slowly over that bridge in winter, or so they say around here"
    bench = D.Benchmark([(1, item)])
    for n in (0, 20, 100, 1000):
        for text in ("no " * n + item, item + " no" * n, "no " * n + item + " no" * n):
            assert any((row, i, d) == (0, 1, 0) for row, i, _, _, d, _ in D.contaminated(bench, pa.array([text]))), n


def spaced(text, rate, r, kinds="sid"):
    """Edits at equal distances, int(rate * len(text)) of them; substitutions are by a letter that texts don't hold."""
    n = int(rate * len(text))
    at, out = {int((j + 0.5) * len(text) / n): r.choice(kinds) for j in range(n)}, []
    for p, c in enumerate(text):
        kind = at.get(p)
        out.append({None: c, "s": "z", "i": "z" + c, "d": ""}[kind])
    return "".join(out)


def test_leak_recall_of_spaced_edits():
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    items = [(k, text(r.randint(3, 50))) for k in range(100)]
    bench = D.Benchmark(items)
    for rate in (0.09, 0.12, 0.15):
        for kinds in ("s", "sid"):
            docs = [text(60) + " " + spaced(t, rate, r, kinds) + " " + text(60) for _, t in items]
            found = {(row, item) for row, item, *_ in D.contaminated(bench, pa.array(docs))}
            assert sum((k, k) in found for k, _ in items) >= 99, (rate, kinds)


def test_leak_recall_at_the_limit():
    r = random.Random(10)
    text = lambda n: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))
    items = [(k, text(r.randint(12, 50))) for k in range(200)]
    docs = [text(60) + " " + edited(t, D.MAX_EDIT, r) + " " + text(60) for _, t in items]
    found = {(row, item) for row, item, *_ in D.contaminated(D.Benchmark(items), pa.array(docs))}
    assert sum((k, k) in found for k, _ in items) >= D.TARGET_RECALL * len(items)


def test_leak_filter_loses_nothing(monkeypatch):
    r = random.Random(9)
    monkeypatch.setattr(D, "MOST_CELLS", 300)
    for size in [*range(12, 60), 101, 250]:
        item = bytes(r.choice(b"abcd") for _ in range(size))
        (p,) = D.Benchmark([(1, item.decode())]).parts
        for kinds in ("s", "i", "d", "sid"):
            passage = spaced(item.decode(), 0.15, r, kinds) if size * 0.15 >= 1 else item.decode()
            before = "".join(r.choice("efgh") for _ in range(r.randint(0, 3 * size)))
            text = (before + passage + "e" * r.randint(0, 2000)).encode()
            a, b = len(before), len(before) + len(passage)
            assert any(x <= a and b <= y for _, _, x, y in p.find(D.np.frombuffer(text, D.np.uint8)).tolist()), (size, kinds)


def test_leak_spans():
    bench = D.Benchmark([(1, ITEM), (2, "tiny one"), (3, None), (4, "...")])
    text = "é  before " + ITEM.upper() + " after; Tiny, one!"
    rows = list(D.contaminated(bench, pa.array([text])))
    raw = text.encode()
    assert [(i, raw[a:b].decode()) for _, i, a, b, *_ in rows] == [(1, ITEM.upper()[:-1]), (2, "Tiny, one")] or [(i, raw[a:b].decode()) for _, i, a, b, *_ in rows] == [(1, ITEM.upper()), (2, "Tiny, one")]


def test_payloads():
    assert flac.text_payload("") == b"\0" * 64 and len(flac.text_payload("a" * 64)) == 64 and len(flac.text_payload("a" * 65)) == 128
    assert hashlib.sha256(flac.text_payload(None)).digest() == hashlib.sha256(b"\0" * 64).digest()


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_polynomials_modulo_powers_of_two_confuse():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counter = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    for n, a, b in [(1024, "i", "n"), (1024, "a", "q"), (2048, "t", "h"), (2048, "s", "z"), (4096, "i", "n")]:
        words = [thue_morse(n, a, b), thue_morse(n, b, a)]
        want = [len(library.encode(w, add_special_tokens=False).ids) for w in words]
        assert counter.count(words).tolist() == want
        assert [counter.count([w]).tolist()[0] for w in words[::-1]] == want[::-1]
    left, right = (f"one two {thue_morse(512, *x)} four five" for x in ("ab", "ba"))
    doc, prints = jaccard_join.shingle_sets([left, right])
    assert doc.tolist() == [0, 1] and prints[0] != prints[1]


def test_prime_prints_equal_polynomials():
    from tickforge.llm.blocks import PrimePrints

    values = np.random.default_rng(3).integers(0, (1 << 31) - 1, 5000).astype(np.uint64)
    begin, end = np.array([0, 7, 200, 4999, 3]), np.array([5000, 107, 300, 5000, 3])
    values[200:300] = values[7:107]
    p = PrimePrints.P
    want = [sum(int(v) * pow(PrimePrints.PLACES[0], k, p) for k, v in enumerate(values[a:b])) % p << 31 | sum(int(v) * pow(PrimePrints.PLACES[1], k, p) for k, v in enumerate(values[a:b])) % p for a, b in zip(begin, end)]
    got = PrimePrints()(values, begin, end).tolist()
    assert got == want and got[1] == got[2]
