"""Streams that arrive in parts: gaps and outages against the batch, state that does not grow, late rows that change nothing."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickforge.streaming import bars as B
from tickforge.streaming import sessions as G

T0 = datetime(2024, 3, 1)
R = random.Random(8)


class Feed:
    """A folder that rows are added to, and queries on it that go on where they ended."""

    def __init__(self, spark, root, schema):
        self.spark, self.root, self.schema = spark, str(root), schema

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(f"{self.root}/in")

    def stream(self):
        return B.tick_stream(self.spark, f"{self.root}/in", self.spark.createDataFrame([], self.schema).schema, 1000)

    def run(self, stream, name):
        q = stream.writeStream.format("parquet").option("path", f"{self.root}/{name}").option("checkpointLocation", f"{self.root}/{name}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return rows[-1] if rows else None

    def rows(self, name):
        return [tuple(r) for r in self.spark.read.parquet(f"{self.root}/{name}").collect()]


def batch_gaps(times, minutes):
    out = []
    for s in {s for s, _ in times}:
        own = sorted(t for u, t in times if u == s)
        out += [(s, a, b) for a, b in zip(own, own[1:]) if b - a > timedelta(minutes=minutes) and a.date() == b.date()]
    return sorted(out)


def test_gaps_with_late_ticks_equal_the_batch(spark, tmp_path):
    feed = Feed(spark, tmp_path, "symbol string, timestamp timestamp")
    ticks = [(R.choice("ab"), T0 + timedelta(minutes=R.choice([0, 1, 3, 17, 40]) + k * 11)) for k in range(400)] + [("c", T0 + timedelta(hours=5)), ("c", T0 + timedelta(hours=6))]
    parts = {k: [] for k in range(5)}
    for s, t in ticks:
        parts[min(3, int((t - T0).total_seconds() // 86400) + (R.random() < 0.2))].append((s, t))
    parts[4] = [("z", datetime(2100, 1, 1)), (None, T0)]
    told = []
    for k in range(5):
        feed.put(parts[k])
        feed.run(G.gaps(feed.stream(), 30, "50 hours"), "out")
        told.append(sorted(feed.rows("out")))
    assert told[-1] == batch_gaps(ticks, 30) and len(told[-1]) > 5
    assert all(set(a) <= set(b) for a, b in zip(told, told[1:]))  # nothing is taken back


def test_outages_are_told_while_nothing_arrives(spark, tmp_path):
    feed, clock = Feed(spark, tmp_path / "t", "symbol string, timestamp timestamp"), Feed(spark, tmp_path / "c", "timestamp timestamp")
    at = lambda m: T0 + timedelta(minutes=m)
    steps = [([("a", at(0)), ("b", at(1)), (None, at(2)), ("a", None)], at(3), []), ([("a", at(8))], at(10), []), ([], at(30), [("a", at(8), at(18)), ("b", at(1), at(11))]), ([], at(60), []),
             ([("a", at(61)), ("b", at(4))], at(62), []), ([("a", at(59))], at(90), [("a", at(61), at(71))])]
    seen = []
    for ticks, now, new in steps:
        if ticks:
            feed.put(ticks)
        clock.put([(now,)])
        stream = G.outages(feed.stream(), 600, "5 minutes", clock.stream())
        feed.run(stream, "out")
        seen += new
        assert sorted(feed.rows("out")) == sorted(seen)


def test_joined_intervals_equal_brute_force():
    for _ in range(50):
        a = [R.randint(0, 60) for _ in range(R.randint(1, 12))]
        b = [x + R.randint(0, 6) for x in a]
        most, want = R.randint(0, 5), []
        for x, y in sorted(zip(a, b)):
            if want and x <= want[-1][1] + most:
                want[-1][1] = max(want[-1][1], y)
            else:
                want.append([x, y])
        f, n = G.joined_intervals(G.np.array(a), G.np.array(b), most)
        assert list(map(list, zip(f.tolist(), n.tolist()))) == want


def test_reports_are_forgotten(spark, tmp_path):
    feed = Feed(spark, tmp_path, "key long, timestamp timestamp, seq long, kind string, size string")
    held = []
    for day in range(8):
        rows = [(100 * day + k, T0 + timedelta(days=day, hours=1), 1000 * day + k, "x" if k % 3 else None, None) for k in range(40)]
        rows += [(100 * day + k, T0 + timedelta(days=day, hours=2), 1000 * day + 500 + k, "y" if k == 1 else "x", "s") for k in range(4)]
        if day == 7:
            rows += [(1, T0 + timedelta(hours=3), 9000, "late conflict", None), (701, T0 + timedelta(days=7), 9001, "x", None)]
        feed.put(rows)
        held.append(feed.run(B.merged_reports(feed.stream(), ["kind", "size"], "2 hours", 24), "out"))
    assert max(held[2:]) <= 80 and len(set(held[3:])) == 1  # two days of keys at most, and no more on later days
    got = {(k, s): o for k, s, o in feed.rows("out")}
    assert len(got) == 8 * 44 + 1 and (1, 9000) not in got and got[701, 9001] == "duplicate"
    assert [got[700, 7000], got[700, 7500], got[701, 7501], got[702, 7502]] == ["new", "enriched", "conflict", "enriched"]


@pytest.mark.parametrize("slots", [None, 1])
def test_plans_of_late_signals(spark, tmp_path, slots):
    feed = Feed(spark, tmp_path, "symbol string, timestamp timestamp, seq long, hash string, until timestamp")
    at = lambda d, h: T0 + timedelta(days=d, hours=h)
    row = lambda d, h, seq, hash_: ("a", at(d, h), seq, hash_, at(d, h + 2))
    def put(rows):
        feed.put(rows)
        return feed.run(B.planned(feed.stream(), 2, "12 hours", slots), "out")

    put([row(0, 20, 1, "p"), row(0, 21, 2, "q"), row(0, 23, 3, "r")])
    put([row(1, 2, 4, "s")])
    put([row(0, 22, 5, "late, third of its day"), row(1, 3, 6, "p"), row(1, 5, 7, "t")])  # the late row makes no hash of day 1 forgotten
    assert put([row(1, 6, 8, "s"), row(1, 7, 9, "u")]) == 1
    seqs = sorted(r[2] for r in feed.rows("out"))
    assert seqs == ([1, 2, 4, 7] if slots is None else [1, 3, 4, 7])
    held = [put([row(d, 1, 100 + d, f"d{d}"), row(d - 3, 1, 200 + d, f"behind the watermark {d}")]) for d in range(4, 9)]
    assert held == [1] * 5 and sorted(r[2] for r in feed.rows("out"))[4:] == [104, 105, 106, 107, 108]


def test_cooldown_forgets_symbols(spark, tmp_path):
    feed = Feed(spark, tmp_path, "symbol string, timestamp timestamp, seq long")
    held = []
    for day in range(4):
        feed.put([(f"s{day}-{k}", T0 + timedelta(days=day, minutes=m), k) for k in range(20) for m in (0, 5, 11, 22)])
        held.append(feed.run(B.cooldown(feed.stream(), 600), "out"))
    assert held[1:] == [20, 20, 20] or max(held[1:]) <= 40
    assert len(feed.rows("out")) == 4 * 20 * 3
