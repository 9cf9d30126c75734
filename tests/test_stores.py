"""Exact quantiles, scans of chosen files, and versions with compaction, against plain Python."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickforge.operators import quantiles as Q
from tickforge.sources import statistics as Z
from tickforge.sources import versions as V

R = random.Random(3)
T0 = datetime(2024, 2, 1)


def plain_quantile(v, q, method):
    v, n = sorted(v), len(v)
    if method == "linear":
        i = q * (n - 1)
        low, high, w = v[int(i)], v[min(int(i) + 1, n - 1)], i - int(i)
        return low if w == 0 or low == high else low * (1 - w) + high * w
    return v[round(q * (n - 1))] if method == "nearest" else v[max(0, math.ceil(round(q * n, 9)) - 1)]


@pytest.mark.parametrize("bins, rounds", [(4096, 3), (4, 2)])
def test_quantiles_of_uneven_groups(spark, monkeypatch, bins, rounds):
    monkeypatch.setattr(Q, "BINS", bins)
    monkeypatch.setattr(Q, "ROUNDS", rounds)
    groups = {"outlier": [R.gauss(0, 1) for _ in range(1000)] + [1e12, -1e300], "ties": [5.0] * 900 + [7.0], "infinite": [math.inf, -math.inf, 1.0], "one": [3.0], None: [float(k) for k in range(11)],
              "scales": [10.0 ** k + j for k in range(-9, 12) for j in range(3)], "zeros": [0.0, -0.0, 0.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("nan", math.nan)]
    R.shuffle(rows)
    wanted = {f"{m}{k}": (q, m) for m in Q.METHODS for k, q in enumerate((0.0, 0.05, 0.5, 0.95, 0.999, 1.0))}
    d = spark.createDataFrame(rows, "g string, v double")
    out = {r.g: r for r in Q.exact_quantiles(d, ["g"], "v", wanted).collect()}
    assert set(out) == set(groups)
    for g, vs in groups.items():
        assert out[g].n == len(vs)
        for name, (q, m) in wanted.items():
            want = plain_quantile(vs, q, m)
            assert out[g][name] == want or math.isclose(out[g][name], want, rel_tol=1e-12), (g, name)
    every = [v for vs in groups.values() for v in vs]
    assert Q.exact_quantiles(d, [], "v", {"p": (0.5, "linear")}).collect()[0].p == plain_quantile(every, 0.5, "linear")
    assert Q.exact_quantiles(d.limit(0), [], "v", {"p": (0.5, "linear")}).count() == 0


def test_only_files_in_windows_are_read(spark, tmp_path):
    at = f"file://{tmp_path}/quotes"
    rows = [("ab"[k % 2], T0 + timedelta(hours=k), float(k)) for k in range(24 * 20)]
    q = spark.createDataFrame(rows, "symbol string, timestamp timestamp_ntz, bid double")
    q.withColumn("day", F.to_date("timestamp")).repartition("day").write.partitionBy("day").parquet(at)
    stats = Z.file_statistics(spark, at, tasks=3).collect()
    assert sum(s.rows for s in stats) == len(rows) and all(s.first.date() == s.last.date() and (s.first_symbol, s.last_symbol) == ("a", "b") for s in stats)
    windows = [("a", T0 + timedelta(days=3, hours=1), T0 + timedelta(days=3, hours=9)), ("a", T0 + timedelta(days=3, hours=5), T0 + timedelta(days=4, hours=2)), ("b", T0 + timedelta(days=9, hours=23), T0 + timedelta(days=9, hours=23)), ("c", T0, T0 + timedelta(days=1)), ("b", T0 + timedelta(days=400), T0 + timedelta(days=401))]
    w = spark.createDataFrame(windows, "symbol string, start timestamp_ntz, end timestamp_ntz")
    table = spark.createDataFrame(stats, Z.STATISTICS)
    chosen = {os.path.dirname(r.path)[-10:] for r in Z.files_in_windows(table, w).collect()}
    assert chosen == {"2024-02-04", "2024-02-05", "2024-02-10"}
    out = Z.scan_windows(spark, table, w, "symbol string, timestamp timestamp_ntz, bid double")
    assert sorted(r.bid for r in out.collect()) == sorted(b for s, t, b in rows if any(s == x and a <= t <= e for x, a, e in windows))
    assert {os.path.dirname(f)[-10:] for f in out.inputFiles()} == chosen  # 3 of 20 days are opened
    assert "PushedFilters: [" in out._jdf.queryExecution().executedPlan().toString() and "GreaterThanOrEqual(timestamp" in out._jdf.queryExecution().executedPlan().toString()
    blind = table.withColumn("first", F.lit(None).cast("timestamp_ntz"))
    assert Z.files_in_windows(blind, w).count() == len(stats)  # what tells nothing is read
    assert Z.scan_windows(spark, table, w.where("symbol = 'c'").withColumn("start", F.col("start") - F.expr("INTERVAL 9 DAYS")).withColumn("end", F.col("start")), "symbol string, timestamp timestamp_ntz, bid double").count() == 0


def test_a_broken_file_is_kept(spark, tmp_path):
    spark.createDataFrame([("a", T0)], "symbol string, timestamp timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/t")
    (tmp_path / "t" / "broken.parquet").write_bytes(b"not parquet")
    stats = Z.file_statistics(spark, f"file://{tmp_path}/t", tasks=2)
    assert sorted((r.rows or 0, r.first) for r in stats.collect() if r.first is None) == [(0, None)] and stats.count() == 2


def test_compaction_keeps_the_view(spark, tmp_path):
    root = str(tmp_path / "t")
    make = lambda n: spark.createDataFrame([(k, f"{n}-{k}", {"n": str(n)}) for k in range(n, n + 5)], "key long, v string, facts map<string,string>")
    with pytest.raises(FileNotFoundError):
        V.last_version(spark, root, ["key"])
    view = lambda: sorted((r.key, r.v, r.facts["n"]) for r in V.last_version(spark, root, ["key"]).collect())
    want = {}
    for n in range(6):
        V.append_version(make(n), root, n)
        want |= {k: (k, f"{n}-{k}", str(n)) for k in range(n, n + 5)}
        if n in (2, 4):
            before = view()
            assert V.compact(spark, root, ["key"]) == n and view() == before
            assert V.compact(spark, root, ["key"]) == n  # nothing new: nothing is done
    assert view() == sorted(want.values())
    read = {os.path.basename(os.path.dirname(f)) for f in V.read_versions(spark, root).inputFiles()}
    assert len(read) == 2 and any(f.startswith("base-000000000004") for f in read) and "version-000000000005" in read
    assert V.vacuum(spark, root) == 6 and view() == sorted(want.values())  # versions 0 to 4 and the first base
    V.append_version(make(5).withColumn("v", F.lit("again")), root, 5)  # a micro-batch that is repeated replaces itself
    assert [v for _, v, _ in view() if v == "again"] == ["again"] * 5
    os.makedirs(f"{root}/base-000000000009-unfinished")  # a compaction that broke off before its manifest
    assert len(view()) == len(want)


def test_memory_view(spark):
    e = spark.createDataFrame([(1, T0, "m", {"a": "1", "b": "2"}), (2, T0 + timedelta(hours=1), "m", None), (3, T0, "other", {})], "evidence_id long, at timestamp_ntz, module string, facts map<string,string>")
    d = spark.createDataFrame([("d1", 1, T0 + timedelta(hours=3), "allow"), ("d9", 99, T0, "block"), ("d0", None, T0, "block")], "decision_id string, evidence_id long, at timestamp_ntz, decision string")
    o = spark.createDataFrame([("d1", "win", {"b": "3"})], "decision_id string, label string, facts map<string,string>")
    got = [(r.evidence_id, r.decision_id, r.at, r.label, r.facts) for r in V.memory_view(e, d, o, limit=3).collect()]
    assert got[:2] == [(1, "d1", T0 + timedelta(hours=3), "win", {"a": "1", "b": "3"}), (2, None, T0 + timedelta(hours=1), None, {})] and len(got) == 3
    assert [r.evidence_id for r in V.memory_view(e, d, o, where="module = 'm' AND label IS NULL").collect()] == [2]


def test_quantiles_of_few_groups_deal_no_rows_by_group(spark):
    """Rows meet the ranges of their group where they are: what is shuffled are histograms."""
    d = spark.range(200_000).select((F.col("id") % 3).alias("g"), F.rand(5).alias("v"))
    out = Q.exact_quantiles(d, ["g"], "v", {"p": (0.95, "nearest")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastHashJoin" in plan  # of the rows, before any statistics
    assert out.count() == 3
    sizes = Q.FEW_GROUPS
    try:
        Q.FEW_GROUPS = 2
        assert sorted(map(tuple, Q.exact_quantiles(d, ["g"], "v", {"p": (0.95, "nearest")}).collect())) == sorted(map(tuple, out.collect()))
    finally:
        Q.FEW_GROUPS = sizes
