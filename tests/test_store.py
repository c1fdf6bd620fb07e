"""Keyed tables, diff by digests and recurring events."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline import files
from driftline.operators import reconcile, recurrence, store


def _table(spark, tmp_path, n=200, **options):
    rows = spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit("old").alias("made"))
    return store.KeyedTable(spark, f"{tmp_path}/t").create(rows, "k", 8, **options)


def test_untouched_files_stay(spark, tmp_path):
    t = _table(spark, tmp_path)
    before = t.manifest()
    assert len(before.folders) == 8
    names = {b: files.list_files(spark, f) for b, f in before.folders.items()}
    source = spark.createDataFrame([(3, "new", "now")], "k long, v string, made string")
    assert t.upsert(source, keep=["made"], token="one") and not t.upsert(source, token="one")
    after = t.manifest()
    changed = [b for b in before.folders if before.folders[b] != after.folders[b]]
    assert len(changed) == 1 and after.number == 1
    assert {b: files.list_files(spark, after.folders[b]) for b in names if b not in changed} == {b: f for b, f in names.items() if b not in changed}
    got = {r.k: (r.v, r.made) for r in t.read().collect()}
    assert got == {i: ("new" if i == 3 else f"v{i}", "old") for i in range(200)}
    # Readers of the older manifest still find its files.
    assert t._read(before).where("k = 3").first().v == "v3"


def test_lookup_reads_one_bucket(spark, tmp_path):
    t = _table(spark, tmp_path)
    found = t.lookup(77)
    assert len({f.split("_bucket=")[1][0] for f in found.inputFiles()}) == 1
    assert "EqualTo(k,77)" in found._jdf.queryExecution().toString()
    assert [r.v for r in found.collect()] == ["v77"] and t.lookup(-1, 10**9).count() == 0


def test_constraints(spark, tmp_path):
    t = _table(spark, tmp_path, unique=["v"])
    with pytest.raises(store.NotUnique, match="v: v5"):
        t.upsert(spark.createDataFrame([(999, "v5", "x")], "k long, v string, made string"))
    with pytest.raises(store.NotUnique, match="k: 1"):
        t.upsert(spark.createDataFrame([(1, "a", "x"), (1, "b", "x")], "k long, v string, made string"))
    with pytest.raises(store.NotUnique, match="null"):
        t.upsert(spark.createDataFrame([(None, "a", "x")], "k long, v string, made string"))
    assert t.manifest().number == 0 and t.read().count() == 200
    assert t.delete(spark.range(0, 400, 2).withColumnRenamed("id", "k")) and t.read().count() == 100
    assert t.delete(spark.range(0).withColumnRenamed("id", "k")) and t.read().count() == 100


def test_of_two_writers_one_is_told(spark, tmp_path):
    t = _table(spark, tmp_path, 20)
    late = t.manifest()
    assert t.upsert(spark.createDataFrame([(1, "first", "x")], "k long, v string, made string"))
    with pytest.raises(store.Conflict):
        t._put(store.Manifest(late.number + 1, late.key, late.buckets, late.schema, late.unique, late.folders))
    assert t.lookup(1).first().v == "first"
    with pytest.raises(FileNotFoundError):
        store.KeyedTable(spark, f"{tmp_path}/none").read()


def test_digests(spark):
    """Only ranges that differ are shuffled, and the result is the full diff's."""
    old = spark.range(2000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("payload"), 20)).alias("p"), (F.col("id") * 1.5).alias("x"))
    new = old.where("k <> 11").withColumn("p", F.when(F.col("k") == 100, "changed").otherwise(F.col("p"))).unionByName(spark.createDataFrame([(5000, None, None)], "k long, p string, x double"))
    same = F.col("ex.p").eqNullSafe(F.col("nw.p")) & F.col("ex.x").eqNullSafe(F.col("nw.x"))
    full = {(r.k, r.action) for r in reconcile.diff(old, new, ["k"], same).collect()}
    part = reconcile.diff_by_digest(old, new, ["k"], ["p", "x"], 500)
    assert {(r.k, r.action) for r in part.collect()} == full and part.count() == 2001
    assert {r.action: r["count"] for r in part.groupBy("action").count().collect()} == {"noop": 1998, "insert": 1, "delete": 1, "update": 1}
    assert (part.where("k = 100").first().nw.p, part.where("k = 5000").first().ex) == ("changed", None)
    # Rows shuffled with their payload: those of three buckets, and sums.
    plan = part._jdf.queryExecution().executedPlan()
    part._jdf.collectToPython()

    def exchanged(node):
        name, out = node.nodeName(), []
        if name == "Exchange" and ("ex#" in node.output().toString() or "nw#" in node.output().toString()):
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(i) for i in range(node.children().size())]
        return out + [x for k in kids for x in exchanged(k)]

    moved = exchanged(plan)
    assert moved and sum(moved) < 200
    assert reconcile.diff_by_digest(old, old, ["k"], ["p", "x"]).where("action <> 'noop'").count() == 0
    assert reconcile.diff_by_digest(old.limit(0), new.limit(0), ["k"], ["p", "x"]).count() == 0


def test_repeated_rows_change_a_digest(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "k long, p string")
    assert reconcile.diff_by_digest(a, a.limit(1), ["k"], ["p"]).count() == 2


def test_occurrences(spark):
    d = dt.date
    rows = [
        ("day", d(2026, 1, 1), "daily", 10, None, None), ("end", d(2026, 1, 31), "monthly", None, None, None), ("four", d(2026, 1, 31), "monthly", 1, None, 4), ("leap", d(2024, 2, 29), "yearly", 1, None, None),
        ("until", d(2026, 1, 5), "weekly", 2, d(2026, 2, 10), None), ("late", d(2027, 1, 1), "daily", 1, None, None), ("odd", d(2026, 1, 1), "hourly", 1, None, None), ("few", d(2025, 12, 30), "daily", 1, None, 4), ("none", d(2026, 1, 1), "daily", 1, None, 0),
    ]
    series = spark.createDataFrame(rows, "id string, first date, freq string, every int, until date, times int")
    off = spark.createDataFrame([("day", d(2026, 1, 11)), ("until", d(2026, 1, 20))], "id string, occurrence date")
    got = {}
    for r in recurrence.occurrences(series, "2026-01-01", "2026-06-01", off).collect():
        got.setdefault(r.id, set()).add(r.occurrence.isoformat())
    assert got["day"] == {(d(2026, 1, 1) + dt.timedelta(10 * i)).isoformat() for i in range(16) if i != 1}
    assert got["end"] == {"2026-01-31", "2026-03-31", "2026-05-31"}
    assert got["four"] == {"2026-01-31", "2026-03-31", "2026-05-31"}
    assert got["until"] == {"2026-01-05", "2026-01-19", "2026-02-02"}
    assert got["few"] == {"2026-01-01", "2026-01-02"}
    assert set(got) == {"day", "end", "four", "until", "few"}
    assert {r.occurrence.year for r in recurrence.occurrences(series.where("id = 'leap'"), "2024-01-01", "2033-01-01").collect()} == {2024, 2028, 2032}


def test_a_plan_is_evaluated_once(spark, tmp_path):
    """However often an application reads it; and what it does with ids that meet."""
    payload = "struct<summary:string, location:string>"
    seen = spark.sparkContext.accumulator(0)

    def count(x: int) -> int:
        seen.add(1)
        return x

    t = store.KeyedTable(spark, str(tmp_path)).create(spark.createDataFrame([(f"r{i}", f"s{i}", "here") for i in range(20)], "id string, summary string, location string"), "id", 4)
    rows = [(i, "update" if i < 5 else "delete" if i < 10 else "noop", f"t{i}", f"r{i}", (f"new{i}", None)) for i in range(15)]
    rows += [(20, "insert", "t20", None, ("in", "there")), (21, "delete", "t21", None, None), (22, "delete", "t1", "r1", None)]
    plan = spark.createDataFrame(rows, f"n int, action string, title string, remote_id string, payload {payload}").withColumns({"start_date": F.lit("2026-01-01"), "end_date": F.lit("2026-01-01")})
    plan = plan.where(F.udf(count, "int")("n") >= 0)
    want = {(f"r{i}", f"new{i}" if i < 5 else f"s{i}", None if i < 5 else "here") for i in range(20) if not 5 <= i < 10}
    for run in (1, 2):
        t.apply(plan)
        got = {(r.id, r.summary, r.location) for r in t.read().collect()}
        assert seen.value == run * 12  # those that act
        assert {g for g in got if g[0][0] == "r" and len(g[0]) < 4} == want and {g[1:] for g in got - want} == {("in", "there")} and len(got) == 16
    assert not list((tmp_path / "plans").iterdir())
