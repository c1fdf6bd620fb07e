from __future__ import annotations

from pyspark.sql import functions as F

from driftline.operators import state
from driftline.operators.reconcile import batches
from driftline.operators.sqltext import execute, row_exists, rows, rows_as_json, rows_as_text, table_exists

def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")


def test_ttl(spark):
    df = spark.createDataFrame([("a", "2026-01-01 00:00:01"), ("b", "2026-01-01 00:00:00"), ("c", "2025-12-31 23:59:59"), ("d", None)], "id string, e string")
    df = df.select("id", F.col("e").cast("timestamp_ntz").alias("expires_at"))
    assert [r.id for r in state.live(df, now()).collect()] == ["a"]
    assert [r.id for r in state.expired(df, now()).collect()] == ["c"]
    stays, purged = state.purge(df, now())
    assert sorted(r.id for r in stays.collect()) == ["a", "b", "d"]
    assert purged.first().purged == 1
    assert sorted(r.id for r in state.expiring_soon(df, "expires_at", now()).collect()) == ["a", "b", "c"]


def test_upsert(spark):
    target = spark.createDataFrame([("u", "t1", "r1", 1), ("v", "t2", "r2", 2)], "user_id string, access string, refresh string, created int")
    source = spark.createDataFrame([("u", "t9", "", 9), ("w", "t3", "r3", 9)], target.schema)
    got = {tuple(r) for r in state.upsert(target, source, "user_id", keep=["created"]).collect()}
    assert got == {("u", "t9", "", 1), ("v", "t2", "r2", 2), ("w", "t3", "r3", 9)}
    assert state.upsert(target, source.limit(0), "user_id").count() == 2
    null = spark.createDataFrame([(None, "x", "y", 3)], target.schema)
    got = {tuple(r) for r in state.upsert(target, null, "user_id").collect()}
    assert got == {("u", "t1", "r1", 1), ("v", "t2", "r2", 2), (None, "x", "y", 3)}
    assert {tuple(r) for r in state.upsert(null, target, "user_id", keep=["created"]).collect()} == got
    assert [r.user_id for r in state.keyset_page(target, "user_id", size=1).collect()] == ["u"]
    assert [r.user_id for r in state.keyset_page(target, "user_id", "u").collect()] == ["v"]
    assert state.delete_by_key(target, "user_id", "u").count() == 1
    assert state.point_lookup(target, "user_id", "v").first().access == "t2"
    assert state.update_by_key(target, "user_id", "v", {"access": "x"}).where("access = 'x'").count() == 1
    assert state.repeated_keys(target.unionByName(target), "user_id").count() == 2


def test_insert_session(spark):
    sessions = spark.createDataFrame([], "session_id string, created_at timestamp_ntz, expires_at timestamp_ntz")
    row = state.insert_session(sessions, spark.createDataFrame([("s",)], "session_id string"), now()).first()
    assert str(row.expires_at) == "2026-01-02 00:00:00"


def test_session(spark):
    rows = [("a", "u", "e", "n", "o", True, "2026-01-01 00:00:01"), ("b", "v", None, None, "p", None, "2026-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "session_id string, user_id string, email string, name string, oauth_state string, sheets_mode boolean, expires string")
    df = df.withColumn("expires_at", F.col("expires").cast("timestamp_ntz"))
    assert [tuple(r) for r in state.session(df, "a", now()).collect()] == [("u", "e", "n", "o", True)]
    assert state.session(df, "b", now()).count() == state.session(df, "c", now()).count() == 0
    assert state.session_view(df).columns == ["user_id", "email", "name", "oauth_state", "sheets_mode"]


def test_sql_text(spark):
    df = rows(spark, "SELECT id, nullif(id, 1) AS x FROM range(3) WHERE id < :n", {"n": 2})
    assert [r.line for r in rows_as_text(df).collect()] == ["0|0", "1|"]
    assert [r.json for r in rows_as_json(df).collect()] == ['{"id":0,"x":0}', '{"id":1,"x":null}']
    assert row_exists(df).first().found and not row_exists(df.limit(0)).first().found
    assert not table_exists(spark, "driftline_none")
    execute(spark, "CREATE OR REPLACE TEMPORARY VIEW driftline_some AS SELECT 1 AS a")
    assert table_exists(spark, "driftline_some")


def test_batches(spark):
    got = batches(spark.range(0, 230, 1, 7), ["id"]).collect()
    assert all(r.batch_no == r.id // 50 for r in got) and len(got) == 230
    pairs = spark.createDataFrame([("ab"[i % 2] if i % 5 else None, i) for i in range(500)], "a string, b int").repartition(5)
    order = sorted(((r.a is not None, r.a or "", r.b) for r in pairs.collect()))
    got = {((r.a is not None), r.a or "", r.b): r.batch_no for r in batches(pairs, ["a", "b"], 7).collect()}
    assert got == {x: i // 7 for i, x in enumerate(order)}
    assert batches(pairs.limit(0), ["a", "b"]).count() == 0
