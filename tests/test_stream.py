from __future__ import annotations

from driftline.operators.apply import apply_plan
from driftline.schemas import EVENT, REMOTE_EVENT
from driftline.streaming.sync_stream import reconcile_stream

from test_reconcile import event, remote


def test_every_batch_meets_the_last_snapshot(spark, tmp_path):
    """Two batches of files; the second is reconciled with what the first left."""
    came, snapshot, seen = tmp_path / "in", tmp_path / "snapshot", []
    spark.createDataFrame([remote("1"), remote("2", "gone")], REMOTE_EVENT).write.parquet(f"{snapshot}-0")

    def sink(plan, number):
        seen.append(sorted((r.action, r.title) for r in plan.collect()))
        apply_plan(spark.read.parquet(f"{snapshot}-{number}"), plan).write.mode("overwrite").parquet(f"{snapshot}-{number + 1}")

    def run(rows):
        spark.createDataFrame(rows, EVENT).write.mode("append").parquet(str(came))
        stream = spark.readStream.schema(EVENT).parquet(str(came))
        query = reconcile_stream(stream, lambda: spark.read.parquet(f"{snapshot}-{len(seen)}"), sink, str(tmp_path / "state"))
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run([event(), event("new", ordinal=2)])
    run([event("new", location="R2")])
    assert seen == [[("delete", "gone"), ("insert", "new"), ("noop", "M")], [("delete", "M"), ("update", "new")]]
    left = spark.read.parquet(f"{snapshot}-2").collect()
    assert [(r.summary, r.location) for r in left] == [("new", "R2")]
