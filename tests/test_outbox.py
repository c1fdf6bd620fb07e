"""Plans sent as requests: outcomes by row, one run for a token."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from driftline import files
from driftline.operators.reconcile import event_plan
from driftline.schemas import EVENT, REMOTE_EVENT
from driftline.sources import outbox

from test_reconcile import event, remote


def _plan(spark, n=130):
    old = [remote(id=f"r{i}", title=f"old {i}") for i in range(5)]
    return event_plan(spark.createDataFrame(old, REMOTE_EVENT), spark.createDataFrame([event(f"new {i}", ordinal=i) for i in range(n)], EVENT))


def test_a_failing_row_leaves_its_batch_alone(spark, tmp_path):
    plan = _plan(spark).withColumn("payload", F.when(F.col("title") == "new 7", F.col("payload").withField("summary", F.lit(" "))).otherwise(F.col("payload")))
    out = {(r.action, r.title): r for r in outbox.send(plan.coalesce(1), str(tmp_path), "one").collect()}
    assert len(out) == 135 and [r.error for r in out.values() if not r.ok] == ["insert without a summary"]
    assert out["insert", "new 7"].batch is None and out["delete", "old 3"].ok
    sent = outbox.requests(spark, str(tmp_path), "one").collect()
    assert len(sent) == 134 == len({r.key for r in sent})
    lines = [len(open(f[5:]).read().splitlines()) for f in files.list_files(spark, f"{tmp_path}/one/requests")]
    assert sorted(lines) == [34, 50, 50]
    assert json.loads((tmp_path / "one" / "sent.json").read_text()) == {"requests": 134, "failed": 1}


def test_a_token_is_sent_once(spark, tmp_path):
    first = {r.key for r in outbox.send(_plan(spark), str(tmp_path), "one").collect()}
    before = files.list_files(spark, f"{tmp_path}/one/requests")
    assert {r.key for r in outbox.send(_plan(spark), str(tmp_path), "one").collect()} == first
    assert files.list_files(spark, f"{tmp_path}/one/requests") == before
    assert not {r.key for r in outbox.send(_plan(spark), str(tmp_path), "two").collect()} & first
    assert outbox.send(_plan(spark).where("false"), str(tmp_path), "none").count() == 0


def test_a_task_that_runs_again(spark, tmp_path):
    """What another attempt of a task left behind isn't sent."""
    outbox.send(_plan(spark), str(tmp_path), "one")
    some = files.list_files(spark, f"{tmp_path}/one/requests")[0][5:]
    with open(some) as f, open(some.rsplit("/", 1)[0] + "/00000-99-lost-000000.jsonl", "w") as g:
        g.write(f.read())
    assert outbox.requests(spark, str(tmp_path), "one").count() == 135


@pytest.mark.parametrize(("row", "error"), [
    (("insert", None, {"summary": "x", "start": {"dateTime": "2026-01-01T00"}, "end": {"dateTime": "2026-01-02T00"}}), None),
    (("insert", None, {"summary": "x", "start": {"dateTime": "2026-01-03T00"}, "end": {"dateTime": "2026-01-02T00"}}), "insert ends before it starts"),
    (("insert", None, {"summary": "x", "start": None}), "insert without start or end"),
    (("insert", None, None), "insert without a summary"),
    (("delete", "", None), "delete without an id"),
    (("delete", "r", None), None),
    (("noop", "r", None), "unknown action: noop"),
])
def test_problems(row, error):
    assert outbox.problem(*row) == error
