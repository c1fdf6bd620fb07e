from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.operators.apply import apply_plan
from driftline.operators.reconcile import event_plan, stats
from driftline.plans.sync import SyncConfig, sync
from driftline.schemas import EVENT, REMOTE_EVENT, SyncMode

DAY = dt.date(2026, 9, 1)


def remote(id="1", title="M", start="09:00:00", end="10:00:00", location="R1", description=None, people=None, all_day=False, day="2026-09-01"):
    moment = lambda t: (None, day, None) if all_day else (f"{day}T{t}+09:00", None, "Asia/Seoul")
    return (id, title, description, location, moment(start), moment(end), [(p,) for p in people] if people is not None else None)


def event(title="M", start="09:00:00", end="10:00:00", location="R1", description=None, people=None, end_date=DAY, ordinal=1):
    return (title, DAY, end_date, description, location, people, start, end, "s", ordinal, (None, 0, ordinal))


CASES = {
    "same": ([remote()], [event()], ["noop"]),
    "new": ([], [event()], ["insert"]),
    "gone": ([remote()], [], ["delete"]),
    "location": ([remote()], [event(location="R2")], ["update"]),
    "blank location": ([remote(location=None)], [event(location="")], ["noop"]),
    "trimmed": ([remote(description=" d ")], [event(description="d")], ["noop"]),
    "order of people": ([remote(people=["b@x", "a@x"])], [event(people=["a@x", "b@x"])], ["noop"]),
    "repeated people": ([remote(people=["a@x"])], [event(people=["a@x", "a@x"])], ["update"]),
    "case of people": ([remote(people=["A@x"])], [event(people=["a@x"])], ["update"]),
    "default times": ([remote(start="00:00:00", end="23:59:59")], [event(start=None, end=None)], ["noop"]),
    "end date": ([remote()], [event(end_date=dt.date(2026, 9, 2))], ["delete", "insert"]),
    "all day": ([remote(all_day=True)], [event(start="07:00:00")], ["noop"]),
    "two old": ([remote("1"), remote("2")], [], ["delete"]),
    "two new": ([remote()], [event(), event(location="R2", ordinal=2)], ["update"]),
    "trimmed key": ([remote(title=" M ")], [event()], ["noop"]),
    "any white space": ([remote(title="\tM\u00a0\n", description="\u2003d\r", location="\x1fR1 ")], [event(description="d")], ["noop"]),
    "null summary": ([remote(title=None)], [], ["delete"]),
    "nothing": ([], [], []),
}


@pytest.mark.parametrize("case", CASES)
def test_actions(spark, case):
    old, new, actions = CASES[case]
    old, new = spark.createDataFrame(old, REMOTE_EVENT), spark.createDataFrame(new, EVENT)
    plan = event_plan(old, new)
    rows = plan.collect()
    assert sorted(r.action for r in rows) == actions
    if case == "two old":
        assert rows[0].remote_id == "2"
    if case != "two old":  # an earlier duplicate is left alone, as a later sync sees it
        again = event_plan(apply_plan(old, plan), new)
        assert {r.action for r in again.collect()} <= {"noop"}


def test_sync_modes(spark):
    old = spark.createDataFrame([remote("1"), remote("2", "X"), remote("3", "far", day="2030-01-01")], REMOTE_EVENT)
    new = spark.createDataFrame([event(), event(ordinal=2)], EVENT)
    plan = sync(old, new, SyncConfig(SyncMode.FULL_REPLACE))
    assert stats(plan).first().asDict() == {"created": 2, "updated": 0, "deleted": 2, "unchanged": 0}
    plan = sync(old, new, SyncConfig(SyncMode.INCREMENTAL_UPDATE, "", None))
    assert stats(plan).first().asDict() == {"created": 0, "updated": 0, "deleted": 1, "unchanged": 1}
    plan = sync(old, new, SyncConfig(SyncMode.INCREMENTAL_UPDATE, "2026-01-01", "2031-01-01"))
    assert stats(plan).first().deleted == 2
    with pytest.raises(ValueError):
        sync(old, new.limit(0), SyncConfig(SyncMode.FULL_REPLACE))


def test_order_does_not_matter(spark):
    events = [event(str(i % 7), location=str(i), ordinal=i) for i in range(40)]
    old = spark.createDataFrame([remote(str(i), str(i)) for i in range(4, 10)], REMOTE_EVENT)
    a = event_plan(old, spark.createDataFrame(events, EVENT))
    b = event_plan(old, spark.createDataFrame(events[::-1], EVENT).orderBy(F.rand(3)))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert a.where("action <> 'delete'").count() == 7
