"""Plans applied to snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAYLOAD = ("summary", "description", "location", "start", "end", "attendees")


def new_id() -> Column:
    """The id of an insert, from its key: applying twice gives the same rows."""
    return F.sha2(F.concat_ws("\x1f", "title", "start_date", "end_date"), 256)


def apply_plan(remote: DataFrame, plan: DataFrame) -> DataFrame:
    """The remote snapshot after the plan."""
    touched = plan.where("remote_id is not null and action in ('update', 'delete')")
    kept = remote.join(touched.select(F.col("remote_id").alias("id")), "id", "left_anti").select("id", *_PAYLOAD)
    changed = touched.where("action = 'update'").select(F.col("remote_id").alias("id"), "payload.*")
    added = plan.where("action = 'insert'").select(new_id().alias("id"), "payload.*")
    return kept.unionByName(changed).unionByName(added)
