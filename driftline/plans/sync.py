"""Whole syncs: from events and a remote snapshot to a plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.keys import event_key, remote_key
from driftline.operators.reconcile import event_plan, in_range, range_defaults, remote_payload
from driftline.schemas import SyncMode


@dataclass(frozen=True)
class SyncConfig:
    mode: SyncMode
    date_range_start: str | None = None
    date_range_end: str | None = None


def remote_in_range(remote: DataFrame, low: str, high: str) -> DataFrame:
    """Remote events that overlap the range; all-day ends are exclusive days.

    Texts of times order like times, so a comparison of texts comes first: it
    reaches the scan and prunes by the files' statistics. The exact test stays.
    """
    at = lambda m: F.coalesce(F.try_to_timestamp(F.substring(F.nullif(F.col(f"{m}.dateTime"), F.lit("")), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(F.col(f"{m}.date"), F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")
    begins = (F.col("start.dateTime") < f"{high}T23:59:59") | (F.col("start.date") <= high)
    ends = (F.col("end.dateTime") > f"{low}T00:00:00") | (F.col("end.date") > low)
    return remote.where(begins).where(ends).where(in_range(at("start"), at("end"), low, high))


def full_replace(remote: DataFrame, events: DataFrame) -> DataFrame:
    """Delete all of the range, insert all events; no key is compared and
    repeated events all stay."""
    gone = remote.select(F.lit("delete").alias("action"), *remote_key(), F.col("id").alias("remote_id"), F.lit(None).alias("payload"))
    new = events.select(F.lit("insert").alias("action"), *event_key(), F.lit(None).cast("string").alias("remote_id"), remote_payload().alias("payload"))
    return new.unionByName(gone.withColumn("payload", F.col("payload").cast(new.schema["payload"].dataType)))


def sync_range(events: DataFrame, config: SyncConfig) -> tuple[str, str]:
    """First and last day of a sync. Where both are set no event is read; else
    two dates are what the driver collects."""
    low, high = config.date_range_start or None, config.date_range_end or None
    if low is None or high is None:
        r = range_defaults(events, low, high).first()
        low, high = r.range_start, r.range_end
    if low is None or high is None:
        raise ValueError("no range: no events and no setting")
    return low, high


def sync(remote: DataFrame, events: DataFrame, config: SyncConfig) -> DataFrame:
    """The plan of a sync in the mode that is set."""
    scoped = remote_in_range(remote, *sync_range(events, config))
    return full_replace(scoped, events) if SyncMode(config.mode) is SyncMode.FULL_REPLACE else event_plan(scoped, events)
