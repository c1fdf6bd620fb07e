"""Keyed state tables: snapshots in, snapshots out, with an explicit now."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of the source replace those of the target with their key; columns
    in ``keep`` stay as the target has them. The source's keys are unique; a
    null key equals none, so its rows stay or come in as they are."""
    t, s = target.select(F.struct("*").alias("t")), source.select(F.struct("*").alias("s"))
    joined = t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer")
    hit, old = F.col("s").isNotNull(), F.col("t").isNotNull()
    pick = lambda c: F.when(hit & ~(old & F.lit(c in keep)), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
    return joined.select(*[pick(c) for c in target.columns])


def delete_by_key(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def update_by_key(df: DataFrame, key: str, value: object, changes: Mapping[str, object]) -> DataFrame:
    hit = F.col(key).eqNullSafe(F.lit(value))
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in changes.items()}
    return df.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def insert_session(sessions: DataFrame, row: DataFrame, now: Column, ttl_hours: int = 24) -> DataFrame:
    new = row.withColumn("created_at", now).withColumn("expires_at", now + F.make_dt_interval(hours=F.lit(ttl_hours)))
    return sessions.unionByName(new)


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def keyset_page(df: DataFrame, key: str, after: object = None, size: int = 250) -> DataFrame:
    """The next ``size`` rows in the order of a unique key, after a key."""
    rest = df if after is None else df.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


def session_view(sessions: DataFrame) -> DataFrame:
    """What of a session its reader gets."""
    return sessions.select("user_id", "email", "name", "oauth_state", "sheets_mode")


def session(sessions: DataFrame, session_id: object, now: Column) -> DataFrame:
    """The session of an id, if it is live: one row or none."""
    return session_view(point_lookup(live(sessions, now), "session_id", session_id))


def live(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.col("expires_at") > now)


def expired(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.col("expires_at") < now)


def purge(df: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, one row with the number of expired rows). A row without an
    expiry, or expiring just now, stays."""
    gone = F.coalesce(F.col("expires_at") < now, F.lit(False))
    return df.where(~gone), df.agg(F.count_if(gone).alias("purged"))


def expiring_soon(df: DataFrame, column: str, now: Column, minutes: int = 5) -> DataFrame:
    return df.where(F.col(column) < now + F.make_dt_interval(mins=F.lit(minutes)))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness; empty where the constraint holds."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
