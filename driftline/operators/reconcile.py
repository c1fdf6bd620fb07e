"""Diff of two snapshots to a plan of inserts, updates, deletes and no-ops."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.files import shared_folder
from driftline.functions.parsing import strip
from driftline.operators.keys import KEY, event_key, last_write_wins, remote_key

DAY_START, DAY_END = "00:00:00", "23:59:59"
ZONE = "Asia/Seoul"


def diff(existing: DataFrame, new: DataFrame, key: Sequence[str], same: Column) -> DataFrame:
    """Full outer join on the key: columns of the sides as structs ``ex`` and
    ``nw``, and the action. ``same`` speaks of ``ex.`` and ``nw.`` columns and
    must not be null. Keys must be unique on either side and not null."""
    e = existing.select(*key, F.struct("*").alias("ex"))
    n = new.select(*key, F.struct("*").alias("nw"))
    action = F.when(F.col("ex").isNull(), "insert").when(F.col("nw").isNull(), "delete").when(same, "noop").otherwise("update")
    return e.join(n, list(key), "full_outer").withColumn("action", action)


def same_content() -> Column:
    """A matched pair says the same: trimmed texts, times unless the existing
    event lasts all day, and the sorted list of people."""
    blank = F.lit("")

    def texts(name: str) -> Column:
        return strip(F.coalesce(F.col(f"ex.{name}"), blank)) == strip(F.coalesce(F.col(f"nw.{name}"), blank))

    def times(moment: str, name: str, default: str) -> Column:
        at = F.coalesce(F.col(f"ex.{moment}.dateTime"), blank)
        return (at == "") | (F.substring(at, 12, 8) == F.coalesce(F.nullif(F.col(f"nw.{name}"), blank), F.lit(default)))

    mails = F.transform(F.coalesce("ex.attendees", F.array()), lambda a: F.coalesce(a["email"], blank))
    people = F.array_sort(mails) == F.array_sort(F.coalesce("nw.attendees", F.array().cast("array<string>")))
    return texts("description") & texts("location") & times("start", "start_time", DAY_START) & times("end", "end_time", DAY_END) & people


def remote_payload(prefix: str = "") -> Column:
    """The nested form of an event that the remote calendar takes."""
    c = lambda name: F.col(f"{prefix}{name}")

    def moment(day: str, time: str, default: str) -> Column:
        at = F.concat(c(day).cast("string"), F.lit("T"), F.coalesce(F.nullif(c(time), F.lit("")), F.lit(default)))
        return F.struct(at.alias("dateTime"), F.lit(None).cast("string").alias("date"), F.lit(ZONE).alias("timeZone"))

    return F.struct(
        c("title").alias("summary"),
        F.coalesce(c("description"), F.lit("")).alias("description"),
        F.coalesce(c("location"), F.lit("")).alias("location"),
        moment("start_date", "start_time", DAY_START).alias("start"),
        moment("end_date", "end_time", DAY_END).alias("end"),
        F.transform(F.coalesce(c("attendees"), F.array().cast("array<string>")), lambda a: F.struct(a.alias("email"))).alias("attendees"),
    )


def event_plan(remote: DataFrame, events: DataFrame) -> DataFrame:
    """(action, title, start_date, end_date, remote_id, payload) of an
    incremental sync. Of several rows with a key the last counts on either side:
    by start and id among remote events, by ordinal among new ones."""
    shown = [c for c in remote.columns]
    ex = remote.select(*[F.col(c) for c in shown], F.struct(*remote_key()).alias("_k"))
    ex = ex.select(*[F.col(c) for c in shown], *[F.col(f"_k.{c}").alias(f"k_{c}") for c in KEY])
    ex = ex.withColumn("_at", F.coalesce(F.nullif(F.col("start.dateTime"), F.lit("")), F.col("start.date"), F.lit("")))
    key = [f"k_{c}" for c in KEY]
    ex = last_write_wins(ex, key, "_at", "id").drop("_at")
    nw = events.select("*", F.struct(*event_key()).alias("_k")).select("*", *[F.col(f"_k.{c}").alias(f"k_{c}") for c in KEY]).drop("_k")
    nw = last_write_wins(nw, key, "ordinal")
    plan = diff(ex, nw, key, same_content())
    return plan.select(
        "action",
        *[F.col(f"k_{c}").alias(c) for c in KEY],
        F.col("ex.id").alias("remote_id"),
        F.when(F.col("action").isin("insert", "update"), remote_payload("nw.")).alias("payload"),
    )


def in_range(start: Column, end: Column, low: str, high: str) -> Column:
    """An event's interval overlaps the days from low to high."""
    lo, hi = F.to_timestamp_ntz(F.lit(f"{low} 00:00:00")), F.to_timestamp_ntz(F.lit(f"{high} 23:59:59"))
    return F.coalesce((end > lo) & (start < hi), F.lit(False))


def range_defaults(events: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """(range_start, range_end): the settings, or the events' own range."""
    return events.agg(
        F.coalesce(F.nullif(F.lit(low).cast("string"), F.lit("")), F.min("start_date").cast("string")).alias("range_start"),
        F.coalesce(F.nullif(F.lit(high).cast("string"), F.lit("")), F.max("end_date").cast("string")).alias("range_end"),
    )


def stats(plan: DataFrame) -> DataFrame:
    """One row: created, updated, deleted, unchanged."""
    names = {"created": "insert", "updated": "update", "deleted": "delete", "unchanged": "noop"}
    return plan.agg(*[F.count_if(F.col("action") == a).alias(n) for n, a in names.items()])


def message(created: Column, updated: Column, deleted: Column) -> Column:
    return F.format_string("Sync completed: %d created, %d updated, %d deleted", created, updated, deleted)


def display(events: DataFrame) -> DataFrame:
    """Events as a result page shows them: two dates, times as HH:MM with a tilde
    between if there are two, people in a line, a dash for what is missing."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    clock = lambda c: F.nullif(F.substring(c, 1, 5), F.lit(""))
    return events.select(
        "title",
        F.col("start_date").cast("string").alias("start_date"),
        F.col("end_date").cast("string").alias("end_date"),
        F.concat_ws(" ~ ", clock("start_time"), clock("end_time")).alias("time"),
        dash(F.col("location")).alias("location"),
        dash(F.concat_ws(", ", "attendees")).alias("attendees"),
    )


def missing_from(df: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key the other side lacks: inserts one way round, deletes the
    other. Only the other side's key is read."""
    return df.join(other.select(*key), list(key), "left_anti").select(*df.columns)


def batches(df: DataFrame, order: Sequence[str], size: int = 50) -> DataFrame:
    """Numbers chunks of ``size`` rows in order, without one task for all.

    ``order`` must tell rows apart. Rows are sorted by ranges and written once to
    the shared folder with their place in their range; the rows of the ranges
    before are added from the counts of ranges, which the driver holds.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "batches")
    columns = [F.col(c).asc_nulls_first() for c in order]
    pieces = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >> 26
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(pieces, 100_000))
    placed = df.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    part = F.shiftright("_at", 33).alias("_part")
    before, ranges = 0, []
    for r in sorted(placed.groupBy(part).agg(F.count("*").alias("n")).collect()):
        ranges.append((r[0], before))
        before += r["n"]
    known = F.broadcast(spark.createDataFrame(ranges, "_part bigint, _before bigint"))
    nth = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(known, "_part").withColumn("batch_no", F.floor(nth / size)).select(*df.columns, "batch_no")


def diff_by_digest(existing: DataFrame, new: DataFrame, key: Sequence[str], compared: Sequence[str], buckets: int = 4096) -> DataFrame:
    """``diff`` of snapshots that mostly agree: (key, ex, nw, action), where ex
    and nw hold the compared columns.

    Both sides are summed up by buckets of the key's hash, in any order: rows,
    and two sums of hashes of key and compared columns. Rows of buckets with
    equal sums are no-ops as they stand; only the others are shuffled and joined.
    That buckets differ and all sums agree has a probability of 2^-128 or so.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    row = [*key, *compared]

    def sums(side: DataFrame, name: str) -> DataFrame:
        h = F.xxhash64(*row)
        wide = [F.sum(x.cast("decimal(20,0)")).cast("decimal(38,0)") for x in (h, F.xxhash64(h, *row, F.lit(1)))]
        return side.groupBy(bucket.alias("_bucket")).agg(F.struct(F.count("*").alias("n"), *[w.alias(f"s{i}") for i, w in enumerate(wide)]).alias(name))

    both = sums(existing, "a").join(sums(new, "b"), "_bucket", "full_outer")
    # At most one row for each bucket, a parameter.
    changed = F.broadcast(both.where(~F.col("a").eqNullSafe(F.col("b"))).select("_bucket"))
    content = F.struct(*row)
    of = lambda side: side.select(*row, bucket.alias("_bucket")).join(changed, "_bucket", "left_semi").drop("_bucket")
    same = reduce(Column.__and__, [F.col(f"ex.{c}").eqNullSafe(F.col(f"nw.{c}")) for c in compared], F.lit(True))
    joined = diff(of(existing), of(new), key, same)
    equal = existing.select(*row, bucket.alias("_bucket")).join(changed, "_bucket", "left_anti")
    return joined.unionByName(equal.select(*key, content.alias("ex"), content.alias("nw"), F.lit("noop").alias("action")))
