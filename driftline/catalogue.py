"""Queries of the engine's operators on the star-schema tables, with SQL.

The tables hold no calendar, so every operator runs on an analogous column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftline import files
from driftline.functions import parsing
from driftline.operators import apply, ingest, keys, reconcile, recurrence, sqltext, state, store
from driftline.plans import sync
from driftline.schemas import USER_TOKENS, SyncMode
from driftline.sources import grid, outbox, xlsx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# -- reconcile -----------------------------------------------------------------

_SNAPSHOTS = """
WITH ex AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0),
nw AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN '9-CHANGED' ELSE o_orderpriority END AS o_orderpriority, o_totalprice
       FROM orders WHERE o_orderkey % 10 <> 1),
plan AS (
  SELECT coalesce(ex.o_orderkey, nw.o_orderkey) AS o_orderkey,
         CASE WHEN ex.o_orderkey IS NULL THEN 'insert' WHEN nw.o_orderkey IS NULL THEN 'delete'
              WHEN ex.o_orderpriority IS NOT DISTINCT FROM nw.o_orderpriority AND ex.o_totalprice IS NOT DISTINCT FROM nw.o_totalprice THEN 'noop'
              ELSE 'update' END AS action,
         ex.o_orderpriority AS old_priority, nw.o_orderpriority AS new_priority
  FROM ex FULL OUTER JOIN nw ON ex.o_orderkey = nw.o_orderkey)
"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 7 == 0, "9-CHANGED").otherwise(F.col("o_orderpriority"))
    return orders.where("o_orderkey % 10 <> 0"), orders.where("o_orderkey % 10 <> 1").withColumn("o_orderpriority", changed)


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("ex.o_orderpriority").eqNullSafe(F.col("nw.o_orderpriority")) & F.col("ex.o_totalprice").eqNullSafe(F.col("nw.o_totalprice"))
    return reconcile.diff(*_snapshots(spark, sf_dir), ["o_orderkey"], same)


@_query(_SNAPSHOTS + "SELECT action, count(*) AS n FROM plan GROUP BY action")
def reconcile_actions(spark, sf_dir):
    return _plan(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@_query(_SNAPSHOTS + "SELECT * FROM plan")
def reconcile_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select("o_orderkey", "action", F.col("ex.o_orderpriority").alias("old_priority"), F.col("nw.o_orderpriority").alias("new_priority"))


@_query(_SNAPSHOTS + "SELECT o_orderkey, o_totalprice FROM nw WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.o_orderkey = nw.o_orderkey)")
def reconcile_inserts(spark, sf_dir):
    ex, nw = _snapshots(spark, sf_dir)
    return reconcile.missing_from(nw, ex, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@_query(_SNAPSHOTS + "SELECT o_orderkey, o_totalprice FROM ex WHERE NOT EXISTS (SELECT 1 FROM nw WHERE ex.o_orderkey = nw.o_orderkey)")
def reconcile_deletes(spark, sf_dir):
    ex, nw = _snapshots(spark, sf_dir)
    return reconcile.missing_from(ex, nw, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@_query(_SNAPSHOTS + """SELECT count(*) FILTER (action = 'insert') AS created, count(*) FILTER (action = 'update') AS updated,
  count(*) FILTER (action = 'delete') AS deleted, count(*) FILTER (action = 'noop') AS unchanged FROM plan""")
def sync_stats(spark, sf_dir):
    return reconcile.stats(_plan(spark, sf_dir))


@_query(_SNAPSHOTS + """SELECT printf('Sync completed: %d created, %d updated, %d deleted', count(*) FILTER (action = 'insert'),
  count(*) FILTER (action = 'update'), count(*) FILTER (action = 'delete')) AS message FROM plan""")
def sync_message(spark, sf_dir):
    s = reconcile.stats(_plan(spark, sf_dir))
    return s.select(reconcile.message(F.col("created"), F.col("updated"), F.col("deleted")).alias("message"))


# Orders as calendar events: a remote snapshot and the sheet's new events.

_CALENDAR = """
WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus AS status, o_orderpriority AS priority, 'c' || o_custkey || '@x' AS mail FROM orders),
remote AS (SELECT *, 'r' || k AS id, 'E' || k AS title, CASE WHEN k % 4 = 0 THEN NULL ELSE priority END AS location, k % 9 = 0 AS all_day FROM o WHERE k % 10 <> 0),
event AS (SELECT *, 'E' || k AS title, CASE WHEN k % 4 = 0 THEN '' WHEN k % 7 = 0 THEN 'R9' ELSE priority END AS location,
  CASE WHEN k % 11 = 0 THEN '11:00:00' ELSE '10:00:00' END AS end_time FROM o WHERE k % 10 <> 1),
plan AS (
  SELECT coalesce(r.title, e.title) AS title, coalesce(r.day, e.day) AS day, r.id AS remote_id, e.location AS new_location, e.day || 'T' || e.end_time AS new_end,
         CASE WHEN r.k IS NULL THEN 'insert' WHEN e.k IS NULL THEN 'delete'
              WHEN coalesce(r.location, '') = e.location AND (r.all_day OR e.end_time = '10:00:00') THEN 'noop' ELSE 'update' END AS action
  FROM remote r FULL OUTER JOIN event e ON r.k = e.k)
"""


def _calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(remote, events). Texts of the remote side have white space of all kinds
    around them, and some of its events last all day."""
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), "o_orderstatus", "o_orderpriority", "o_custkey")
    name = F.concat(F.lit("E"), F.col("k").cast("string"))
    mail = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@x"))
    whole = F.col("k") % 9 == 0

    def moment(time: str) -> Column:
        at = F.when(~whole, F.concat(F.col("day").cast("string"), F.lit(f"T{time}+09:00")))
        return F.struct(at.alias("dateTime"), F.when(whole, F.col("day").cast("string")).alias("date"), F.lit("Asia/Seoul").alias("timeZone"))

    remote = o.where("k % 10 <> 0").select(
        F.concat(F.lit("r"), F.col("k").cast("string")).alias("id"),
        F.concat(F.lit(" \t"), name, F.lit("\u00a0\n")).alias("summary"),
        F.concat(F.lit("\n"), "o_orderstatus", F.lit("\u2003")).alias("description"),
        F.when(F.col("k") % 4 != 0, F.col("o_orderpriority")).alias("location"),
        moment("09:00:00").alias("start"),
        moment("10:00:00").alias("end"),
        F.array(F.struct(mail.alias("email"))).alias("attendees"),
    )
    events = o.where("k % 10 <> 1").select(
        name.alias("title"),
        F.col("day").alias("start_date"),
        F.col("day").alias("end_date"),
        F.col("o_orderstatus").alias("description"),
        F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 7 == 0, "R9").otherwise(F.col("o_orderpriority")).alias("location"),
        F.array(mail).alias("attendees"),
        F.lit("09:00:00").alias("start_time"),
        F.when(F.col("k") % 11 == 0, "11:00:00").otherwise("10:00:00").alias("end_time"),
        F.lit("orders").alias("sheet_name"),
        F.col("k").alias("row_no"),
        F.col("k").alias("ordinal"),
    )
    return remote, events


def _incremental(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    remote, events = _calendar(spark, sf_dir)
    return remote, sync.sync(remote, events, sync.SyncConfig(SyncMode.INCREMENTAL_UPDATE, "1990-01-01", "2030-01-01"))


@_query(_CALENDAR + """SELECT action, title, day AS start_date, day AS end_date, remote_id, CASE WHEN action IN ('insert', 'update') THEN new_location END AS new_location,
  CASE WHEN action IN ('insert', 'update') THEN new_end END AS new_end FROM plan""")
def sync_incremental(spark, sf_dir):
    p = _incremental(spark, sf_dir)[1]
    return p.select("action", "title", "start_date", "end_date", "remote_id", F.col("payload.location").alias("new_location"), F.col("payload.end.dateTime").alias("new_end"))


@_query(_CALENDAR + """SELECT r.id, CASE WHEN action = 'update' THEN r.title ELSE chr(32) || chr(9) || r.title || chr(160) || chr(10) END AS summary,
  CASE WHEN action = 'update' THEN new_location ELSE location END AS location,
  CASE WHEN action = 'update' THEN new_end WHEN NOT all_day THEN r.day || 'T10:00:00+09:00' END AS end_at
FROM remote r JOIN plan ON r.id = remote_id WHERE action <> 'delete'
UNION ALL SELECT sha256(title || chr(31) || day || chr(31) || day), title, new_location, new_end FROM plan WHERE action = 'insert'""")
def applied_snapshot(spark, sf_dir):
    remote, plan = _incremental(spark, sf_dir)
    return apply.apply_plan(remote, plan).select("id", "summary", "location", F.col("end.dateTime").alias("end_at"))


_SENT = _CALENDAR + """, sent AS (SELECT *, title LIKE '%7' AND action IN ('insert', 'update') AS blank, regexp_extract(title, '[0-9]+')::BIGINT % 100 = 3 AND action IN ('update', 'delete') AS lost FROM plan WHERE action <> 'noop')
"""


@_query(_SENT + """SELECT action, title, NOT blank AND NOT lost AS ok, CASE WHEN lost THEN action || ' without an id' WHEN blank THEN action || ' without a summary' END AS error FROM sent""")
def sent_outcomes(spark, sf_dir):
    plan = _incremental(spark, sf_dir)[1]
    blank = F.col("title").endswith("7") & F.col("action").isin("insert", "update")
    lost = (F.regexp_extract("title", "[0-9]+", 0).cast("long") % 100 == 3) & F.col("action").isin("update", "delete")
    payload = F.when(blank, F.col("payload").withField("summary", F.lit(" "))).otherwise(F.col("payload"))
    plan = plan.withColumn("payload", payload).withColumn("remote_id", F.when(~lost, F.col("remote_id")))
    folder = files.shared_folder(spark, "outbox")
    for _ in range(2):  # the second run of a token sends nothing
        outcomes = outbox.send(plan, folder, "run-1")
    return outcomes.select("action", "title", "ok", "error")


_OVERLAP = """((all_day AND day > '{0}' AND day <= '{1}') OR (NOT all_day AND day >= '{0}' AND day <= '{1}'))"""


@_query(_CALENDAR + f"""SELECT 'delete' AS action, title, day AS start_date, id AS remote_id, NULL AS location FROM remote WHERE {_OVERLAP.format('1996-01-01', '1996-12-31')}
  UNION ALL SELECT 'insert', title, day, NULL, location FROM event""")
def sync_full_replace(spark, sf_dir):
    p = sync.sync(*_calendar(spark, sf_dir), sync.SyncConfig(SyncMode.FULL_REPLACE, "1996-01-01", "1996-12-31"))
    return p.select("action", "title", "start_date", "remote_id", F.col("payload.location").alias("location"))


@_query(_CALENDAR + f"""SELECT 'delete' AS action, count(*) AS n FROM remote WHERE {_OVERLAP.format('1995-06-01', '1996-06-30')}
  UNION ALL SELECT 'insert', count(*) FROM event""")
def full_replace_range(spark, sf_dir):
    remote, events = _calendar(spark, sf_dir)
    return sync.full_replace(sync.remote_in_range(remote, "1995-06-01", "1996-06-30"), events).groupBy("action").agg(F.count("*").alias("n"))


@_query(_CALENDAR + """SELECT title, day AS start_date, day AS end_date, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN left(end_time, 5) WHEN 2 THEN '09:00' ELSE '09:00 ~ ' || left(end_time, 5) END AS time,
  coalesce(nullif(location, ''), '-') AS location, CASE WHEN k % 3 = 0 THEN '-' ELSE mail || ', b@x' END AS attendees FROM event""")
def display_rows(spark, sf_dir):
    k = F.col("row_no") % 5
    events = _calendar(spark, sf_dir)[1].withColumns({
        "start_time": F.when(~k.isin(0, 1), F.col("start_time")),
        "end_time": F.when(k == 0, "").when(k != 2, F.col("end_time")),
        "attendees": F.when(F.col("row_no") % 3 != 0, F.array_append("attendees", F.lit("b@x"))),
    })
    return reconcile.display(events)


@_query("SELECT '1996-05-01' AS range_start, strftime(max(o_orderdate), '%Y-%m-%d') AS range_end FROM orders")
def range_defaults(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("start_date"), F.to_date("o_orderdate").alias("end_date"))
    return reconcile.range_defaults(orders, "1996-05-01", "")


@_query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 100 AS c, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
remote AS (SELECT 'r' || lpad(k::VARCHAR, 9, '0') AS id, 'C' || c AS title, left(day, 7) || '-01' AS start_day,
  left(day, 7) || '-01T' || CASE k % 3 WHEN 0 THEN '08' WHEN 1 THEN '09' ELSE '10' END || ':00:00+09:00' AS began FROM o),
last AS (SELECT * FROM remote QUALIFY row_number() OVER (PARTITION BY title, start_day ORDER BY began DESC, id DESC) = 1)
SELECT 'delete' AS action, title, start_day AS start_date, id AS remote_id FROM last""")
def last_of_remote(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 100).cast("string").alias("c"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    hour = F.when(F.col("k") % 3 == 0, "08").when(F.col("k") % 3 == 1, "09").otherwise("10")
    moment = F.struct(F.concat("month", F.lit("-01T"), hour, F.lit(":00:00+09:00")).alias("dateTime"), F.lit(None).cast("string").alias("date"), F.lit("Asia/Seoul").alias("timeZone"))
    none = F.lit(None).cast("string")
    remote = o.select(F.concat(F.lit("r"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("id"), F.concat(F.lit("C"), "c").alias("summary"), none.alias("description"), none.alias("location"), moment.alias("start"), moment.alias("end"), F.array().cast("array<struct<email:string>>").alias("attendees"))
    events = _calendar(spark, sf_dir)[1].where("false")
    return reconcile.event_plan(remote, events).select("action", "title", "start_date", "remote_id")


@_query(_SNAPSHOTS + "SELECT o_orderkey, action, old_priority, new_priority FROM plan")
def reconcile_by_digest(spark, sf_dir):
    p = reconcile.diff_by_digest(*_snapshots(spark, sf_dir), ["o_orderkey"], ["o_orderpriority", "o_totalprice"], 64)
    return p.select("o_orderkey", "action", F.col("ex.o_orderpriority").alias("old_priority"), F.col("nw.o_orderpriority").alias("new_priority"))


_SERIES = """
WITH RECURSIVE series AS (SELECT o_orderkey AS id, o_orderdate::DATE AS first, ['daily', 'weekly', 'monthly', 'yearly'][(o_orderkey % 4 + 1)::INT] AS freq, (o_custkey % 3 + 1)::INT AS every,
  CASE WHEN o_orderkey % 5 = 0 THEN DATE '1998-03-15' END AS until, CASE WHEN o_orderkey % 3 = 0 THEN 20 END AS times FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'),
step AS (
  SELECT id, first, freq, every, until, times, 0 AS n, first AS day, 1 AS nth FROM series
  UNION ALL
  SELECT id, first, freq, every, until, times, n + 1, d, nth + CASE WHEN dayofmonth(d) = dayofmonth(first) OR freq IN ('daily', 'weekly') THEN 1 ELSE 0 END
  FROM (SELECT *, CASE freq WHEN 'daily' THEN first + ((n + 1) * every)::INT WHEN 'weekly' THEN first + ((n + 1) * every * 7)::INT
          WHEN 'monthly' THEN (first + to_months((n + 1) * every))::DATE ELSE (first + to_months((n + 1) * every * 12))::DATE END AS d FROM step)
  WHERE d <= DATE '1998-06-30' AND d <= coalesce(until, DATE '1998-06-30'))
"""


@_query(_SERIES + """SELECT id, day AS occurrence FROM step WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AND day <= coalesce(until, day)
  AND (freq IN ('daily', 'weekly') OR dayofmonth(day) = dayofmonth(first)) AND nth <= coalesce(times, nth) AND NOT (id % 2 = 0 AND dayofmonth(day) = 7)""")
def recurring_in_range(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz'1998-06-01 00:00:00'")
    k = F.col("o_orderkey")
    freq = F.element_at(F.array(*map(F.lit, recurrence.EVERY)), (k % 4 + 1).cast("int"))
    series = o.select(k.alias("id"), F.to_date("o_orderdate").alias("first"), freq.alias("freq"), (F.col("o_custkey") % 3 + 1).cast("int").alias("every"), F.when(k % 5 == 0, F.lit("1998-03-15").cast("date")).alias("until"), F.when(k % 3 == 0, 20).alias("times"))
    sevenths = F.array(*[F.lit(f"1998-0{m}-07").cast("date") for m in range(1, 7)])
    off = o.where("o_orderkey % 2 = 0").select(k.alias("id"), F.explode(sevenths).alias("occurrence"))
    return recurrence.occurrences(series, "1998-01-01", "1998-06-30", off).select("id", "occurrence")


@_query(_CALENDAR + f"SELECT id FROM remote WHERE {_OVERLAP.format('1998-01-01', '1998-12-31')}")
def range_scan(spark, sf_dir):
    return sync.remote_in_range(_calendar(spark, sf_dir)[0], "1998-01-01", "1998-12-31").select("id")


@_query("""SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1""")
def last_write_wins(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return keys.last_write_wins(events, ["user_id", "event_type"], "ts", "event_id").drop("ts")


_REMOTE = """
WITH remote AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE ' ' || chr(9) || o_orderpriority || chr(160) || chr(10) END AS summary,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+09:00' END AS stamp, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
"""


@_query(_REMOTE + "SELECT o_orderkey, trim(coalesce(summary, ''), ' ' || chr(9) || chr(10) || chr(160)) AS title, left(coalesce(nullif(stamp, ''), day, ''), 10) AS start_date, left(coalesce(nullif(stamp, ''), day, ''), 10) AS end_date FROM remote")
def match_key(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    at = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
    moment = F.struct(at.alias("dateTime"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    summary = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\u00a0\n")))
    return orders.select("o_orderkey", summary.alias("summary"), moment.alias("start"), moment.alias("end")).select("o_orderkey", *keys.remote_key())


@_query("""SELECT o_orderkey, o_orderpriority AS summary, '' AS description, o_orderstatus AS location,
  strftime(o_orderdate, '%Y-%m-%d') || 'T' || CASE WHEN o_orderkey % 2 = 0 THEN '09:30:00' ELSE '00:00:00' END AS start_at,
  strftime(o_orderdate, '%Y-%m-%d') || 'T23:59:59' AS end_at, 'Asia/Seoul' AS zone, 'c' || o_custkey || '@x' AS mail, 1 AS people FROM orders""")
def to_payload(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    rows = o.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("title"),
        F.to_date("o_orderdate").alias("start_date"),
        F.to_date("o_orderdate").alias("end_date"),
        F.lit(None).cast("string").alias("description"),
        F.col("o_orderstatus").alias("location"),
        F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@x"))).alias("attendees"),
        F.when(F.col("o_orderkey") % 2 == 0, "09:30:00").alias("start_time"),
        F.lit("").alias("end_time"),
    )
    p = rows.select("o_orderkey", reconcile.remote_payload().alias("p"))
    return p.select("o_orderkey", "p.summary", "p.description", "p.location", F.col("p.start.dateTime").alias("start_at"), F.col("p.end.dateTime").alias("end_at"), F.col("p.start.timeZone").alias("zone"), F.col("p.attendees")[0]["email"].alias("mail"), F.size("p.attendees").alias("people"))


@_query("""WITH l AS (SELECT user_id, list(event_type ORDER BY event_id) AS a, list(event_type ORDER BY event_id DESC) AS b FROM events GROUP BY user_id)
SELECT user_id, list_sort(a) = list_sort(b) AS equal, len(a)::INT AS n FROM l""")
def sorted_list_equal(spark, sf_dir):
    pairs = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("a"))
    return pairs.select("user_id", (F.array_sort("a") == F.array_sort(F.reverse("a"))).alias("equal"), F.size("a").alias("n"))


# -- parsing -------------------------------------------------------------------


@_query("SELECT o_orderkey, o_orderdate::DATE AS parsed FROM orders")
def parse_dates(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    # Month first wins, so day-first forms are used where they can't be misread.
    late = F.dayofmonth("o_orderdate") > 12
    forms = ["yyyy-M-d", "yyyy/MM/dd", "MM/dd/yyyy", "M-d-yyyy", "yyyy.M.d", "yyyyMMdd", "yyyy-MM-dd HH:mm:ss", "MM.dd.yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy/MM/dd HH:mm:ss", "M/d/yyyy H:mm"]
    forms += ["dd-MMM-yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d yyyy", "EEEE, MMMM d, yyyy", "EEE d MMM yyyy h:mm a", "yyyy-MM-dd'T'HH:mm:ss'+0900'", "yyyy-MM-dd'T'HH:mm'Z'", "M/d/yy", "d/MMM/yy", "yyyy-MMM-dd", "yyyyMMdd'T'HHmmss"]
    n = F.col("o_orderkey") % (len(forms) + 3)
    shown: Column = F.date_format("o_orderdate", "yyyy-MM-dd")
    for i, f in enumerate(forms):
        shown = F.when(n == i, F.date_format("o_orderdate", f)).otherwise(shown)
    shown = F.when((n == len(forms)) & late, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(shown)
    shown = F.when((n == len(forms) + 1) & late, F.date_format("o_orderdate", "d.M.yyyy")).otherwise(shown)
    return orders.select("o_orderkey", parsing.date(F.concat(F.lit(" "), shown, F.lit(" "))).alias("parsed"))


@_query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN strftime(ts, '%H:%M:00') WHEN 3 THEN strftime(ts, '%H:%M:00') ELSE strftime(ts, '%H:%M:%S') END AS parsed FROM events")
def parse_times(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    shown: Column = F.date_format("ts", "HH:mm:ss")
    for i, f in ((1, "H:m"), (2, "hh:mm:ss a"), (3, "h:mm  a")):
        shown = F.when(F.col("event_id") % 4 == i, F.date_format("ts", f)).otherwise(shown)
    return e.select("event_id", parsing.time(shown).alias("parsed"))


@_query("""SELECT doc_id, CASE WHEN len(p) > 0 THEN len(p)::INT END AS people FROM (SELECT doc_id,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[,\\n;]+'), lambda x: contains(x, '@')) AS p FROM documents)""")
def split_list(spark, sf_dir):
    people = parsing.people(F.col("text"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.when(people.isNotNull(), F.size(people)).alias("people"))


@_query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'title is required' WHEN event_id % 7 = 0 THEN 'bad start_date'
  WHEN event_id % 11 = 0 THEN 'bad end_date' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY reason""")
def row_rejects(spark, sf_dir):
    return ingest.sheet_events(_grid(spark, sf_dir), "events")[1].groupBy("reason").agg(F.count("*").alias("n"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("제목"),
        F.when(F.col("event_id") % 7 != 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon").alias("Start-Date"),
        F.when(F.col("event_id") % 11 != 0, F.date_format("ts", "MM/dd/yyyy")).alias("종료일"),
        F.lit("not read").alias("Name"),
        F.lit("nor this").alias("to"),
        F.col("event_id").alias("_row_no"),
    )


_REJECTS = """WITH r AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'title is required' WHEN event_id % 7 = 0 THEN 'bad start_date'
  WHEN event_id % 11 = 0 THEN 'bad end_date' END AS reason FROM events)"""


@_query(_REJECTS + "SELECT 'Sheet ''events'' Row ' || event_id || ': ' || reason AS error FROM r WHERE reason IS NOT NULL UNION ALL SELECT 'Sheet ''bare'': missing required columns: start_date, end_date'")
def reject_list(spark, sf_dir):
    bare = ingest.sheet_events(_read(spark, sf_dir, "nation").select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("_row_no")), "bare", 1)[1]
    empty = ingest.sheet_events(_read(spark, sf_dir, "nation").where("n_nationkey < 0").select(F.col("n_name").alias("title"), F.col("n_nationkey").alias("_row_no")), "empty", 2)[1]
    rejects = ingest.sheet_events(_grid(spark, sf_dir), "events")[1].unionByName(bare).unionByName(empty)
    return ingest.messages(rejects)


@_query(_REJECTS + "SELECT false AS success, count(*) FILTER (reason IS NULL) AS events_processed, count(reason) AS errors FROM r")
def sheet_outcome(spark, sf_dir):
    return ingest.judged_outcome(ingest.sheet_rows(_grid(spark, sf_dir), "events")[0])


@_query("""SELECT event_id AS ordinal, event_type AS title, ts::DATE AS start_date, ts::DATE AS end_date FROM events WHERE event_id % 5 <> 0""")
def sheet_ingest(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyy.MM.dd")
    grid = e.select(F.when(F.col("event_id") % 5 != 0, F.concat(F.lit(" "), "event_type")).alias("Subject"), day.alias("FROM"), day.alias("to"), F.col("event_id").alias("_row_no"))
    return ingest.sheet_events(grid, "events")[0].select(F.col("ordinal.row").alias("ordinal"), "title", "start_date", "end_date")


# Every customer as a sheet with two rows: four kinds of headers, one plan.

_HEADS = [["Title", "From", "to", "Name"], ["메모", "종료일", " Start-Date ", "제목", "details"], ["subject", "date", "date", "Where"], ["Event", "from", "까지"]]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    row = lambda n, cells: F.struct(F.lit(n).cast("long").alias("row_no"), cells.alias("cells"))
    text = lambda cells: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in cells])
    kind = F.col("k") % 4
    head = F.when(kind == 0, text(_HEADS[0])).when(kind == 1, text(_HEADS[1])).when(kind == 2, text(_HEADS[2])).otherwise(text(_HEADS[3]))
    one = F.when(kind == 0, text([F.col("c_name"), "2026-09-01", "9/2/2026", "not read"])).when(kind == 1, text([F.col("c_mktsegment"), "2026-09-02", "2026-09-01", F.col("c_name"), "not read"])).otherwise(text([F.col("c_name"), "1 Sep 2026", "2026-09-02"]))
    two = F.when(kind == 0, text(["", "2026-09-01"])).otherwise(text([F.col("c_name")]))
    rows = F.when(F.col("k") % 20 == 3, F.array(row(1, head))).otherwise(F.array(row(1, head), row(2, one), row(3, two)))
    return c.select(F.concat(F.lit("b"), (F.col("k") % 10).cast("string")).alias("path"), F.col("k").cast("int").alias("sheet_no"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("sheet_name"), F.inline(rows))


@_query("""SELECT 's' || k AS sheet_name, field, pos::INT AS position FROM (SELECT c_custkey AS k, unnest(CASE c_custkey % 4 WHEN 0 THEN ['title', 'start_date', 'end_date'] WHEN 1 THEN ['title', 'start_date', 'end_date', 'description']
    WHEN 2 THEN ['title', 'start_date', 'location'] ELSE ['title', 'start_date', 'end_date'] END) AS field,
  unnest(CASE c_custkey % 4 WHEN 0 THEN [0, 1, 2] WHEN 1 THEN [3, 2, 1, 0] WHEN 2 THEN [0, 1, 3] ELSE [0, 1, 2] END) AS pos FROM customer)""")
def header_positions(spark, sf_dir):
    return ingest.field_positions(ingest.sheet_heads(_cells(spark, sf_dir))).select("sheet_name", "field", "position")


@_query("""SELECT 's' || c_custkey AS sheet_name, CASE c_custkey % 4 WHEN 0 THEN 'further column for title: Name' ELSE 'further column for description: details' END AS warning
FROM customer WHERE c_custkey % 4 < 2""")
def header_warnings(spark, sf_dir):
    return ingest.cell_rows(_cells(spark, sf_dir))[1]


@_query("""SELECT 's' || c_custkey AS sheet_name, 2 AS row_no, c_name AS title, DATE '2026-09-01' AS start_date, DATE '2026-09-02' AS end_date, CASE WHEN c_custkey % 4 = 1 THEN c_mktsegment END AS description
FROM customer WHERE c_custkey % 4 <> 2 AND c_custkey % 20 <> 3""")
def cell_ingest(spark, sf_dir):
    return ingest.cell_events(_cells(spark, sf_dir))[0].select("sheet_name", "row_no", "title", "start_date", "end_date", "description")


@_query("""SELECT 'Sheet ' || chr(39) || 's' || c_custkey || chr(39) || CASE c_custkey % 4 WHEN 0 THEN ' Row 3: title is required' WHEN 2 THEN ': missing required columns: end_date' WHEN 1 THEN ' Row 3: title is required' ELSE ' Row 3: bad start_date' END AS error
FROM customer WHERE c_custkey % 20 <> 3""")
def cell_rejects(spark, sf_dir):
    return ingest.messages(ingest.cell_events(_cells(spark, sf_dir))[1])


@_query(_REJECTS + """SELECT 'dirty' AS sheet, false AS accepted, count(*) FILTER (reason IS NULL) AS events, count(reason) AS rejects, 0 AS published FROM r
  UNION ALL SELECT 'clean', true, count(*) FILTER (reason IS NULL), 0, count(*) FILTER (reason IS NULL) FROM r""")
def staged_outcomes(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    folder = files.shared_folder(spark, "publish")
    dirty = ingest.stage(ingest.sheet_rows(grid, "dirty")[0])
    clean = ingest.stage(ingest.sheet_rows(grid.where("_row_no % 5 <> 0 and _row_no % 7 <> 0 and _row_no % 11 <> 0"), "clean")[0])
    published = ingest.publish(clean, f"{folder}/events")
    said = lambda rows, name, s: rows.select(F.lit(name).alias("sheet"), F.lit(s.accepted).alias("accepted"), F.lit(s.events).alias("events"), F.lit(s.rejects).alias("rejects"), "published")
    none = spark.range(1).select(F.lit(0).cast("long").alias("published"))
    return said(none, "dirty", dirty).unionByName(said(published.agg(F.count("*").alias("published")), "clean", clean))


@_query("""SELECT c_custkey, regexp_full_match(u, '[a-zA-Z0-9@._-]+') AS user_ok, regexp_full_match(u, '[a-zA-Z0-9@._+-]+') AS mail_ok
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '.') ELSE replace(c_name, '#', '+') END AS u FROM customer)""")
def id_regex(spark, sf_dir):
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, F.col("c_name")).when(k == 1, F.replace("c_name", F.lit("#"), F.lit("."))).otherwise(F.replace("c_name", F.lit("#"), F.lit("+")))
    rows = _read(spark, sf_dir, "customer").select("c_custkey", name.alias("u"))
    return rows.select("c_custkey", parsing.valid_user_id(F.col("u")).alias("user_ok"), parsing.valid_email(F.col("u")).alias("mail_ok"))


@_query("""SELECT page_id, nullif(regexp_extract(CASE WHEN page_id % 2 = 0 THEN 'https://x/spreadsheets/d/k_' || page_id || '-z/edit' ELSE url END, '/d/([A-Za-z0-9_-]+)', 1), '') AS sheet
FROM pages""")
def url_id(spark, sf_dir):
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://x/spreadsheets/d/k_"), F.col("page_id").cast("string"), F.lit("-z/edit"))).otherwise(F.col("url"))
    return _read(spark, sf_dir, "pages").select("page_id", parsing.spreadsheet_id(url).alias("sheet"))


@_query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, chr(0), ''), '\\', '\\\\'), '''', ''''''), chr(13), ' '), chr(10), ' ')) AS digest FROM documents""")
def sql_escape(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(parsing.sql_escape(F.col("text"))).alias("digest"))


# -- state ---------------------------------------------------------------------


@_query("""SELECT session_id, user_id, ts AS created_at, ts + INTERVAL 24 HOUR AS expires_at FROM (SELECT 's' || event_id AS session_id, user_id, ts FROM events WHERE event_id % 2 = 0)
UNION ALL SELECT 's' || event_id, user_id, TIMESTAMP '2024-01-15 12:00:00', TIMESTAMP '2024-01-16 12:00:00' FROM events WHERE event_id % 2 = 1""")
def session_insert(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_id"), "user_id", F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL '24' HOUR")).alias("expires_at"), "event_id")
    old = e.where("event_id % 2 = 0").drop("event_id")
    return state.insert_session(old, e.where("event_id % 2 = 1").select("session_id", "user_id"), _NOW(F.lit(_AT)))


def _web_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    ids = F.concat(F.lit("s"), F.col("event_id").cast("string"))
    return e.select(ids.alias("session_id"), F.concat(F.lit("u"), u).alias("user_id"), F.concat(u, F.lit("@x")).alias("email"), F.col("event_type").alias("name"), F.md5(ids).alias("oauth_state"), (F.col("value") > 50).alias("sheets_mode"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL '24' HOUR")).alias("expires_at"))


@_query("""SELECT 'u' || user_id AS user_id, user_id || '@x' AS email, event_type AS name, md5('s' || event_id) AS oauth_state, value > 50 AS sheets_mode FROM events""")
def session_subset(spark, sf_dir):
    return state.session_view(_web_sessions(spark, sf_dir))


@_query("""WITH s AS (SELECT 's' || event_id AS session_id, 'u' || user_id AS user_id, user_id || '@x' AS email, event_type AS name, md5('s' || event_id) AS oauth_state, value > 50 AS sheets_mode, ts + INTERVAL 24 HOUR AS expires_at, ts FROM events)
SELECT user_id, email, name, oauth_state, sheets_mode FROM s WHERE expires_at > TIMESTAMP '2024-01-15 12:00:00' AND session_id IN ('s' || (SELECT max(event_id) FROM events WHERE ts > TIMESTAMP '2024-01-20'), 's' || (SELECT min(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-10'))""")
def session_live(spark, sf_dir):
    # One session that is live, and one that has expired: found by its id, not given out.
    e = _read(spark, sf_dir, "events")
    found = e.agg(F.max(F.when(F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz"), F.col("event_id"))), F.min(F.when(F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz"), F.col("event_id")))).first()
    live, gone = (state.session(_web_sessions(spark, sf_dir), f"s{i}", _NOW(F.lit(_AT))) for i in found)
    return live.unionByName(gone)


@_query("SELECT event_id, CASE WHEN value > 50 THEN 'TRUE' ELSE 'FALSE' END AS flag FROM events")
def boolean_text(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", parsing.boolean_text(F.col("value") > 50).alias("flag"))


@_query(f"SELECT event_id, user_id FROM events WHERE NOT ts + INTERVAL 24 HOUR < TIMESTAMP '{'2024-01-15 12:00:00'}'")
def expired_kept(spark, sf_dir):
    return state.purge(_sessions(spark, sf_dir), _NOW(F.lit(_AT)))[0].select("event_id", "user_id")


@_query("""
WITH t AS (SELECT c_custkey, c_name, c_acctbal, 'old' AS created FROM customer WHERE c_custkey % 4 <> 0),
s AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE upper(c_name) END AS c_name, c_acctbal, 'new' AS created FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE t.c_name END AS c_name,
       coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, coalesce(t.created, s.created) AS created
FROM t FULL OUTER JOIN s ON t.c_custkey = s.c_custkey""")
def upsert_merge(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = c.where("c_custkey % 4 <> 0").withColumn("created", F.lit("old"))
    name = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.upper("c_name"))
    return state.upsert(target, c.where("c_custkey % 3 = 0").withColumn("c_name", name).withColumn("created", F.lit("new")), "c_custkey", keep=["created"])


@_query("SELECT c_custkey, CASE WHEN c_custkey = 42 THEN 'renamed' ELSE c_name END AS c_name FROM customer")
def update_by_key(spark, sf_dir):
    return state.update_by_key(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 42, {"c_name": "renamed"})


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IS DISTINCT FROM 42")
def delete_by_key(spark, sf_dir):
    return state.delete_by_key(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 42)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL '24' HOUR")).alias("expires_at"))


_NOW = F.to_timestamp_ntz
_AT = "2024-01-15 12:00:00"


@_query(f"SELECT event_id, user_id FROM events WHERE ts + INTERVAL 24 HOUR > TIMESTAMP '{_AT}'")
def ttl_live(spark, sf_dir):
    return state.live(_sessions(spark, sf_dir), _NOW(F.lit(_AT))).select("event_id", "user_id")


@_query(f"SELECT count(*) AS purged FROM events WHERE ts + INTERVAL 24 HOUR < TIMESTAMP '{_AT}'")
def ttl_expired_count(spark, sf_dir):
    return state.purge(_sessions(spark, sf_dir), _NOW(F.lit(_AT)))[1]


@_query(f"SELECT event_id FROM events WHERE ts + INTERVAL 24 HOUR < TIMESTAMP '{_AT}' + INTERVAL 5 MINUTE")
def expiring_soon(spark, sf_dir):
    return state.expiring_soon(_sessions(spark, sf_dir), "expires_at", _NOW(F.lit(_AT))).select("event_id")


@_query("SELECT * FROM customer WHERE c_custkey = 77")
def point_lookup(spark, sf_dir):
    return state.point_lookup(_read(spark, sf_dir, "customer"), "c_custkey", 77)


@_query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return state.repeated_keys(_read(spark, sf_dir, "events"), "user_id")


# -- keyed tables: buckets of files, rewritten where they are touched ---------------


@_query("""
WITH t AS (SELECT c_custkey, c_name, c_acctbal, 'old' AS created FROM customer WHERE c_custkey % 4 <> 0),
s AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal, 'new' AS created FROM customer WHERE c_custkey % 100 = 0)
SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, coalesce(t.created, s.created) AS created
FROM t FULL OUTER JOIN s ON t.c_custkey = s.c_custkey WHERE coalesce(s.c_custkey, t.c_custkey) % 100 <> 7""")
def keyed_table(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    t = store.KeyedTable(spark, files.shared_folder(spark, "table")).create(c.where("c_custkey % 4 <> 0").withColumn("created", F.lit("old")), "c_custkey", 16, unique=["c_name"])
    source = c.where("c_custkey % 100 = 0").withColumn("c_name", F.upper("c_name")).withColumn("created", F.lit("new"))
    for _ in range(2):  # the second time changes nothing
        t.upsert(source, keep=["created"], token="one")
    t.delete(c.where("c_custkey % 100 = 7").select("c_custkey"))
    return t.read()


@_query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (5, 77, 140)")
def keyed_lookup(spark, sf_dir):
    t = store.KeyedTable(spark, files.shared_folder(spark, "table")).create(_read(spark, sf_dir, "customer"), "c_custkey", 16)
    return t.lookup(5, 77, 140, -1).select("c_custkey", "c_name")


@_query(_CALENDAR + """SELECT r.id, CASE WHEN action = 'update' THEN new_location ELSE location END AS location FROM remote r JOIN plan ON r.id = remote_id WHERE action <> 'delete'
UNION ALL SELECT sha256(title || chr(31) || day || chr(31) || day), new_location FROM plan WHERE action = 'insert'""")
def applied_table(spark, sf_dir):
    remote, plan = _incremental(spark, sf_dir)
    t = store.KeyedTable(spark, files.shared_folder(spark, "table")).create(remote, "id", 16)
    for _ in range(2):  # applying the same plan again changes nothing
        t.apply(plan)
    return t.read().select("id", "location")


@_query("""SELECT 'u' || c_custkey AS user_id, 'u' || c_custkey || '@x' AS email, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'r' || c_custkey END AS refresh_token, c_custkey % 50 = 0 AS renewed FROM customer WHERE c_custkey % 3 <> 1""")
def stored_tokens(spark, sf_dir):
    """The tokens of users: a key, a unique e-mail, and an upsert that keeps when
    a row was made but not its refresh token."""
    c, at = _read(spark, sf_dir, "customer").where("c_custkey % 3 <> 1"), lambda text: F.lit(text).cast("timestamp")
    user = F.concat(F.lit("u"), F.col("c_custkey").cast("string"))

    def rows(of: DataFrame, refresh: Column, when: str) -> DataFrame:
        cells = [user.alias("user_id"), F.concat(user, F.lit("@x")).alias("email"), F.lit("a").alias("access_token"), refresh.alias("refresh_token"), at("2026-01-01 00:00:00").alias("token_expiry"), F.array(F.lit("calendar")).alias("scopes"), at(when).alias("created_at"), at(when).alias("updated_at")]
        return of.select(*cells).to(StructType.fromDDL(USER_TOKENS.replace(" not null", "")))

    t = store.KeyedTable(spark, files.shared_folder(spark, "tokens")).create(rows(c, F.concat(F.lit("r"), F.col("c_custkey").cast("string")), "2025-01-01"), "user_id", 16, unique=["email"])
    t.upsert(rows(c.where("c_custkey % 50 = 0"), F.lit(""), "2025-06-01"), keep=["created_at"])
    renewed = (F.col("updated_at") > F.col("created_at")) & (F.col("created_at") == at("2025-01-01"))
    return t.read().select("user_id", "email", "refresh_token", renewed.alias("renewed"))


# -- SQL text, chunks, pages ---------------------------------------------------


@_query("SELECT to_json(nation)::VARCHAR AS json FROM nation")
def rows_as_json(spark, sf_dir):
    return sqltext.rows_as_json(_read(spark, sf_dir, "nation"))


@_query("SELECT n_nationkey || '|' || n_name || '|' || n_regionkey AS line FROM nation")
def rows_as_text(spark, sf_dir):
    return sqltext.rows_as_text(_read(spark, sf_dir, "nation"))


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_lines(spark, sf_dir):
    return sqltext.json_lines(sqltext.rows_as_json(_read(spark, sf_dir, "nation")), "n_nationkey int, n_name string, n_regionkey int")


@_query("""SELECT o_orderkey, '{"' || o_orderstatus || '","' || o_orderpriority || '"}' AS literal FROM orders""")
def array_text(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", parsing.array_literal(F.array("o_orderstatus", "o_orderpriority")).alias("literal"))


@_query("SELECT k, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = k) AS found FROM (VALUES (3), (99)) t(k)")
def row_exists(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    some, none = (sqltext.row_exists(nation.where(F.col("n_nationkey") == k)).select(F.lit(k).alias("k"), "found") for k in (3, 99))
    return some.unionByName(none)


@_query("SELECT name, name IN ('nation', 'customer', 'orders') AS found, n FROM (SELECT 'driftline_' || t AS label, t AS name, n FROM (SELECT 'nation' AS t, count(*) AS n FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'absent', NULL))")
def table_exists(spark, sf_dir):
    names = ["nation", "customer", "orders", "absent"]
    for name in names[:-1]:
        _read(spark, sf_dir, name).createOrReplaceTempView(f"driftline_{name}")
    return reduce(DataFrame.unionByName, [sqltext.table_rows(spark, f"driftline_{n}").select(F.lit(n).alias("name"), "found", "n") for n in names])


@_query("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY n_regionkey")
def statement(spark, sf_dir):
    _read(spark, sf_dir, "nation").createOrReplaceTempView("driftline_nation")
    sqltext.execute(spark, "CREATE OR REPLACE TEMPORARY VIEW driftline_small AS SELECT * FROM driftline_nation WHERE n_nationkey < 20")
    return sqltext.rows(spark, "SELECT n_regionkey, count(*) AS n FROM driftline_small WHERE n_nationkey >= :low GROUP BY n_regionkey", {"low": 0})


# -- sources: fixtures are written to the shared folder and read back ------------


@_query("""SELECT event_id AS ordinal, event_type AS title, ts::DATE AS start_date, strftime(ts, '%H:%M:%S') AS start_time,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'room' || chr(10) || user_id END AS location FROM events WHERE event_id % 5 <> 0""")
def grid_ingest(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    place = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.concat(F.lit("room\n"), F.col("user_id").cast("string")))
    grid_ = e.select(
        F.col("event_id").alias("_row_no"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("Event"),
        F.date_format("ts", "M/d/yyyy").alias("Start Date"),
        F.date_format("ts", "yyyy-MM-dd").alias("End\tDate"),
        F.date_format("ts", "h:mm:ss a").alias("start-time"),
        place.alias("Where"),
    )
    path = files.shared_folder(spark, "fixture")
    grid_.write.csv(path, header=True)
    back = grid.csv_grid(spark, path)
    events = ingest.sheet_events(back.withColumn("_row_no", F.col("_row_no").cast("long")), "events")[0]
    return events.select(F.col("ordinal.row").alias("ordinal"), "title", "start_date", "start_time", "location")


@_query("SELECT o_orderkey AS row_no, 'T' || o_custkey AS title, o_orderdate::DATE AS start_date, o_orderdate::DATE + 1 AS end_date FROM orders WHERE o_orderkey % 9 <> 0")
def parquet_ingest(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    path = files.shared_folder(spark, "fixture")
    title = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("T"), F.col("o_custkey").cast("string")))
    o.select(F.col("o_orderkey").alias("_row_no"), title.alias("일정"), F.to_date("o_orderdate").alias("From"), F.date_add("o_orderdate", 1).alias("End Date")).write.parquet(path)
    back = grid.parquet_grid(spark, path)
    return ingest.sheet_events(back.withColumn("_row_no", F.col("_row_no").cast("long")), "orders")[0].select("row_no", "title", "start_date", "end_date")


#: Rows of a workbook: its sheets stay far below the million rows that Excel
#: has room for, and workbooks, each written by a task, grow in number with the table.
WORKBOOK_ROWS = 125_000


def _workbooks(spark: SparkSession, sf_dir: str) -> str:
    """Four workbooks, or four of every so many rows, written by tasks, of sheets
    with different headers, one without rows, and a damaged file beside them. A
    sheet's name is in every fourth workbook, with its header."""
    e = _read(spark, sf_dir, "events")
    fours = max(1, -(-e.count() // (4 * WORKBOOK_ROWS)))
    k, day = F.col("event_id"), F.datediff("ts", F.lit("1904-01-01").cast("date")).cast("string")
    sheet = lambda kind: F.concat(F.lit("B"), (k % 4).cast("string"), F.lit(kind))
    texts = lambda *x: F.array(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    title = F.when(k % 7 != 0, F.concat("event_type", F.lit(" <&>")))
    book = (F.pmod(F.xxhash64(k), F.lit(fours)) * 4 + k % 4).cast("int").alias("book")
    one = e.where("event_id % 3 = 0").select(book, sheet("one").alias("sheet_name"), k.alias("n"), texts(title, day, "9/30/2026", F.date_format("ts", "H:mm")).alias("cells"), texts("s", "d", "s", "s").alias("kinds"))
    two = e.where("event_id % 3 > 0").select(book, sheet("two").alias("sheet_name"), k.alias("n"), texts(day, F.col("event_type"), day, F.col("user_id").cast("string"), "x").alias("cells"), texts("d", "s", "d", "n", "s").alias("kinds"))
    heads = []
    for kind, names in (("one", ["Title", "From", "To", "Start Time"]), ("two", ["종료일", "제목", "DATE", "where", "Name"]), ("three", ["Title", "date"])):
        heads.append(spark.range(4 * fours).select(F.col("id").cast("int").alias("book"), F.concat(F.lit("B"), (F.col("id") % 4).cast("string"), F.lit(kind)).alias("sheet_name"), F.lit(-1).cast("long").alias("n"), texts(*names).alias("cells"), texts(*["s"] * len(names)).alias("kinds")))
    rows = reduce(DataFrame.unionByName, [one, two, *heads])
    path = files.shared_folder(spark, "fixture")
    xlsx.save_workbooks(rows.repartitionById(4 * fours, F.col("book")).sortWithinPartitions("sheet_name", "n").select("sheet_name", "cells", "kinds"), path, from_1904=True)
    with files.open_write(f"{path}/damaged.xlsx") as f:
        f.write(b"PK no workbook")
    return path


@_query("""SELECT event_type || CASE WHEN event_id % 3 = 0 THEN ' <&>' ELSE '' END AS title, ts::DATE AS start_date, 'B' || (event_id % 4) || CASE WHEN event_id % 3 = 0 THEN 'one' ELSE 'two' END AS sheet_name,
  CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M:00') END AS start_time, CASE WHEN event_id % 3 > 0 THEN user_id::VARCHAR END AS location FROM events WHERE event_id % 21 <> 0""")
def xlsx_ingest(spark, sf_dir):
    path = _workbooks(spark, sf_dir)
    events = ingest.cell_events(xlsx.xlsx_cells(spark, path), xlsx.xlsx_heads(spark, path))[0]
    return events.select("title", "start_date", "sheet_name", "start_time", "location")


@_query("""SELECT 'B' || b || 'two' AS sheet_name, count(*) + 1 AS n FROM (SELECT event_id % 4 AS b FROM events WHERE event_id % 3 > 0) WHERE b = 2 GROUP BY b
UNION ALL SELECT 'unreadable', 1""")
def xlsx_one_sheet(spark, sf_dir):
    path = _workbooks(spark, sf_dir)
    cells, _ = xlsx.xlsx_scan(spark, path, "B2two")
    bad = xlsx.xlsx_scan(spark, path)[1].agg(F.count("*").alias("n")).select(F.lit("unreadable").alias("sheet_name"), "n")
    # All rows, and the header that the workbooks share once.
    n = F.count_if(F.col("row_no") > 1) + F.count_distinct(F.when(F.col("row_no") == 1, F.col("cells")))
    return cells.groupBy("sheet_name").agg(n.alias("n")).unionByName(bad)


@_query("SELECT (row_number() OVER (ORDER BY event_id) - 1) // 50 AS batch_no, event_id FROM events")
def chunk_batches(spark, sf_dir):
    return reconcile.batches(_read(spark, sf_dir, "events").select("event_id"), ["event_id"]).select("batch_no", "event_id")


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 250")
def keyset_page(spark, sf_dir):
    return state.keyset_page(_read(spark, sf_dir, "orders"), "o_orderkey", 500).select("o_orderkey", "o_totalprice")
