"""A sink for a sync's plan: requests in batches, with an outcome for each row.

``send`` writes the plan's inserts, updates and deletes as request files of 50
lines each, as a service takes them. A row that makes no sense as a request is an
outcome with an error and leaves its neighbours alone. Every request has a key
made of the run's token and of what it does, so that a receiver can tell one that
comes twice; and a run whose token was sent before is not sent again. Tasks write
under names of their own, and one rename at the end shows all of a run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from driftline import files

FORMAT = "driftline_outbox"
BATCH = 50
OUTCOME = "key string, action string, title string, batch string, ok boolean, error string"


def problem(action: str, remote_id: str | None, payload: dict | None) -> str | None:
    """Why a row is no request; None where it is one."""
    if action not in ("insert", "update", "delete"):
        return f"unknown action: {action}"
    if action != "insert" and not remote_id:
        return f"{action} without an id"
    if action == "delete":
        return None
    if payload is None or not (payload.get("summary") or "").strip():
        return f"{action} without a summary"
    start, end = ((payload.get(m) or {}).get("dateTime") or "" for m in ("start", "end"))
    if not start or not end:
        return f"{action} without start or end"
    return f"{action} ends before it starts" if end < start else None


@dataclass
class _Sent(WriterCommitMessage):
    requests: int
    failed: int


class _Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.size = int(options.get("batch", BATCH))

    def write(self, iterator: Iterator) -> _Sent:
        context = TaskContext.get()
        # A name for this attempt: of a task that runs again only one is committed,
        # and its outcomes say which batches count.
        own = f"{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        held: list[str] = []
        outcomes: list[str] = []
        batches = failed = requests = 0

        def flush() -> None:
            nonlocal held, batches
            if held:
                with files.open_write(f"{self.folder}/requests/{own}-{batches:06d}.jsonl") as f:
                    f.write("\n".join(held).encode())
                held, batches = [], batches + 1

        for r in iterator:
            payload = json.loads(r["payload"]) if r["payload"] is not None else None
            error = problem(r["action"], r["remote_id"], payload)
            if error is None:
                held.append(json.dumps({"key": r["key"], "action": r["action"], "id": r["remote_id"], "body": payload}, ensure_ascii=False))
                requests += 1
            failed += error is not None
            outcomes.append(json.dumps({"key": r["key"], "action": r["action"], "title": r["title"], "batch": None if error else f"{own}-{batches:06d}", "ok": error is None, "error": error}, ensure_ascii=False))
            if len(held) == self.size:
                flush()
        flush()
        if outcomes:
            with files.open_write(f"{self.folder}/outcomes/{own}.jsonl") as f:
                f.write("\n".join(outcomes).encode())
        return _Sent(requests, failed)

    def commit(self, messages: list) -> None:
        done = [m for m in messages if m is not None]
        with files.open_write(f"{self.folder}/sent.json") as f:
            f.write(json.dumps({"requests": sum(m.requests for m in done), "failed": sum(m.failed for m in done)}).encode())

    def abort(self, messages: list) -> None:
        pass  # the folder of a run that failed never gets its name


class OutboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


def send(plan: DataFrame, folder: str, token: str, batch: int = BATCH) -> DataFrame:
    """Sends a plan once for a token, and gives the outcomes of its rows: (key,
    action, title, batch, ok, error). No-ops are no requests."""
    spark = plan.sparkSession
    files.ship(spark)
    spark.dataSource.register(OutboxSource)
    root = files.qualified(spark, folder.rstrip("/"))
    target = f"{root}/{token}"
    if not _there(spark, target):
        key = F.sha2(F.concat_ws("\x1f", F.lit(token), "action", F.coalesce("remote_id", F.lit("")), "title", "start_date", "end_date", F.coalesce(F.to_json("payload"), F.lit(""))), 256)
        rows = plan.where("action <> 'noop'").select(key.alias("key"), "action", "title", "remote_id", F.to_json("payload").alias("payload"))
        new = f"{root}/_sending-{uuid.uuid4().hex}"
        rows.write.format(FORMAT).options(path=new, batch=str(batch)).mode("append").save()
        try:
            files.rename(spark, new, target)
        except FileExistsError:
            if not _there(spark, target):
                raise
    return spark.read.schema(OUTCOME).json(f"{target}/outcomes") if _there(spark, f"{target}/outcomes") else spark.createDataFrame([], OUTCOME)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def requests(spark: SparkSession, folder: str, token: str) -> DataFrame:
    """The requests of a run: those of the batches that its outcomes name, once each."""
    target = f"{files.qualified(spark, folder.rstrip('/'))}/{token}"
    lines = spark.read.schema("key string, action string, id string, body string").json(f"{target}/requests")
    named = spark.read.schema(OUTCOME).json(f"{target}/outcomes").where("ok").select(F.concat("batch", F.lit(".jsonl")).alias("file")).distinct()
    return lines.withColumn("file", F.substring_index(F.input_file_name(), "/", -1)).join(named, "file", "left_semi").dropDuplicates(["key"]).drop("file")
