"""Files as tasks see them, and this package for their Python."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: What Python opens by itself or by Arrow; other schemes are read by Spark.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    # The driver serves this file to the executors for as long as it runs.
    path = os.path.join(tempfile.mkdtemp(prefix="driftline-code-"), "driftline_core.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: what has none is of Hadoop's default file
    system, to Python as to Spark."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors
    share. Where it's unset on a single machine a temporary folder takes its
    place; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file:" + tempfile.mkdtemp(prefix="driftline-")
    return f"{qualified(spark, root.rstrip('/'))}/driftline/{label}-{uuid.uuid4().hex}"


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder or glob, or one file, by name; hidden ones left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(conf)
    out, todo = [], list(system.globStatus(p) or [])
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        s = todo.pop()
        if s.isDirectory():
            todo += list(system.listStatus(s.getPath()))
        elif not s.getPath().getName().startswith(("_", ".")):
            out.append(s.getPath().toString())
    return sorted(out)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder; raises where the target is there already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = a.getFileSystem(conf)
    system.mkdirs(b.getParent())
    if system.exists(b) or not system.rename(a, b):
        raise FileExistsError(target)


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def scheme(path: str) -> str:
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return m[1].lower() if m else "file"


def _local(path: str) -> str | None:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path if path.startswith("/") else None


def open_read(path: str) -> io.IOBase:
    if (local := _local(path)) is not None:
        return open(local, "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def open_write(path: str) -> io.IOBase:
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    return system.open_output_stream(inner)


def move(source: str, target: str) -> None:
    if (local := _local(source)) is not None:
        os.replace(local, _local(target))
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(source)
    system.move(inner, fs.FileSystem.from_uri(target)[1])


def delete(path: str) -> None:
    if (local := _local(path)) is not None:
        Path(local).unlink(missing_ok=True)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.delete_file(inner)
