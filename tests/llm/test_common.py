"""Shared folders without a scheme, where the default file system isn't the local one."""

from __future__ import annotations

import pytest

from driftline.llm import blocks, common


def _folder(spark, monkeypatch, path: str) -> None:
    """What the cluster would name; it can't be changed in a running session."""
    given = type(spark.conf).get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: path if key == "spark.checkpoint.dir" else given(self, key, *rest))


@pytest.fixture
def remote_default(spark, tmp_path, monkeypatch):
    """A session whose default file system is another than file:, over a folder."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.far.link./shared", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://far/")
    _folder(spark, monkeypatch, "/shared")
    yield spark
    conf.set("fs.defaultFS", before)


def test_a_folder_without_a_scheme(remote_default, tmp_path):
    """Spark writes to the default file system, and Python isn't led to a local
    folder of that name: the path says where it is."""
    path = common.scratch_path(remote_default, "x")
    assert path.startswith("viewfs://far/shared/driftline/x-")
    table = common.materialize(remote_default.range(3), "y")
    assert table.count() == 3 and list(tmp_path.glob("driftline/y-*/part-*"))
    with pytest.raises(Exception, match="viewfs|Unrecognized|libhdfs|libjvm"):
        common.open_read(path)


def test_local_folders(spark, tmp_path, monkeypatch):
    _folder(spark, monkeypatch, str(tmp_path))
    assert common.scratch_root(spark) == f"file:{tmp_path}"
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "c" * 30)], "id long, text string").coalesce(1)
    rows = blocks.write_blocks(df, "text", "b", 20).collect()
    assert [r.n_rows for r in rows] == [2, 1] and all(r.path.startswith("file:") for r in rows)
    assert [blocks.read_block(r.path)["id"].to_pylist() for r in rows] == [[1, 2], [3]]
