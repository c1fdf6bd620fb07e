"""Keyed tables on files: buckets of the key, sorted and with Bloom filters, and
a manifest that says which folder a bucket is in.

A write reads and rewrites the buckets that its rows touch and leaves all other
files where they are. The next manifest is put in place by one rename that fails
if another writer was first, so readers see the table before or after a write,
never between. A write with a token that was seen before changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import files
from driftline.operators import state

_BUCKET = "_bucket"


class Conflict(Exception):
    """Another write came first; read again and retry."""


class NotUnique(ValueError):
    """Two rows have a key or a value that may be there once only."""


@dataclass(frozen=True)
class Manifest:
    number: int
    key: str
    buckets: int
    schema: str
    unique: tuple[str, ...] = ()
    folders: dict[str, str] = field(default_factory=dict)  # bucket -> folder
    tokens: tuple[str, ...] = ()


#: Tokens that a manifest remembers: a repeated write comes soon or never.
REMEMBERED = 1000


class KeyedTable:
    """A table with a primary key, below a folder that all can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, files.qualified(spark, root.rstrip("/"))

    # -- manifests ------------------------------------------------------------------

    def _manifests(self) -> list[str]:
        try:
            return [f for f in files.list_files(self.spark, f"{self.root}/manifests") if f.endswith(".json")]
        except FileNotFoundError:
            return []

    def manifest(self) -> Manifest:
        found = self._manifests()
        if not found:
            raise FileNotFoundError(f"no table in {self.root}")
        text = self.spark.read.text(found[-1], wholetext=True).first()[0]
        got = json.loads(text)
        return Manifest(**{**got, "unique": tuple(got["unique"]), "tokens": tuple(got["tokens"])})

    def _put(self, m: Manifest) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        new = f"{self.root}/manifests/_new-{uuid.uuid4().hex}"
        path = jvm.org.apache.hadoop.fs.Path(new)
        stream = path.getFileSystem(conf).create(path, True)
        stream.write(bytearray(json.dumps(m.__dict__).encode()))
        stream.close()
        try:
            files.rename(self.spark, new, f"{self.root}/manifests/{m.number:012d}.json")
        except FileExistsError as e:
            raise Conflict(f"{self.root}: manifest {m.number} is there already") from e

    # -- writes -----------------------------------------------------------------------

    def create(self, rows: DataFrame, key: str, buckets: int = 64, unique: Sequence[str] = ()) -> KeyedTable:
        """The table from rows whose key, and whose ``unique`` columns, differ."""
        m = Manifest(0, key, buckets, rows.schema.json(), tuple(unique))
        self._check(m, rows, [key, *unique])
        self._put(self._written(m, rows, range(buckets)))
        return self

    def _bucket(self, m: Manifest, of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(m.buckets)).cast("int")

    def _written(self, m: Manifest, rows: DataFrame, touched: Sequence[int]) -> Manifest:
        """The manifest with new folders for the touched buckets."""
        version = f"{self.root}/data/{m.number:012d}-{uuid.uuid4().hex}"
        if _BUCKET not in rows.columns:  # else they are dealt already
            rows = rows.withColumn(_BUCKET, self._bucket(m, F.col(m.key))).repartition(_BUCKET)
        placed = rows.sortWithinPartitions(_BUCKET, m.key)
        placed.write.partitionBy(_BUCKET).option(f"parquet.bloom.filter.enabled#{m.key}", "true").parquet(version)
        full = {int(p.split(f"{_BUCKET}=")[1].split("/")[0]) for p in self._below(version)}
        folders = {b: f for b, f in m.folders.items() if int(b) not in set(touched)}
        folders |= {str(b): f"{version}/{_BUCKET}={b}" for b in touched if b in full}
        return Manifest(m.number, m.key, m.buckets, m.schema, m.unique, folders, m.tokens)

    def _below(self, folder: str) -> list[str]:
        return [f for f in files.list_files(self.spark, folder) if f"{_BUCKET}=" in f]

    def _check(self, m: Manifest, rows: DataFrame, columns: Sequence[str]) -> None:
        for c in columns:
            bad = state.repeated_keys(rows.where(F.col(c).isNotNull()), c).limit(3).collect()
            if bad:
                raise NotUnique(f"{c}: {', '.join(str(b[c]) for b in bad)}")
        if not rows.where(F.col(m.key).isNull()).isEmpty():
            raise NotUnique(f"{m.key}: null")

    def _rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], token: str | None, check: bool = True, repeats: bool = True) -> bool:
        """``change`` the buckets that the keys fall in; False if the token was
        seen. Where the change can't repeat a key, ``repeats`` is False, and only
        the unique columns are checked."""
        m = self.manifest()
        if token is not None and token in m.tokens:
            return False
        touched = sorted(r[0] for r in keys.where(F.col(m.key).isNotNull()).select(self._bucket(m, F.col(m.key))).distinct().collect())
        tokens = (*m.tokens, token)[-REMEMBERED:] if token is not None else m.tokens
        after = Manifest(m.number + 1, m.key, m.buckets, m.schema, m.unique, m.folders, tokens)
        if touched:
            rows = change(self._read(m, touched))
            if check:
                if repeats:
                    self._check(m, rows, [m.key])
                if m.unique:  # the other buckets' values are read, not their rows
                    rest = self._read(m, [b for b in range(m.buckets) if b not in set(touched)])
                    self._check(m, rows.select(m.key, *m.unique).unionByName(rest.select(m.key, *m.unique)), m.unique)
            after = self._written(after, rows, touched)
        self._put(after)
        return True

    def upsert(self, source: DataFrame, keep: Sequence[str] = (), token: str | None = None) -> bool:
        """Rows of the source replace those of their key; ``keep`` as in ``state.upsert``."""
        m = self.manifest()
        self._check(m, source, [m.key])
        return self._rewrite(source.select(m.key), lambda old: state.upsert(old, source, m.key, keep), token)

    def delete(self, keys: DataFrame, token: str | None = None) -> bool:
        """Without the rows of these keys."""
        m = self.manifest()
        return self._rewrite(keys.select(m.key), lambda old: old.join(keys.select(m.key).distinct(), m.key, "left_anti"), token, check=False)

    def apply(self, plan: DataFrame, token: str | None = None) -> bool:
        """A sync's plan on a snapshot of remote events: inserts, updates and
        deletes, in the buckets of their ids only.

        The plan is evaluated once, into a folder that goes afterwards. Rows of
        the table and of the plan then meet in their bucket, by one shuffle that
        also serves the write; of several rows with an id the plan's counts.
        """
        from driftline.operators.apply import new_id

        m = self.manifest()
        if token is not None and token in m.tokens:
            return False
        staged = f"{self.root}/plans/{uuid.uuid4().hex}"
        acts = plan.where("action = 'insert' or (action in ('update', 'delete') and remote_id is not null)")
        acts = acts.select(F.when(F.col("action") == "insert", new_id()).otherwise(F.col("remote_id")).alias("id"), F.when(F.col("action") != "delete", F.col("payload")).alias("payload"))
        acts.write.parquet(staged)
        acts = self.spark.read.schema(acts.schema).parquet(staged)

        def change(old: DataFrame) -> DataFrame:
            shown = [c for c in old.columns if c != "id"]
            kept = old.select("id", F.struct(*shown).alias("row"), F.lit(0).alias("rank"))
            new = acts.select("id", F.when(F.col("payload").isNotNull(), F.struct(*[F.col(f"payload.{c}").alias(c) for c in shown])).alias("row"), F.when(F.col("payload").isNotNull(), 2).otherwise(1).alias("rank"))
            met = kept.unionByName(new).withColumn(_BUCKET, self._bucket(m, F.col("id"))).repartition(_BUCKET)
            # Rows of an id are in one task already: no shuffle.
            last = met.groupBy(_BUCKET, "id").agg(F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank"))
            return last.where("rank <> 1").select("id", "row.*", _BUCKET)

        try:
            return self._rewrite(acts.select("id"), change, token, repeats=False)
        finally:
            files.delete_folder(self.spark, staged)

    # -- reads ------------------------------------------------------------------------

    def _read(self, m: Manifest, buckets: Sequence[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(m.schema))
        chosen = [f for b, f in sorted(m.folders.items()) if buckets is None or int(b) in set(buckets)]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def lookup(self, *values: object) -> DataFrame:
        """Rows of these keys: their buckets only, where the files' statistics
        and Bloom filters prune further."""
        m = self.manifest()
        kind = self._read(m, []).schema[m.key].dataType
        at = self.spark.createDataFrame([(v,) for v in values], "v " + kind.simpleString()).select(self._bucket(m, F.col("v"))).distinct().collect()
        return self._read(m, [r[0] for r in at]).where(F.col(m.key).isin(*values))
