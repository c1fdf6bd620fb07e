"""Mixing sources to target weights by weighted fair queueing.

DataFrame functions only. Sources by code point (null last) take the weights
3, 1, 2 over and over and share a budget of 150 % of all words. Each document,
in an order shuffled by a hash of its id, gets a virtual finish time: its
source's words up to its end, divided by the source's weight. A source that has
served all its documents once serves them a second time and then leaves the
queue. The queue is sorted by finish time over all sources and cut at the
budget: an entry is taken when at least half of it lies within.

No task holds a source or the queue. A source's running sum goes over buckets
of its hash order: bucket totals by partial aggregation, and an offset for each
(source, bucket). The queue's running sum goes over ranges of virtual time in the
same way: totals of ranges, then sorted entries of the one range in which the
budget ends. The last entry taken there is the cut, one row, that every document
is compared with.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import WORD, materialize, partitions, pieces_of

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
EPOCHS = 2
SEED = "mix-1"
_HASH_BITS = 48
#: Rows of a bucket of the hash order, and of a range of the queue, at most on
#: the average; buckets of small inputs have fewer, so that all tasks share them.
RANGE, LEAST = 20_000, 64


def order_key(id_col: str, text_col: str = "text", seed: str = SEED) -> Column:
    """The shuffled order: 48 bits of md5 over the seed and the id, or the
    text's md5 where there is no id, so that rows without one spread too."""
    name = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, _HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """(source, source_size, weight, rank, rows, target) from (source, size): one
    row a source. Targets in proportion to the weights stop at twice the source's
    size; the excess goes to the others by weight until none is above."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # One row a source: these windows and the totals are as long as that list.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", pick).withColumn("rank", rank)
    full = F.col("source_size") * EPOCHS
    by_fill = Window.orderBy(F.col("fill"), F.col("rank"))
    filled = (
        ranked.withColumn("fill", full / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum(full).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    )
    # Virtual time at which the budget ends if this source and those after it stay open.
    time = (F.col("all") * budget_percent / 100.0 - F.col("before")) / F.col("open")
    filled = filled.withColumn("time", time)
    ends = F.min(F.when(F.col("time") <= F.col("fill"), F.struct("fill", "rank", "time"))).over(Window.partitionBy())
    return filled.withColumn("end", F.coalesce(ends["time"], F.lit(0.0))).select(
        "source", "source_size", "weight", "rank", "rows", F.least(full.cast("double"), F.col("weight") * F.col("end")).alias("target")
    )


#: An entry's place in the queue; ties of finish times end here.
_ENTRY = ("finish", "rank", "epoch", "place", "id", "size")


def _entry(epoch: int) -> Column:
    finish = (F.col("start") + F.col("size") + F.col("source_size") * epoch) / F.col("weight")
    return F.struct(finish.alias("finish"), "rank", F.lit(epoch).alias("epoch"), "place", "id", "size")


def _cut(entries: DataFrame, budget: float, n: int) -> Column | None:
    """The last entry of the queue that is taken, as a literal; None where no
    entry has words. ``entries`` are those with words."""
    horizon = entries.agg(F.max("finish")).first()[0]
    if horizon is None:
        return None
    # Words arrive at most at the sum of all weights a unit of virtual time.
    ranges = max(1, -(-n // RANGE))
    entries = entries.withColumn("range", F.least(F.floor(F.col("finish") * (ranges / horizon)), F.lit(ranges - 1)).cast("long"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for every ``RANGE`` entries of the queue.
    totals = entries.groupBy("range").agg(F.sum("size").alias("words")).withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = totals.where(F.col("offset") <= budget).agg(F.max(F.struct("range", "offset")).alias("r")).first().r
    run = Window.orderBy(*_ENTRY).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = entries.where(F.col("range") == last.range).withColumn("end", F.lit(last.offset) + F.sum("size").over(run))
    taken = inside.where(F.col("end") - F.col("size") / 2.0 <= budget)
    # The range begins within the budget, but its first entry may end beyond.
    earlier = entries.where(F.col("range") < last.range) if taken.isEmpty() else taken
    cut = earlier.agg(F.max(F.struct(*_ENTRY)).alias("cut")).first().cut
    kinds = dict(entries.dtypes)
    return None if cut is None else F.struct(*[F.lit(cut[c]).cast(kinds[c]).alias(c) for c in _ENTRY])


def weighted_fair_queue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = True) -> DataFrame:
    """Every row of ``docs`` with its place in the queue.

    Columns: ``doc``, a struct of the row (only if ``whole``), id, size (words),
    source_size, weight, target, start (the source's words before it, in one
    round) and copies (0 to 2): how many of its two entries come before the
    queue is cut at the budget. That keeps every source within a document
    of its target. Null texts have no words; a null source is a source; rows
    that repeat an id are separate documents; documents without words are taken
    with their neighbours and add nothing; columns of any name may follow; an
    empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [F.struct("*").alias("doc")] if whole else []
    rows = docs.select(*kept, F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), order_key(id_col, text_col).alias("place"))
    # The light columns, written once: everything but the last join reads these.
    light = materialize(rows.select("id", "source", "size", "place"), "mix-sizes")
    targets = materialize(source_targets(light), "mix-targets").withColumnRenamed("source", "s")
    shown = targets.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    n_sources, n = shown[0], shown[1]
    per = max(LEAST, min(RANGE, n // (16 * partitions(docs.sparkSession))))
    targets = targets.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("rows") / per))).drop("rows")
    # Rows of a few dozen bytes: sent to all tasks only up to this many.
    hint = lambda df, rows: F.broadcast(df) if rows <= 200_000 else df
    same = F.col("source").eqNullSafe(F.col("s"))

    def bucketed(rows: DataFrame) -> DataFrame:
        rows = rows.join(hint(targets, n_sources), same).drop("s")
        return rows.withColumn("bucket", F.floor(F.col("place") * (F.col("buckets") / float(1 << _HASH_BITS))).cast("long")).drop("buckets")

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed(light).groupBy("source", "bucket").agg(F.sum("size").alias("within"))
    offsets = offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("within").over(before), F.lit(0)).alias("offset"))
    offsets = materialize(offsets, "mix-offsets")
    n_offsets = offsets.count()
    own = Window.partitionBy("source", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def placed(rows: DataFrame) -> DataFrame:
        rows = bucketed(rows).withColumn("run", F.sum("size").over(own))
        rows = rows.join(hint(offsets, n_offsets), same & (F.col("bucket") == F.col("b"))).drop("s", "b")
        return rows.withColumn("start", F.col("offset") + F.col("run") - F.col("size"))

    light = materialize(placed(light).drop("bucket", "run", "offset"), "mix-queue")
    budget = (light.agg(F.sum("size")).first()[0] or 0) * BUDGET_PERCENT / 100.0
    entries = light.where("size > 0").select(F.explode(F.array(*[_entry(e) for e in range(EPOCHS)])).alias("e")).select("e.*")
    cut = _cut(entries, budget, EPOCHS * n)
    rows = placed(rows) if whole else light
    copies = [F.lit(0) if cut is None else (_entry(e) <= cut).cast("int") for e in range(EPOCHS)]
    return rows.select(*(["doc"] if whole else []), "id", "size", "source_size", "weight", "target", "start", "rank", "place", (copies[0] + copies[1]).alias("copies"))


def mixing_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words)."""
    q = weighted_fair_queue(docs.select("doc_id", "text", "source"), whole=False)
    return q.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, taken rows once or twice, with
    their columns, range-sorted by virtual finish time and cut at the budget."""
    q = weighted_fair_queue(docs, id_col, text_col, source_col).where("copies > 0")
    q = q.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    finish = (F.col("start") + F.col("size") + F.col("epoch") * F.col("source_size")) / F.col("weight")
    q = q.select("doc", finish.alias("finish"), "rank", "place")
    return q.repartitionByRange(pieces_of(docs), "finish", "rank", "place").sortWithinPartitions("finish", "rank", "place").select("doc.*")


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 12))::BIGINT AS k
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(rank % 3 + 1)::INT] AS weight FROM by_source),
filled AS (
  SELECT *, 2 * source_size / weight::DOUBLE AS fill FROM weighed),
timed AS (
  SELECT *, (sum(source_size) OVER () * 150 / 100.0
             - coalesce(sum(2 * source_size) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM filled),
ended AS (SELECT arg_min(t, (fill, rank)) FILTER (t <= fill) AS t_end FROM timed),
targets AS (
  SELECT source, source_size, weight, rank, least(2.0 * source_size, weight * coalesce(t_end, 0.0))::DOUBLE AS target FROM timed, ended),
placed AS (
  SELECT doc_id, size, source_size, weight, rank, target, k,
         sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id NULLS FIRST, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
queue AS (
  SELECT *, (done + epoch * source_size) / weight::DOUBLE AS finish FROM placed, (VALUES (0), (1)) e(epoch)),
served AS (
  SELECT doc_id, size, source_size, target, k, done, epoch,
         sum(size) OVER (ORDER BY finish, rank, epoch, k, doc_id NULLS FIRST, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size / 2.0 AS middle FROM queue)
SELECT doc_id, size, source_size, target,
       (size * sum((middle <= (SELECT sum(size) FROM sized) * 150 / 100.0)::INT))::BIGINT AS taken
FROM served GROUP BY doc_id, size, source_size, target, k, done
"""
