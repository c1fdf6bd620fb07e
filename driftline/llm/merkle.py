"""Merkle manifest of a table: leaves, subroots by group, one root, and proofs.

Leaves are hashed in the JVM and dealt by range of (group, id), so a group that
holds most rows is spread over many tasks; a leaf's place follows from the
counts of the ranges before it. The trees are then built by supersteps over an
RDD of messages: children message their parents, parents with all children hash
and forward. Reverse supersteps send the siblings' digests down, one path for
each run of eight leaves, and every leaf, altered or not, is folded with them
up to the root.

Defined cases: a null is hashed as ``-``; rows without an id come first in
their group and are never altered; repeated ids are ordered by digest; each row
is a leaf of its own; an empty table gives no rows; other columns are ignored.
Texts of any length are hashed whole and don't leave the JVM.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import materialize, pieces_of, ship

FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = 200_000  # messages to a task
SCHEMA = "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest_of(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each with its length in bytes."""
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> DataFrame:
    """(group, id, leaf, altered): digests of the rows, and of the rows as
    tampering leaves them: where 3 divides the id's CRC the text is lower-cased."""
    values = {c: F.col(c).cast("string") for c in fields}
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 0, F.lit(False))
    changed = F.when(hit, F.translate(values[text_col], UPPER, LOWER)).otherwise(values[text_col])
    return docs.select(
        F.col(group_col).cast("string").alias("grp"),
        F.col(id_col).alias("id"),
        digest_of(list(values.values())).alias("leaf"),
        digest_of([changed if c == text_col else v for c, v in values.items()]).alias("altered"),
    )


# -- places ----------------------------------------------------------------------


def _ends(rows: Iterator) -> Iterator[tuple]:
    """Of one range: groups seen, size of the first and of the last, and the
    largest; ranges are sorted, so every other group is whole in its range."""
    first = last = None
    groups = n = n_first = largest = 0
    for r in rows:
        if not groups or r.grp != last:
            if groups == 1:
                n_first = n
            largest, n, groups, last = max(largest, n), 0, groups + 1, r.grp
            first = r.grp if groups == 1 else first
        n += 1
    if groups:
        yield first, last, groups, n_first if groups > 1 else n, n, max(largest, n)


def _starts(ends: list[tuple | None]) -> tuple[list[tuple[int, int, int, int]], int, int]:
    """For each range: number of its first group, rows of that group in ranges
    before, the whole sizes of its first and of its last group; then the number
    of groups and the largest group. The list is as long as ranges are many."""
    out, number, run, totals, largest = [], -1, 0, {}, 0
    open_group: object = ()
    for e in ends:
        if e is None:
            out.append((0, 0))
            continue
        first, last, groups, n_first, n_last, most = e
        if open_group == () or first != open_group:
            number, run = number + 1, 0
        out.append((number, run))
        totals[number] = run + n_first
        number += groups - 1
        if groups > 1:
            totals[number] = n_last
        run = totals[number]
        open_group, largest = last, max(largest, most, totals[number])
    starts = [(number, run, totals.get(number, 0), totals.get(number + e[2] - 1, 0) if e else 0) for (number, run), e in zip(out, ends, strict=True)]
    return starts, number + 1, max([largest, *totals.values()])


def _placed(starts: list[tuple[int, int, int, int]]):
    """Messages of the leaves of a range: (tree, parent), (place, number of
    nodes at this height, digest, (id, altered))."""

    def run(index: int, rows: Iterator) -> Iterator[tuple]:
        number, before, n_first, n_last = starts[index]
        held: list = []
        last: object = ()
        seen = 0

        def flush(is_last: bool) -> Iterator[tuple]:
            whole = n_first if seen == 1 else n_last if is_last else len(held)
            at = before if seen == 1 else 0
            for i, r in enumerate(held):
                yield (number + seen - 1, (at + i) // FAN), (at + i, whole, bytes.fromhex(r.leaf), (r.id, bytes.fromhex(r.altered)))

        for r in rows:
            if not seen or r.grp != last:
                yield from flush(False)
                held, last, seen = [], r.grp, seen + 1
            held.append(r)
            if len(held) >= 4096 and seen == 1:  # its size is known already
                yield from flush(False)
                before, held = before + len(held), []
        yield from flush(True)

    return run


# -- supersteps --------------------------------------------------------------------


def _hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def _complete(message: tuple) -> tuple:
    """A parent with its children in order; it must have them all."""
    (tree, place), children = message
    children = sorted(children, key=lambda c: c[0])
    if len(children) != min(FAN, children[0][1] - FAN * place):
        raise ValueError(f"node {place} of tree {tree} misses children")
    return (tree, place), children


def _forward(parent: tuple) -> tuple:
    """The message of a completed parent to its own parent."""
    (tree, place), children = parent
    above = -(-children[0][1] // FAN)
    return (tree, place // FAN), (place, above, _hash([c[2] for c in children]), None)


def _climb(messages: RDD, tasks: int, height: int) -> tuple[list[RDD], RDD]:
    """Supersteps upwards: the parents of every height, and the finished trees
    as (tree, (height, root)). A tree that has ended halts and waits."""
    parents, ended, live = [], [], messages.filter(lambda m: m[1][1] > 1)
    ended.append(messages.filter(lambda m: m[1][1] == 1).map(lambda m: (m[0][0], (0, m[1][2]))))
    for up in range(height):
        full = live.groupByKey(max(1, tasks >> (3 * up))).map(_complete, preservesPartitioning=True)
        parents.append(full)
        sent = full.map(_forward)
        ended.append(sent.filter(lambda m: m[1][1] == 1).map(lambda m, h=up + 1: (m[0][0], (h, m[1][2]))))
        live = sent.filter(lambda m: m[1][1] > 1)
    return parents, messages.context.union(ended)


def _children(pair: tuple) -> Iterator[tuple]:
    """What a parent sends down: to each child's own place, the path above it
    and the child's siblings."""
    ((tree, place), (children, above)) = pair
    digests = [c[2] for c in children]
    for i, c in enumerate(children):
        yield (tree, c[0]), (*above[:-1], ((i, digests), *above[-1]))


def _descend(parents: list[RDD], tops: RDD) -> RDD:
    """Reverse supersteps: ``tops`` has (tree, (height, known)), where known is
    a tuple whose last item is the path above the tree's root. Gives the parents
    of the lowest height with all that is known above them."""
    down = None
    for up in reversed(range(len(parents))):
        begin = tops.filter(lambda t, h=up + 1: t[1][0] == h).map(lambda t: ((t[0], 0), t[1][1]))
        down = begin if down is None else down.union(begin)
        met = parents[up].join(down, parents[up].getNumPartitions())
        if up == 0:
            return met
        down = met.flatMap(_children)
    raise ValueError("no parents")


def _fold(digest: bytes, path: tuple) -> bytes:
    for i, digests in path:
        digest = _hash([*digests[:i], digest, *digests[i + 1 :]])
    return digest


def _proof(path: tuple) -> str:
    return hashlib.sha256("".join(d.hex() for i, digests in path for j, d in enumerate(digests) if j != i).encode()).hexdigest()


def _row(leaf: bytes, own: tuple, subroot: bytes, root: bytes, path: tuple) -> tuple:
    id_, altered = own
    folded = _fold(altered, path)
    return id_, leaf.hex(), subroot.hex(), root.hex(), _proof(path), folded.hex(), folded == root


def _rows(pair: tuple) -> Iterator[tuple]:
    _, (children, (subroot, root, above)) = pair
    digests = [c[2] for c in children]
    for i, c in enumerate(children):
        yield _row(c[2], c[3], subroot, root, ((i, digests), *above))


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, text_col: str = "text") -> DataFrame:
    """Per row: id, leaf, subroot of its group, root, proof_sha256 (of the
    siblings from its run up to the root), folded_root (from the altered leaf)
    and verified (folded_root = root).

    Groups are ordered bytewise, null first. The driver holds some numbers for
    each range of the sort, and the root.
    """
    spark = docs.sparkSession
    ship(spark)
    found = leaves(docs, id_col, group_col, fields, text_col)
    schema = SCHEMA.format(id=found.schema["id"].dataType.simpleString()).replace("doc_id", f"`{id_col}`", 1)
    found = materialize(found, "merkle-leaves")
    ranges = pieces_of(found, 16 << 20)
    ordered = found.repartitionByRange(ranges, F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf")
    ordered = ordered.sortWithinPartitions(F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf").rdd
    ends = ordered.mapPartitions(lambda rows: iter([next(_ends(rows), None)])).collect()
    starts, groups, largest = _starts(ends)
    if not groups:
        return spark.createDataFrame([], schema)
    tasks = ordered.getNumPartitions()
    messages = ordered.mapPartitionsWithIndex(_placed(starts))

    height = _height(largest)
    parents, subroots = _climb(messages, tasks, height)
    # The upper tree: its leaves are the subroots, in the order of their groups.
    upper = subroots.map(lambda s: ((-1, s[0] // FAN), (s[0], groups, s[1][1], (s[0], s[1][0]))))
    over, tops = _climb(upper, max(1, groups // ROWS), _height(groups))
    root = tops.values().first()[1]
    if groups > 1:
        above = _descend(over, spark.sparkContext.parallelize([(-1, (len(over), (root, ())))], 1))
        above = above.flatMap(lambda pair: _below(pair, root))
    else:
        above = subroots.map(lambda s: (s[0], (s[1][0], (s[1][1], root, ()))))
    # Groups of one row have no parents of their own.
    single = messages.filter(lambda m: m[1][1] == 1).map(lambda m: (m[0][0], m[1]))
    lone = single.join(above.filter(lambda t: t[1][0] == 0), max(1, tasks)).map(lambda p: _row(p[1][0][2], p[1][0][3], *p[1][1][1]))
    rows = _descend(parents, above).flatMap(_rows).union(lone) if parents else lone
    return spark.createDataFrame(rows, schema, verifySchema=False)


def _height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def _below(pair: tuple, root: bytes) -> Iterator[tuple]:
    """For every group's tree: its height, and (subroot, root, path above)."""
    _, (children, (_, above)) = pair
    digests = [c[2] for c in children]
    for i, c in enumerate(children):
        tree, height = c[3]
        yield tree, (height, (c[2], root, ((i, digests), *above)))


_CRC = "(4294967295 - list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda r, b: list_reduce(range(8), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)), xor(r, b)), 4294967295))"


def _field(name: str) -> str:
    return f"coalesce(octet_length(encode({name}::VARCHAR))::VARCHAR || ':' || {name}::VARCHAR, '-')"


_LEAF = " || ".join(_field(c) for c in FIELDS)

#: Node sets of both trees level by level; leaves then climb with their own and
#: their altered digest, replacing themselves among their run's digests.
ORACLE_SQL = f"""
WITH RECURSIVE changed AS (
  SELECT doc_id, source, lang, n_chars, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS text FROM documents),
leaf AS (
  SELECT d.doc_id, d.lang, d.leaf, c.altered, dense_rank() OVER (ORDER BY d.lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY d.lang ORDER BY d.doc_id) - 1 AS pos, count(*) OVER (PARTITION BY d.lang) AS n
  FROM (SELECT doc_id, lang, sha256({_LEAF}) AS leaf FROM documents) d JOIN (SELECT doc_id, sha256({_LEAF}) AS altered FROM changed) c USING (doc_id)),
low AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM leaf
  UNION ALL
  SELECT tree, lvl + 1, pos // {FAN}, any_value((n + {FAN - 1}) // {FAN}), sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY tree, lvl, pos // {FAN}),
subroots AS (SELECT tree, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, tree AS pos, (SELECT count(*) FROM subroots) AS n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // {FAN}, any_value((n + {FAN - 1}) // {FAN}), sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // {FAN}),
runs AS (
  SELECT tree, lvl, pos // {FAN} AS run, list(h ORDER BY pos) AS hs FROM low WHERE n > 1 GROUP BY tree, lvl, pos // {FAN}
  UNION ALL
  SELECT -1, lvl, pos // {FAN}, list(h ORDER BY pos) FROM high WHERE n > 1 GROUP BY lvl, pos // {FAN}),
climb AS (
  SELECT doc_id, tree AS own, tree, 0 AS lvl, pos, altered AS cur, '' AS proof FROM leaf
  UNION ALL
  SELECT c.doc_id, c.own,
         CASE WHEN r.run IS NULL THEN -1 ELSE c.tree END, CASE WHEN r.run IS NULL THEN 0 ELSE c.lvl + 1 END,
         CASE WHEN r.run IS NULL THEN c.own ELSE c.pos // {FAN} END,
         CASE WHEN r.run IS NULL THEN c.cur ELSE sha256(array_to_string(list_transform(r.hs, lambda h, i: CASE WHEN i = c.pos % {FAN} + 1 THEN c.cur ELSE h END), '')) END,
         CASE WHEN r.run IS NULL THEN c.proof ELSE c.proof || array_to_string(list_filter(r.hs, lambda h, i: i <> c.pos % {FAN} + 1), '') END
  FROM climb c LEFT JOIN runs r ON r.tree = c.tree AND r.lvl = c.lvl AND r.run = c.pos // {FAN}
  WHERE r.run IS NOT NULL OR c.tree >= 0),
top AS (SELECT doc_id, cur, proof FROM climb c WHERE tree = -1 AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.tree = -1 AND r.lvl = c.lvl AND r.run = c.pos // {FAN}))
SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, sha256(t.proof) AS proof_sha256, t.cur AS folded_root,
       t.cur = (SELECT h FROM high WHERE n = 1) AS verified
FROM leaf l JOIN subroots s USING (tree) JOIN top t USING (doc_id)
"""
