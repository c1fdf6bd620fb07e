"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. One pass over the texts turns each into a set of word shingles (64-bit
   hashes), and the set into ``bands * rows`` MinHash samples, one key a band,
   and an odd sketch: every (sample number, value) toggles one bit of a bitmap,
   so that the XOR of two bitmaps has a bit for each sample that differs.
2. Equal sets (a 128-bit digest and the size) become one class; only its
   smallest document goes on. Hot groups of exact copies end here, in a
   map-side aggregate.
3. Band buckets choose a leader: the member whose bands meet most others. All
   members meet the leader, not one another, so a bucket of n gives n - 1
   candidates. Further leaders follow for buckets still of several components:
   two in any case, and more, each in linear time, while they find links and what
   is left would take many tiles. Where components still share a bucket, the
   members outside its largest one meet all others in tiles of bounded size,
   which return links only.
4. The population count of the XOR of two odd sketches estimates the
   similarity sharply where it is high, and drops candidates far below the
   threshold (six standard deviations of slack).
5. The rest is confirmed on the full sets, made anew from the texts of the few
   documents that still matter.

The chance that a pair right at the threshold shares no band is
``(1 - t**rows)**bands``: 1e-9 with the defaults at 0.85.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, batch_of, list_column, map_batches, materialize, mix64, numbered, slices, word_hashes
from driftline.llm.components import connected_components

BANDS, ROWS = 28, 4
SKETCH_WORDS = 8  # of 64 bits
#: Shingles on either side of a tile, where leaders left members unmet.
TILE = 400_000
#: Tiles of one group beyond which more leaders are chosen first.
MANY_TILES = 64
_GOLD = 0x9E3779B97F4A7C15

_rng = np.random.RandomState(20240601)
_A = (_rng.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32) << np.uint32(1) | np.uint32(1))[:, None]
_B = _rng.randint(0, 1 << 31, BANDS * ROWS).astype(np.uint32)[:, None]


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingles of each text as uint64; a text of fewer
    words is one shingle; no words: empty."""
    hashes, offsets = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        rolled[: max(0, n - k + 1)] = rolled[: max(0, n - k + 1)] * np.uint64(_GOLD) + hashes[j : j + max(0, n - k + 1)]
    rolled = mix64(rolled)
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        if hi - lo >= k:
            yield np.unique(rolled[lo : hi - k + 1])
        elif hi > lo:
            with np.errstate(over="ignore"):
                one = reduce(lambda a, x: a * np.uint64(_GOLD) + x, hashes[lo:hi], np.uint64(hi - lo))
            yield mix64(np.array([one], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest of the shingles under each of the hash functions."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 4096):
        np.minimum(out, (h[None, i : i + 4096] * _A + _B).min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bitmap of the parities of the (number, value) samples."""
    bit = mix64(samples.astype(np.uint64) + (np.arange(1, len(samples) + 1, dtype=np.uint64) << np.uint64(32)))
    odd = np.bincount((bit & np.uint64(SKETCH_WORDS * 64 - 1)).astype(np.int64), minlength=SKETCH_WORDS * 64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = key * np.uint64(_GOLD) + samples.reshape(BANDS, ROWS)[:, r]
    return mix64(key)


def estimated_similarity(differing_bits: int) -> float:
    """Jaccard similarity from the population count of two sketches' XOR."""
    bits, k = SKETCH_WORDS * 64, BANDS * ROWS
    share = min(differing_bits / bits, 0.4999)
    return 1 - np.log(1 - 2 * share) / np.log(1 - 2 / bits) / (2 * k)


def widest_xor(threshold: float) -> int:
    """The most differing bits that a pair at the threshold shows, with six
    standard deviations of slack for the samples and the bitmap together."""
    bits, k = SKETCH_WORDS * 64, BANDS * ROWS
    ones = bits / 2 * (1 - (1 - 2 / bits) ** (2 * k * (1 - threshold)))
    deviation = np.sqrt(4 * k * threshold * (1 - threshold) + ones / 4)
    return int(np.ceil(ones + 6 * deviation))


_SIGNATURE = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("d0", pa.int64()), ("d1", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
)
_SETS = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _signatures(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        n, d0, d1, keys, sketches = [], [], [], [], []
        for s in shingle_sets(texts, k):
            n.append(len(s))
            d0.append(int(s.sum(dtype=np.uint64).view(np.int64)))
            d1.append(int(mix64(s + np.uint64(_GOLD)).sum(dtype=np.uint64).view(np.int64)))
            samples = minhashes(s)
            keys.append(band_keys(samples))
            sketches.append(odd_sketch(samples))
        yield batch_of(
            _SIGNATURE,
            [batch.column(0), n, d0, d1, list_column(np.concatenate(keys).view(np.int64), BANDS), list_column(np.concatenate(sketches).view(np.int64), SKETCH_WORDS)],
        )


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        yield batch_of(_SETS, [batch.column(0), [s.view(np.int64) for s in shingle_sets(texts, k)]])


def _xor_bits(a: str, b: str):
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_WORDS)))


def _with_sets(sets: DataFrame | None, pairs: DataFrame, docs: DataFrame, k: int, materialize=materialize) -> DataFrame:
    """Shingle sets of every end of the pairs, made once for each document."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    if sets is not None:
        ends = ends.join(sets.select("id"), "id", "left_anti")
    ends = materialize(ends, "dedup-ends")
    n = ends.count()
    if n == 0 and sets is not None:
        return sets
    # Ids alone are sent to all tasks, and only up to 16 MB of them.
    texts = docs.join(F.broadcast(ends) if n <= 2_000_000 else ends, "id", "left_semi").select("id", "text")
    new = materialize(map_batches(texts, partial(_sets, k), "id long, shingles array<long>"), "dedup-sets")
    return new if sets is None else sets.unionByName(new)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, materialize: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Of the distinct pairs (a, b), those similar on their full sets.

    Pairs are dealt by b and a block of its partners, so no key holds more than
    a few hundred sets, however many partners a leader has.
    """
    fan = materialize(pairs.groupBy("b").agg(F.count("*").alias("fan")), "dedup-fans")
    blocked = pairs.join(fan, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("fan") / 256)).alias("part"))
    left = blocked.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    leaders = blocked.select("b", "part").distinct().join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(leaders, ["b", "part"])
    both = both.withColumn("same", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("same")
    return both.where(F.lit(100) * F.col("same") >= F.lit(percent) * union).select("a", "b")


def _tile_links(percent: int):
    """Links of a tile's strays with its members, on full sets: for each stray
    one link into every component that it touches."""

    def run(tile: pa.Table) -> pa.Table:
        ids, comps, stray = (tile[c].to_numpy(zero_copy_only=False) for c in ("id", "component", "stray"))
        sets = tile["shingles"].combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        bounds = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        dense = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
        size = np.diff(bounds)
        flag = np.zeros(len(dense) + 1, dtype=bool)
        out_a, out_b = [], []
        for i in np.flatnonzero(stray):
            own = dense[bounds[i] : bounds[i + 1]]
            flag[own] = True
            same = np.add.reduceat(flag[dense], bounds[:-1], dtype=np.int64)
            flag[own] = False
            linked = np.flatnonzero(~stray & (comps != comps[i]) & (100 * same >= percent * (size + size[i] - same)))
            linked = linked[np.unique(comps[linked], return_index=True)[1]]
            out_a.append(np.full(len(linked), ids[i])), out_b.append(ids[linked])
        a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (out_a, out_b))
        return pa.table({"a": a, "b": b})

    return run


def _components(docs: DataFrame, k: int, percent: int, rounds: int = 2) -> DataFrame:
    """(id, n, component) of documents (id, text) with ids of their own."""
    # What a hot key's rows are joined with is written first: it's then small
    # enough to be sent to all tasks, or both sides of the join are plain
    # shuffles, which adaptive execution splits.
    scratch = Scratch()
    materialize = scratch.write
    signatures = materialize(map_batches(docs, partial(_signatures, k), "id long, n long, d0 long, d1 long, keys array<long>, sketch array<long>"), "dedup-signatures")

    # Classes of equal sets.
    classes = signatures.where("n > 0").groupBy("n", "d0", "d1").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    several = materialize(classes.where("copies > 1").drop("copies"), "dedup-several")
    member = signatures.select("id", "n", "d0", "d1").join(several, ["n", "d0", "d1"], "left").select("id", "n", F.coalesce("first", "id").alias("first"))
    member = materialize(member, "dedup-classes")
    firsts = signatures.where("n > 0").join(member.where("id = first").select("id"), "id", "left_semi")

    # Bucket entries with company.
    # A key holds its band's number, so keys of two bands don't meet.
    entries = firsts.select("id", F.explode("keys").alias("key"))
    crowded = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    crowded = materialize(crowded, "dedup-crowded")
    entries = materialize(entries.join(crowded, "key"), "dedup-buckets")
    centre = entries.groupBy("id").agg(F.sum("members").alias("centre"))
    sketches = materialize(firsts.select("id", "sketch").join(centre, "id"), "dedup-sketches")
    entries = entries.select("key", "id").join(sketches.select("id", "centre"), "id")

    links: DataFrame | None = None
    sets: DataFrame | None = None
    done: DataFrame | None = None  # pairs that met already
    limit = widest_xor(percent / 100)
    component = sketches.select("id", F.col("id").alias("component"))

    def meet(pairs: DataFrame) -> bool:
        """Filter by sketch, confirm, and renew the components; whether any pair
        was confirmed."""
        nonlocal sets, done
        sa = sketches.select(F.col("id").alias("a"), F.col("sketch").alias("ka"))
        sb = sketches.select(F.col("id").alias("b"), F.col("sketch").alias("kb"))
        pairs = pairs.join(sa, "a").join(sb, "b").where(_xor_bits("ka", "kb") <= limit).select("a", "b")
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "dedup-candidates")
        done = pairs if done is None else done.unionByName(pairs)
        if pairs.isEmpty():
            return False
        sets = _with_sets(sets, pairs, docs, k, materialize)
        found = materialize(_confirmed(pairs, sets, percent, materialize), "dedup-links")
        join_up(found)
        return not found.isEmpty()

    def join_up(found: DataFrame) -> None:
        nonlocal links, component
        links = found if links is None else links.unionByName(found)
        joined = connected_components(links)
        scratch.tables.append(joined)
        component = sketches.select("id").join(joined, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        component = materialize(component, "dedup-components")

    bucket = ["key"]
    met = entries.select(*bucket, "id", "centre", F.col("id").alias("component"))
    for turn in count(1):
        leader = met.groupBy(*bucket).agg(F.max_by(F.struct("id", "component"), F.struct("centre", -F.col("id"))).alias("leader"))
        leader = materialize(leader, "dedup-leaders")
        led = met.join(leader, bucket)
        pairs = led.where("component <> leader.component").select(F.greatest("id", "leader.id").alias("a"), F.least("id", "leader.id").alias("b")).distinct()
        fell = meet(pairs)
        # The leader has met all others, so it leaves its bucket; a bucket
        # within one component is settled.
        left = led.where("id <> leader.id").select(*bucket, "id", "centre").join(component, "id")
        open_ = left.groupBy(*bucket).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(*bucket)
        open_ = materialize(open_, "dedup-open")
        met = materialize(left.join(open_, bucket, "left_semi").select(*bucket, "id", "centre", "component"), "dedup-met")
        if met.isEmpty():
            break
        if turn < rounds:
            continue
        # What is left of the buckets meets in tiles. Buckets with the same
        # largest component are one group, so no pair meets once a band. In a
        # group, members outside that component (strays) meet all members.
        sizes = met.groupBy(*bucket, "component").agg(F.count("*").alias("size"))
        main = sizes.groupBy(*bucket).agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("main"))
        main = materialize(main, "dedup-mains")
        group = met.join(main, bucket).select("main", "id", "component").distinct().withColumn("stray", F.col("component") != F.col("main"))
        group = materialize(group.join(firsts.select("id", "n"), "id"), "dedup-groups")
        wide = group.groupBy("main").agg(
            F.ceil(F.sum("n") / TILE).alias("xs"), F.ceil(F.sum(F.when(F.col("stray"), F.col("n"))) / TILE).alias("ys")
        )
        wide = materialize(wide, "dedup-tiles")
        if fell and (wide.agg(F.max(F.col("xs") * F.col("ys"))).first()[0] or 0) > MANY_TILES:
            continue
        named = materialize(group.select("id").distinct(), "dedup-ends")
        sets = _with_sets(sets, named.select(F.col("id").alias("a"), F.col("id").alias("b")), docs, k, materialize)
        # Only these members' sets are dealt out.
        needed = sets.join(F.broadcast(named) if named.count() <= 2_000_000 else named, "id", "left_semi")
        spread = group.join(wide, "main").withColumn("deal", F.xxhash64("id"))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        # Tile (x, y) holds the members of block x and the strays of block y.
        hosts = spread.select("main", "id", "component", F.lit(False).alias("stray"), F.pmod("deal", "xs").alias("x"), every("ys").alias("y"))
        guests = spread.where("stray").select("main", "id", "component", "stray", every("xs").alias("x"), F.pmod("deal", "ys").alias("y"))
        tiles = hosts.unionByName(guests).join(needed, "id").groupBy("main", "x", "y")
        join_up(materialize(tiles.applyInArrow(_tile_links(percent), "a long, b long"), "dedup-links"))
        break

    result = member.join(component.select(F.col("id").alias("first"), "component"), "first", "left")
    # The smallest id of a component is the smallest of its classes' first ids.
    result = materialize(result.select("id", "n", F.coalesce("component", "first").alias("component")), "dedup-result")
    scratch.close(result)
    return result


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("given"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose k-word shingle sets are similar.

    Links pairs with ``100 * intersection >= percent * union``. Returns one row
    per row: ``id_col``, n_shingles, component_id (smallest id reachable, itself
    included) and kept (``id_col == component_id``). A null or blank text has
    the empty set and links with nothing. Every row is a document of its own,
    also where an id repeats or is missing; a missing id is left out of the
    smallest, and its row is kept if its component has no id at all. Ties of
    leaders go to the smaller id and change no link. Very long texts are hashed
    in parts; their set is held in one task. Other columns are ignored. An
    empty table gives an empty result.
    """
    rows, odd = numbered(_rows(docs, id_col, text_col), "given", "given", "text")
    out = _components(rows.select(F.col("node").alias("id"), "text"), k, percent)
    if odd:
        out = out.join(rows.select(F.col("node").alias("id"), "given"), "id")
        lowest = out.groupBy("component").agg(F.min("given").alias("lowest"))
        out = out.join(lowest, "component").select(F.col("given").alias("id"), "n", F.col("lowest").alias("component"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with
    the smallest id, any of them where ids repeat, one without an id only where
    the component has no other."""
    rows, odd = numbered(_rows(docs, id_col, text_col), "given", "doc", "given", "text")
    found = _components(rows.select(F.col("node").alias("id"), "text"), k, percent)
    if odd:
        known = found.join(rows.select(F.col("node").alias("id"), "given"), "id")
        stays = known.groupBy("component").agg(F.min(F.struct(F.col("given").isNull(), "given", "id")).alias("first"))
        found = known.join(stays, "component").select("id", F.col("first.id").alias("component"))
    gone = materialize(found.where("id <> component").select(F.col("id").alias("node")), "dedup-gone")
    # Ids alone are sent to all tasks, and only up to 16 MB of them.
    return rows.join(F.broadcast(gone) if gone.count() <= 2_000_000 else gone, "node", "left_anti").select("doc.*")


ORACLE_SQL = """
WITH RECURSIVE spelled AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM spelled WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT s FROM shingle GROUP BY s HAVING count(*) > 1),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same
  FROM (SELECT * FROM shingle SEMI JOIN common USING (s)) a JOIN shingle b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * same >= 85 * (x.n + y.n - same)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
lowest AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""
