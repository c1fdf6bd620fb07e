"""Near-duplicate vectors by sorted projection passes.

Each pass concatenates the signs of 126 random projections to a key, sorts all
vectors by it and compares every vector, in double precision, with the
``window`` next ones: near vectors share long prefixes, so they stand close to
each other. Links of all passes are united. In a dense region the order goes on
with further signs, so a window never opens to all vectors of a prefix.

How many signs a pair must share to be seen in a pass is measured for every
vector in every pass, by the first vector beyond its window: what shares more
signs than that one stands within the window. Vectors tied to it by links already
don't count, as they are of its component. From these figures follows each
vector's chance to have missed a pair at the threshold; passes go on, with the
cheapest window, until ``RECALL`` of such pairs is found over all vectors.

Components come out whole, and within a component links are then counted
exactly. Members of large ones are dealt to blocks by their angle to the
component's first vector, so that by the triangle inequality pairs of blocks are
known to be linked, or not, from the blocks' least and greatest angles alone:
vectors are copied only to the tiles that are left open. Equal vectors are one
vector with a count from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, list_column, map_batches, numbered, partitions, pieces_of
from driftline.llm.components import connected_components

THRESHOLD = 0.95
SIGNS = 63  # of each of a key's two words
RECALL = 0.999
TILE = 1024
BLOCK = 4096  # vectors of small components in a task's table
WINDOWS = [1 << i for i in range(5, 14)]
ROW_COST = 2048  # sorting a vector in a pass costs as much as so many products
ROWS_AT_ONCE = 1 << 24  # vectors, once for each pass, that are sorted in one go
TRIED = WINDOWS[::2]  # windows for which every pass is measured
FIRST_WINDOW, FIRST_PASSES = 512, 4
MORE = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024, 4096]  # passes to come that are weighed


def plan(n: int, samples: list[np.ndarray], threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(window, passes) that n vectors like those given would need, a matrix for
    each length: an estimate beforehand. ``near_vectors`` doesn't use it, but
    measures all vectors as it goes.

    Vectors that are linked anyway don't count as standing between a pair: they
    tie it to their component, in which all links are counted.
    """
    near = 1 - math.acos(threshold) / math.pi
    size = sum(map(len, samples))
    windows = [w for w in WINDOWS if w <= n // 8] or WINDOWS[:1]
    if size < 2:
        return windows[0], 1
    signs = np.full((len(windows), size), 2 * SIGNS)
    at = 0
    for x in samples:
        u = _unit(x)
        share = 1 - np.arccos(np.clip(u @ u.T, -1, 1)) / math.pi
        share[share >= near] = 0
        left = np.ones_like(share)
        for bits in range(1, 2 * SIGNS):
            left *= share
            between = left.sum(axis=1) * (n / size)
            for k, w in enumerate(windows):
                fits = between <= w / 2
                signs[k, at : at + len(x)][fits] = np.minimum(signs[k, at : at + len(x)][fits], bits)
            if (between <= windows[0] / 2).all():
                break
        at += len(x)
    best = (math.inf, 0, 0)
    for w, s in zip(windows, signs, strict=True):
        missed = 1 - near**s
        most = 1
        while (missed**most).mean() > 1 - recall:
            most *= 2
        least = most // 2 + 1
        while least < most:
            middle = (least + most) // 2
            least, most = (least, middle) if (missed**middle).mean() <= 1 - recall else (middle + 1, most)
        best = min(best, (most * (w + ROW_COST), w, most))
    return best[1], best[2]


def planes(number: int, bits: int, dim: int) -> np.ndarray:
    return np.random.RandomState(1000 + number).normal(size=(dim, bits))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, those with vectors of one length at a time."""
    length = pa.compute.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for n in np.unique(length):
        yield batch.filter(pa.array(length == n))


def _keys(passes: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pass, two words of signs, id, v) of every vector."""
    weights = np.int64(1) << np.arange(SIGNS, dtype=np.int64)[::-1]
    for whole in batches:
        for batch in (b for start in range(0, whole.num_rows, 2048) for b in _by_length(whole.slice(start, 2048), 1)):
            x = _matrix(batch.column(1)).astype(float)
            for p in passes:
                sign = x @ planes(p, 2 * SIGNS, x.shape[1]) > 0
                words = [pa.array(sign[:, at : at + SIGNS] @ weights, pa.int64()) for at in (0, SIGNS)]
                columns = [pa.array(np.full(len(x), p, dtype=np.int32)), *words, *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["pass", "high", "low", "id", "v"])


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining a[i] with b[i]; a root is the smallest of its group."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while ((up := root[root]) != root).any():
            root = up


def _window_links(u: np.ndarray, window: int, threshold: float, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row from ``begin`` on with the ``window`` rows before it:
    places (a, b) for each row that a link ties to another, so that a dense group
    gives a row a vector and not a row a link."""
    root = np.arange(len(u))
    step = max(64, min(512, window))
    for at in range(begin, len(u), step):
        low = max(0, at - window)
        a, b = np.nonzero(u[at : at + step] @ u[low : at + step].T >= threshold)
        a, b = a + at, b + low
        close = (b < a) & (a - b <= window)
        if close.any():
            root = _roots(root, a[close], b[close])
    tied = np.flatnonzero(root != np.arange(len(u)))
    return root[tied], tied


def _shared(high: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signs rows a and b share before the first that differs."""
    x, y = high[a] ^ high[b], low[a] ^ low[b]
    one, two = ((np.where(z >> 32 > 0, 32 + np.frexp((z >> 32).astype(float))[1], np.frexp((z & 0xFFFFFFFF).astype(float))[1])) for z in (x, y))
    return np.where(x > 0, SIGNS - one, 2 * SIGNS - two)


def signs_needed(high: np.ndarray, low: np.ndarray, root: np.ndarray, windows: Sequence[int], begins: bool = True, ends: bool = True) -> np.ndarray:
    """For each row of a sorted pass, or of a part of it, and each window: how
    many signs a vector must share with it to be in its window, or to be of its
    group already (rows of one root).

    ``begins`` and ``ends`` tell whether the pass does where the part does. A
    side that goes on in another part counts as the side that is seen, or, where
    that has no end either, as if the part's outermost row stood beyond the window.
    """
    n, i = len(high), np.arange(len(high))
    edges = np.concatenate([[0], np.flatnonzero(root[1:] != root[:-1]) + 1, [n]])
    stretch = np.searchsorted(edges, i, side="right") - 1
    start, stop = edges[stretch], edges[stretch + 1]
    out = np.zeros((n, len(windows)), dtype=np.int8)
    for k, w in enumerate(windows):
        sides = []
        for step, edge, whole in ((1, stop, ends), (-1, start - 1, begins)):
            j = i + step * (w + 1)
            at = np.clip(j, 0, n - 1)
            j = np.where((at == j) & (root[at] == root[i]), edge[at], j)
            at = np.clip(j, 0, n - 1)
            bits = _shared(high, low, i, at) + 1
            seen = at == j
            sides.append((np.where(seen, bits, 0 if whole else bits), seen, seen | whole))
        (a, a_seen, a_known), (b, b_seen, b_known) = sides
        need = np.where(~a_known & b_seen, b, np.where(~b_known & a_seen, a, np.maximum(a, b)))
        out[:, k] = np.minimum(need, 2 * SIGNS)
    return out


_EDGE = "kind int, a long, b long, task int, before long, after long, dim int, pass int, v {}, need array<tinyint>"


def _same(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array, tuple | None]]:
    """(dim, pass, ids, vectors, their column, their signs if they are there) for
    each run of one length and pass."""
    dim, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    edges = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (number[1:] != number[:-1])) + 1).tolist(), len(dim)]
    for at, end in zip(edges[:-1], edges[1:], strict=True):
        column = batch.column(3).slice(at, end - at)
        signs = tuple(batch.column(i).slice(at, end - at).to_numpy() for i in (4, 5)) if batch.num_columns > 4 else None
        yield int(dim[at]), int(number[at]), batch.column(2).slice(at, end - at).to_numpy(), _unit(_matrix(column).astype(float)), column, signs


def _windows(window: int, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: links in windows (kind 0), its first and last
    ``window`` rows (1) with how many rows stand before and after them, how
    many rows it has (2), and where rows come with their signs, how many of them
    each row needs (3): for that, ids and signs of the range are held."""
    from pyspark import TaskContext

    task, seen = TaskContext.get().partitionId(), 0
    keys: list[tuple] = []  # (dim, pass, ids, two words of signs)
    ties: list[tuple[np.ndarray, np.ndarray]] = []  # places in the range
    tail: list[tuple] = []  # the last rows: (dim, pass, ids, unit vectors, column)
    kind = None

    def rows(kind: int, n: int, *columns: object) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), v_type, pa.list_(pa.int8()))
        columns = (*columns, None)[: len(types)]
        full = [pa.array(np.full(n, kind, dtype=np.int32))]
        full += [c if isinstance(c, pa.Array) else pa.nulls(n, t) if c is None else pa.array(np.broadcast_to(c, n), t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(full, names=["kind", "a", "b", "task", "before", "after", "dim", "pass", "v", "need"])

    v_type = None
    for batch in (b.slice(i, 8192) for b in batches for i in range(0, b.num_rows, 8192)):
        v_type = batch.schema.field(3).type
        for dim, number, ids, u, column, signs in _same(batch):
            if seen < window:
                n = min(window - seen, len(ids))
                yield rows(1, n, ids[:n], None, task, seen + np.arange(n), None, dim, number, column.slice(0, n))
            back = [t for t in tail if t[:2] == (dim, number)]
            held = np.concatenate([*[t[2] for t in back], ids]), np.concatenate([*[t[3] for t in back], u])
            a, b = _window_links(held[1], window, threshold, len(held[0]) - len(ids))
            if len(a):
                yield rows(0, len(a), held[0][a], held[0][b], *[None] * 6)
            if signs is not None:
                shift = seen - (len(held[0]) - len(ids))
                ties.append((a + shift, b + shift))
                keys.append((dim, number, ids, *signs))
            seen += len(ids)
            tail.append((dim, number, ids, u, column))
            while sum(len(t[2]) for t in tail[1:]) >= window:
                tail.pop(0)
    after = 0
    for dim, number, ids, _, column in reversed(tail):
        n = min(window - after, len(ids))
        if n > 0:
            yield rows(1, n, ids[-n:], None, task, None, after + np.arange(n)[::-1], dim, number, column.slice(len(ids) - n))
        after += n
    if seen:
        yield rows(2, 1, None, None, task, seen, None, None, None, None)
    if keys:
        root = _roots(np.arange(seen), *(np.concatenate(x) for x in zip(*ties, strict=True)))
        at = 0
        for (dim, number), parts in groupby(keys, key=lambda k: k[:2]):
            ids, high, low = (np.concatenate(x) for x in list(zip(*parts, strict=True))[2:])
            need = signs_needed(high, low, root[at : at + len(ids)], TRIED, at > 0 or task == 0, at + len(ids) < seen)
            at += len(ids)
            for i in range(0, len(ids), 8192):
                n = len(ids[i : i + 8192])
                yield rows(3, n, ids[i : i + n], None, None, None, None, dim, number, None, list_column(need[i : i + n].ravel(), len(TRIED)))


def _edges(window: int, counts: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows near the ends of ranges, once for each edge between ranges that a
    window over it can reach them from: (edge, place from the edge, id, v)."""
    for batch in batches:
        task, before, after = (batch.column(i).to_pylist() for i in range(3))
        row, edge, place = [], [], []
        for i, (t, b, a) in enumerate(zip(task, before, after, strict=True)):
            if b is not None:  # to the left: edges at the begin of this range and of those before
                while t > 0 and b < window:
                    if counts[t]:
                        row.append(i), edge.append(t), place.append(b)
                    t -= 1
                    b += counts[t]
            else:
                t += 1
                while t < len(counts) and a < window:
                    if counts[t]:
                        row.append(i), edge.append(t), place.append(-1 - a)
                    a += counts[t]
                    t += 1
        picked = batch.take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(edge, pa.int32()), pa.array(place, pa.int64()), *picked.columns[3:]], names=["edge", "place", "dim", "pass", "id", "v"])


def _edge_links(window: int, threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(rows["place"].to_numpy(), kind="stable"))
        ids, u = rows["id"].to_numpy(), _unit(_matrix(rows["v"].combine_chunks()).astype(float))
        a, b = _window_links(u, window, threshold, int((rows["place"].to_numpy() < 0).sum()))
        return pa.table({"a": ids[a], "b": ids[b]})

    return run


def _sorted_links(firsts: DataFrame, n: int, kind: str, passes: list[int], window: int, threshold: float, write: Callable[[DataFrame, str], DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    """Links found by some passes, and all that their ranges gave."""
    keyed = map_batches(firsts.select("id", F.col("v").cast(kind).alias("v")), partial(_keys, passes), f"pass int, high long, low long, id long, v {kind}")
    keyed = keyed.withColumn("dim", F.size("v"))
    order = ["dim", "pass", "high", "low", "id"]
    ranges = max(partitions(firsts.sparkSession), pieces_of(firsts, -(-(64 << 20) // len(passes))))
    ranges = max(1, min(ranges, n * len(passes) // (16 * window)))  # most rows see both ends of their windows
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return _range_links(ordered.select("dim", "pass", "id", "v", "high", "low"), kind, window, threshold, write)


def range_links(ordered: DataFrame, kind: str, window: int, threshold: float, write: Callable[[DataFrame, str], DataFrame]) -> list[DataFrame]:
    """Links of sorted vectors (dim, pass, id, v) in ranges: within them, and
    over their ends. The driver holds a number for each range."""
    return _range_links(ordered, kind, window, threshold, write)[0]


def _range_links(ordered: DataFrame, kind: str, window: int, threshold: float, write: Callable[[DataFrame, str], DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    found = write(map_batches(ordered, partial(_windows, window, threshold), _EDGE.format(kind)), "vector-windows")
    sizes = {r["task"]: r["before"] for r in found.where("kind = 2").select("task", "before").collect()}
    counts = [sizes.get(i, 0) for i in range(max(sizes, default=-1) + 1)]
    near = found.where("kind = 1").select("task", "before", "after", "dim", "pass", F.col("a").alias("id"), "v")
    near = map_batches(near, partial(_edges, window, counts), f"edge int, place long, dim int, pass int, id long, v {kind}")
    over = near.groupBy("edge", "dim", "pass").applyInArrow(_edge_links(window, threshold), "a long, b long")
    return [found.where("kind = 0").select("a", "b"), over], found


def _passes(firsts: DataFrame, n: int, kind: str, threshold: float, scratch: Scratch) -> tuple[DataFrame, int]:
    """Links of as many passes as find ``RECALL`` of the pairs at the threshold,
    and the number of passes.

    ``missed`` is a row a vector: the logarithm of its chance to have missed such
    a pair in all passes so far, and what each window would have added to it. The
    driver reads means over all of them.
    """
    near = 1 - math.acos(threshold) / math.pi
    usable = [k for k, w in enumerate(TRIED) if w <= n // 8] or [0]
    k = max(x for x in usable if TRIED[x] <= max(FIRST_WINDOW, TRIED[usable[0]]))
    columns = [f"m{x}" for x in usable]
    links, missed, done, more = [], None, 0, FIRST_PASSES
    while n > 1 and more:
        # Some passes at a time, so that few copies of the vectors are on disk at once.
        more = max(1, min(more, max(FIRST_PASSES, done), ROWS_AT_ONCE // n))
        of_group, found = _sorted_links(firsts, n, kind, list(range(done, done + more)), TRIED[k], threshold, scratch.write)
        links.append(scratch.write(reduce(DataFrame.unionByName, of_group).distinct(), "vector-links"))
        log = lambda x: F.greatest(F.lit(-50.0), F.log1p(-F.pow(F.lit(near), F.get("need", F.lit(x)))))
        now = found.where("kind = 3").select(F.col("a").alias("id"), log(k).alias("missed"), *[log(x).alias(f"m{x}") for x in usable])
        whole = now if missed is None else now.unionByName(missed)
        old, missed = missed, scratch.write(whole.groupBy("id").agg(*[F.sum(c).alias(c) for c in ["missed", *columns]]), "vector-missed")
        scratch.drop(found, *([] if old is None else [old]))
        done += more
        means = [F.avg(F.exp("missed")).alias("now")]
        means += [F.avg(F.exp(F.col("missed") + F.col(f"m{x}") * (q / done))).alias(f"{x}-{q}") for x in usable for q in MORE]
        mean = missed.agg(*means).first()
        if mean["now"] <= 1 - RECALL:
            break
        cost = [(q * (TRIED[x] + ROW_COST), x, q) for x in usable for q in MORE if mean[f"{x}-{q}"] <= 1 - RECALL]
        _, k, more = min(cost, default=(0, usable[-1], MORE[-1]))
    none = firsts.sparkSession.createDataFrame([], "a long, b long")
    return reduce(DataFrame.unionByName, links, none), done


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tile_counts(threshold: float):
    """Linked vectors in a tile for each of its members: of block y for those
    of block x and the other way round, by component."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.lexsort((rows["id"].to_numpy(), rows["component"].to_numpy()))
        component, ids, copies, side = (rows[c].to_numpy()[order] for c in ("component", "id", "copies", "side"))
        v = _matrix(rows["v"].combine_chunks())[order]
        crossed = rows["x"][0].as_py() != rows["y"][0].as_py()
        linked = np.zeros(len(ids), dtype=np.int64)
        edges = np.append(np.flatnonzero(np.append(True, component[1:] != component[:-1])), len(ids))
        for at, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            u = _unit(v[at:end])
            left = at + np.flatnonzero(side[at:end] == 0)
            right = at + np.flatnonzero(side[at:end] == 1) if crossed else left
            for start in range(0, len(left), 512):
                part = left[start : start + 512]
                near = u[part - at] @ u[right - at].T >= threshold
                linked[part] += near @ copies[right]
                if crossed:
                    linked[right] += near.T @ copies[part]
        return pa.table({"id": ids, "linked": linked})

    return run


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in _by_length(whole, 3):
            cosine = (_unit(_matrix(b.column(3))) * _unit(_matrix(b.column(4)))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.arccos(np.clip(cosine, -1, 1))), b.column(5)], names=["id", "component", "copies", "v", "theta", "blocks"])


def _link_counts(firsts: DataFrame, component: DataFrame, threshold: float, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(id, linked) for every member of a component: copies of vectors linked
    with it, its own included."""
    widest = math.acos(threshold)
    grouped = write(firsts.join(component, "id").select("id", "component", "copies", "v"), "vector-groups")
    large = component.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
    large = write(large.select("component", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "vector-large")
    n_large = large.count()
    # Sent to all tasks: a few numbers, or one vector, for each large component.
    hint = F.broadcast if n_large <= 4096 else (lambda x: x)
    base = ["component", "id", "copies", "v"]

    small = grouped.join(hint(large), "component", "left_anti")
    packs = F.lit(max(-(-firsts.count() // BLOCK), partitions(firsts.sparkSession)))
    zero = F.lit(0).cast("long")
    tiles = small.select(F.pmod(F.xxhash64("component"), packs).alias("pack"), *base, zero.alias("x"), zero.alias("y"), F.lit(0).alias("side"))
    settled = None
    if n_large:
        centre = write(grouped.join(hint(large), "component").where("id = component").select("component", F.col("v").alias("cv"), "blocks"), "vector-centres")
        placed = grouped.join(hint(centre), "component").select("id", "component", "copies", "v", "cv", "blocks")
        placed = write(map_batches(placed, _angles, "id long, component long, copies long, v array<double>, theta double, blocks int"), "vector-angles")
        cuts = placed.groupBy("component").agg(F.percentile_approx("theta", [i / 64 for i in range(1, 64)], 10_000).alias("q"))
        inner = F.shiftleft(F.size(F.filter("q", lambda c: c < F.col("theta"))).cast("long"), 32)
        block = inner + F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("blocks") / 64)))
        dealt = write(placed.join(hint(cuts), "component").select(*base, "theta", block.alias("block")), "vector-dealt")
        shown = write(dealt.groupBy("component", "block").agg(F.min("theta").alias("lo"), F.max("theta").alias("hi"), F.sum("copies").alias("copies")), "vector-blocks")
        # A row for each pair of blocks of a component: no vector is in it.
        pairs = shown.alias("a").join(shown.alias("b"), (F.col("a.component") == F.col("b.component")) & (F.col("a.block") <= F.col("b.block")))
        full = F.col("a.hi") + F.col("b.hi") < widest - 1e-7
        none = (F.col("a.lo") - F.col("b.hi") > widest + 1e-7) | (F.col("b.lo") - F.col("a.hi") > widest + 1e-7)
        state = F.when(full, 1).when(none, 0)
        pairs = write(pairs.select(F.col("a.component").alias("component"), F.col("a.block").alias("x"), F.col("b.block").alias("y"), F.col("a.copies").alias("cx"), F.col("b.copies").alias("cy"), state.alias("state")), "vector-tiles")
        sure = pairs.where("state = 1")
        sure = sure.select("component", F.col("x").alias("block"), F.col("cy").alias("n")).unionByName(sure.where("x < y").select("component", F.col("y").alias("block"), F.col("cx").alias("n")))
        sure = sure.groupBy("component", "block").agg(F.sum("n").alias("n"))
        settled = dealt.join(sure, ["component", "block"]).select("id", F.col("n").alias("linked"))
        open_ = pairs.where("state is null").select("component", "x", "y")
        left = dealt.withColumnRenamed("block", "x").join(open_, ["component", "x"]).withColumn("side", F.lit(0))
        right = dealt.withColumnRenamed("block", "y").join(open_.where("x < y"), ["component", "y"]).withColumn("side", F.lit(1))
        crowd = left.unionByName(right).select((-1 - F.col("component")).alias("pack"), *base, "x", "y", "side")
        tiles = tiles.unionByName(crowd)
    # Vectors of one length at a time: a pack may have components of several.
    tiles = tiles.withColumn("dim", F.size("v")).groupBy("dim", "pack", "x", "y").applyInArrow(_tile_counts(threshold), "id long, linked long")
    linked = tiles if settled is None else tiles.unionByName(settled)
    return write(linked.groupBy("id").agg(F.sum("linked").alias("linked")), "vector-linked")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Per vector: id, n_links, component_id, kept (id = component_id).

    Links have a cosine of ``threshold`` or more, in double precision. Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing; the others link with vectors of their own length. Every row is a
    vector of its own, also where an id repeats or is missing: such ids are left
    out of the smallest, and a row without one is kept if its component has
    none. Other columns are ignored; an empty table stays empty.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("given"), F.col(vector_col).cast("array<double>").alias("v"))
    rows, odd = numbered(rows, "given", "given", "v")
    scratch = Scratch()
    write = scratch.write
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = write(rows.select(F.col("node").alias("id"), "given", "v", F.coalesce(sound, F.lit(False)).alias("sound")), "vectors")
    good = rows.where("sound").select("id", "v")

    # Equal vectors: one row with a count.
    digest = F.struct(F.xxhash64("v").alias("x"), F.hash("v").alias("y"), F.size("v").alias("n"))
    classes = good.groupBy(digest.alias("digest")).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    member = write(good.select("id", digest.alias("digest")).join(classes, "digest").select("id", "first", "copies"), "vector-classes")
    firsts = write(good.join(member.where("id = first"), "id").select("id", "v", "copies"), "vector-firsts")

    n = firsts.count()
    # Single precision where the input has no more, to move half the bytes.
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    links = _passes(firsts, n, kind, threshold, scratch)[0]
    links = write(links.distinct(), "vector-links")
    component = connected_components(links)
    linked = _link_counts(firsts, component, threshold, write)

    of_class = member.join(linked.withColumnRenamed("id", "first"), "first", "left").join(component.withColumnRenamed("id", "first"), "first", "left")
    # A vector and its copies link with one another; "linked" counts its own class too.
    known = of_class.select("id", (F.coalesce("linked", "copies") - 1).alias("n_links"), F.coalesce("component", "first").alias("component"))
    out = write(rows.select("id", "given").join(known, "id", "left").select("given", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")), "vector-result")
    scratch.close(out)
    if odd:
        lowest = out.groupBy("component_id").agg(F.min("given").alias("lowest"))
        out = out.join(lowest, "component_id").select("given", "n_links", F.col("lowest").alias("component_id"))
    return out.withColumnRenamed("given", id_col).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


ORACLE_SQL = f"""
WITH RECURSIVE unit AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links,
       least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS kept
FROM embeddings
"""
