"""Language-model scores by context-tree weighting over bytes.

Texts become words joined by single spaces and closed by a line end. Each byte
is coded as eight binary decisions, and every decision (the bits of the byte so
far) has a context tree of its own over the ``DEPTH`` bytes before. A node s at
depth d keeps its counts of zeros a and ones b, the Krichevsky-Trofimov
estimate of its sequence, and the weighted probability::

    P_w(s) = (P_kt(a, b) + prod over longer contexts P_w(cs)) / 2

with P_w = P_kt at full depth. What follows a context is predicted by mixing
the nodes on its path: node s takes the share P_kt / (2 P_w) of its own
estimate (b + 1/2) / (a + b + 1), the rest goes to the node below. A context
that training never saw ends the path at the last node it did see. The model is
a proper distribution over texts, so -log2 of it is a code length, here also per
byte.

In Spark: each task reduces its texts to distinct (context, byte) pairs and
counts; a shuffle adds them up; pairs are dealt by the last two context bytes,
or by three where two are common, so a task holds whole subtrees, builds them
bottom up and scores every distinct pair once. The levels above need at most 256
* 255 sums, and as many again for each of at most ``SPLIT`` common pairs of
bytes. Texts are then
scored by looking up their pairs, in a table that executors read from the shared
folder in blocks of about ``BLOCK`` pairs: beyond that, block after block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import PART, HashTable, batch_of, kept, map_batches, materialize, open_read, partitions, parts, scratch_path, segment_sum, slices, word_hashes

DEPTH = 6  # context bytes; a pair fits 8 * (DEPTH + 1) bits
BLOCK = 4_000_000
#: Contexts of two bytes with more than this part of all pairs are dealt finer.
SPLIT = 512
TASK = 150_000  # pairs in a task, on the average, at most
FOLDS, HELD_OUT = 5, 1
_END = b"\n"
_LOG10 = np.log(10.0)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that the model doesn't learn from. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def normal_parts(text: bytes) -> Iterator[bytes]:
    """The normal form of a text: lower-cased words (A-Z) joined by single
    spaces and closed by a line end; a long text in parts."""
    if len(text) <= PART:
        yield b" ".join(text.lower().split()) + _END
        return
    begun = False
    for part in parts(text):
        if stream := b" ".join(part.lower().split()):
            yield b" " + stream if begun else stream
            begun = True
    yield _END


def pair_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every byte of the normal form of the texts, as one
    integer, and offsets by text. The context before a text is line ends."""
    streams = [b"".join(normal_parts(t)) for t in texts]
    n = np.array([len(s) for s in streams], dtype=np.int64)
    return _codes([_END * DEPTH] * len(streams), streams), np.append(0, np.cumsum(n))


def _codes(before: list[bytes], streams: list[bytes]) -> np.ndarray:
    """Codes of all bytes of the streams, each after its ``DEPTH`` bytes."""
    data = np.frombuffer(b"".join(x for pair in zip(before, streams, strict=True) for x in pair), dtype=np.uint8).astype(np.uint64)
    n = np.array([len(s) for s in streams], dtype=np.int64)
    code = np.zeros(len(data) - DEPTH, dtype=np.uint64)
    for j in range(DEPTH + 1):
        code = (code << np.uint64(8)) | data[j : len(data) - DEPTH + j]
    inside = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * DEPTH, n)
    return code[inside]


def code_parts(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``pair_codes`` a part at a time: (codes, offsets) of all the texts, more
    than once where a single text is long."""
    if len(texts) > 1 or len(texts[0]) <= PART:
        yield pair_codes(texts)
        return
    before = _END * DEPTH
    for part in normal_parts(texts[0]):
        yield _codes([before], [part]), np.array([0, len(part)])
        before = (before + part)[-DEPTH:]


class _Tally:
    """Counts of keys, merged whenever they fill the buffer."""

    def __init__(self, limit: int = 500_000) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.limit = 0, limit

    def add(self, keys: np.ndarray, weights: np.ndarray | None) -> None:
        """Count the keys; with weights 0 they are noted and not counted."""
        if weights is None:
            u, c = np.unique(keys, return_counts=True)
        else:
            u, c = np.unique(keys), 0
            c = np.zeros(len(u), dtype=np.int64)
        self.parts.append((u, c.astype(np.int64)))
        self.held += len(u)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.parts = [(keys[first], np.add.reduceat(counts, first))]
        self.held = len(first)
        return self.parts[0]

    def full(self) -> bool:
        return self.held > self.limit


_COUNTS = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64())])
_PAIR, _WORD, _TOKENS = 0, 1, 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of all texts, counted in training texts only; words of training
    texts; training tokens."""
    kept("counting", dict)  # lets go of an earlier job's tables
    tallies = {_PAIR: _Tally(), _WORD: _Tally()}
    tokens = 0

    def emit(kind: int) -> Iterator[pa.RecordBatch]:
        keys, counts = tallies[kind].merge()
        tallies[kind] = _Tally()
        for i in range(0, len(keys), 1 << 16):
            part = keys[i : i + (1 << 16)]
            yield batch_of(_COUNTS, [np.full(len(part), kind, dtype=np.int8), part.view(np.int64), counts[i : i + (1 << 16)]])

    buffers: dict[bool, list[bytes]] = {False: [], True: []}
    held = {False: 0, True: 0}

    def flush(out: bool) -> None:
        nonlocal tokens
        if not buffers[out]:
            return
        for code, _ in code_parts(buffers[out]):
            tallies[_PAIR].add(code, np.zeros(0) if out else None)
            if tallies[_PAIR].held > 4 * tallies[_PAIR].limit:
                tallies[_PAIR].merge()
        if not out:
            hashes, _ = word_hashes(buffers[out])
            tallies[_WORD].add(hashes, None)
            tokens += len(hashes) + len(buffers[out])
        buffers[out], held[out] = [], 0

    for batch, texts in slices(batches, "text"):
        for out, text in zip(batch.column(1).to_pylist(), texts, strict=True):
            if len(text) > PART:  # alone, so that it's taken in parts
                flush(out)
            buffers[out].append(text)
            held[out] += len(text)
            if held[out] > 1 << 19:
                flush(out)
        for kind in tallies:
            if tallies[kind].full():
                tallies[kind].merge()
                if tallies[kind].full():
                    yield from emit(kind)
    flush(False), flush(True)
    for kind in tallies:
        yield from emit(kind)
    if tokens:
        yield batch_of(_COUNTS, [[_TOKENS], [0], [tokens]])


# -- the tree ------------------------------------------------------------------

def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight; good to 1e-13 for x >= 1/2."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * np.where(x < 1e6, x + k, 1.0)
    y = np.where(x < 1e6, x + 8, x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(shift)


class Subtrees:
    """The nodes of depths ``top`` to DEPTH over pairs that share contexts."""

    def __init__(self, code: np.ndarray, n: np.ndarray, top: int) -> None:
        self.top, self.size = top, len(code)
        context, byte = code >> np.uint64(8), (code & np.uint64(255)).astype(np.int64)
        self.sorted = {}
        for d in range(top, DEPTH + 1):
            suffix = context & np.uint64((1 << 8 * d) - 1)
            order = np.lexsort((byte, suffix))
            s = suffix[order]
            self.sorted[d] = order, np.append(True, s[1:] != s[:-1])[: len(s)], byte[order], n[order].astype(np.float64)

    def levels(self, bit: int) -> dict[int, tuple]:
        """By depth: each pair's node; the nodes' totals, ones, shares, log P_w."""
        out: dict[int, tuple] = {}
        for d in range(DEPTH, self.top - 1, -1):
            order, new, v, c = self.sorted[d]
            # Rows of one context and one bit prefix are neighbours.
            new = new.copy()
            new[1:] |= (v[1:] >> (8 - bit)) != (v[:-1] >> (8 - bit))
            start = np.flatnonzero(new)
            at = np.empty(self.size, dtype=np.int64)
            at[order] = np.cumsum(new) - 1
            total = np.add.reduceat(c, start)
            ones = np.add.reduceat(c * ((v >> (7 - bit)) & 1), start)
            kt = _log_kt(total - ones, ones)
            if d == DEPTH:
                weighted, share = kt, np.ones(len(start))
            else:
                # The product over the nodes below: each counts once.
                child_at, child = out[d + 1][0], out[d + 1][4]
                product = np.bincount(at[_firsts(child_at, len(child))], weights=child, minlength=len(start))
                weighted = np.logaddexp(kt, product) - np.log(2.0)
                share = np.exp(np.minimum(kt - weighted - np.log(2.0), 0.0))
            out[d] = at, total, ones, share, weighted
        return out

    def nodes(self) -> tuple[np.ndarray, ...]:
        """Of the top level: first row of each node, bit, zeros, ones, log P_w."""
        out = []
        for bit in range(8):
            at, total, ones, _, weighted = self.levels(bit)[self.top]
            out.append((_firsts(at, len(total)), np.full(len(total), bit), total - ones, ones, weighted))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def predict(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """For every pair: the mixture of the top level and those below for a
        one, and whether training saw the top node."""
        levels = self.levels(bit)
        mix = known = None
        for d in range(DEPTH, self.top - 1, -1):
            at, total, ones, share, _ = levels[d]
            own = ((ones + 0.5) / (total + 1.0))[at]
            mix = own if known is None else np.where(known, share[at] * own + (1 - share[at]) * mix, own)
            known = total[at] > 0
        return mix, known


def _firsts(at: np.ndarray, n: int) -> np.ndarray:
    """The first row of each of n nodes."""
    first = np.empty(n, dtype=np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    return first


def _prefix(byte: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Number of a bit prefix among the 255 inner nodes of a byte."""
    return (1 << bit) - 1 + (byte >> (8 - bit))


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([g[0] for g in got]).view(np.uint64), np.concatenate([g[1] for g in got])


_SUMS = pa.schema([("depth", pa.int32()), ("context", pa.int32()), ("prefix", pa.int32()), ("zeros", pa.float64()), ("ones", pa.float64()), ("weighted", pa.float64())])
_SCORES = pa.schema([("key", pa.int64()), ("logp", pa.float64())])


def _split(code: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of contexts that are not common, and rows of those that are."""
    hit = np.isin((code >> np.uint64(8)) & np.uint64(0xFFFF), common)
    return np.flatnonzero(~hit), np.flatnonzero(hit)


def _top_sums(common: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over this task's highest nodes for the nodes above them: of depth 1,
    or of depth 2 for common contexts."""
    code, n = _read(batches)
    for depth, rows in zip((1, 2), _split(code, common), strict=True):
        if not len(rows):
            continue
        own = code[rows]
        first, bit, zeros, ones, weighted = Subtrees(own, n[rows], depth + 1).nodes()
        context = ((own[first] >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)).astype(np.int64)
        node = context * 255 + _prefix((own[first] & np.uint64(255)).astype(np.int64), bit)
        u, inverse = np.unique(node, return_inverse=True)
        sums = [np.bincount(inverse, weights=w, minlength=len(u)) for w in (zeros, ones, weighted)]
        yield batch_of(_SUMS, [np.full(len(u), depth, dtype=np.int32), (u // 255).astype(np.int32), (u % 255).astype(np.int32), *sums])


@dataclass
class Root:
    """The highest nodes: counts and shares by (context, prefix)."""

    common: np.ndarray  # sorted contexts of two bytes
    total: list[np.ndarray]  # by depth 0, 1, 2; depth 2 has rows for common contexts only
    ones: list[np.ndarray]
    share: list[np.ndarray]

    def mix(self, depth: int, context: np.ndarray, prefix: np.ndarray, below: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixture with the nodes of a depth, and which of them training saw."""
        total, ones, share = (x[depth][context, prefix] for x in (self.total, self.ones, self.share))
        own = (ones + 0.5) / (total + 1)
        return np.where(seen, share * own + (1 - share) * below, own), total > 0


def _root(sums: pa.Table, common: np.ndarray) -> Root:
    depth, context, prefix = (sums[c].to_numpy() for c in ("depth", "context", "prefix"))
    level = {}
    for d, rows in ((2, len(common)), (1, 256)):
        at = np.flatnonzero(depth == d)
        where = context[at] if d == 1 else np.searchsorted(common, context[at])
        level[d] = [np.zeros((rows, 255)) for _ in range(3)]
        for grid, name in zip(level[d], ("zeros", "ones", "weighted"), strict=True):
            grid[where, prefix[at]] = sums[name].to_numpy()[at]

    def weigh(zeros: np.ndarray, ones: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kt = _log_kt(zeros, ones)
        weighted = np.logaddexp(kt, product) - np.log(2.0)
        return weighted, np.exp(np.minimum(kt - weighted - np.log(2.0), 0.0))

    weighted2, share2 = weigh(*level[2])
    last = (common & 255).astype(np.int64)
    for grid, more in zip(level[1], (level[2][0], level[2][1], weighted2), strict=True):
        np.add.at(grid, last, more)
    weighted1, share1 = weigh(*level[1])
    level[0] = [level[1][0].sum(axis=0, keepdims=True), level[1][1].sum(axis=0, keepdims=True), weighted1.sum(axis=0, keepdims=True)]
    _, share0 = weigh(*level[0])
    return Root(common, [level[d][0] + level[d][1] for d in range(3)], [level[d][1] for d in range(3)], [share0, share1, share2])


def _pair_scores(root: Root, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """log10 P(byte | context) of every pair of this task."""
    all_codes, n = _read(batches)
    for depth, rows in zip((1, 2), _split(all_codes, root.common), strict=True):
        if not len(rows):
            continue
        code = all_codes[rows]
        trees = Subtrees(code, n[rows], depth + 1)
        byte = (code & np.uint64(255)).astype(np.int64)
        context = ((code >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64)
        logp = np.zeros(len(code))
        for bit in range(8):
            p = _prefix(byte, np.int64(bit))
            mix, seen = trees.predict(bit)
            if depth == 2:
                mix, seen = root.mix(2, np.searchsorted(root.common, context), p, mix, seen)
            mix, seen = root.mix(1, context & 255, p, mix, seen)
            mix, _ = root.mix(0, np.zeros_like(p), p, mix, seen)
            logp += np.log(np.where((byte >> (7 - bit)) & 1 == 1, mix, 1 - mix))
        for i in range(0, len(code), 1 << 16):
            yield batch_of(_SCORES, [code[i : i + (1 << 16)].view(np.int64), logp[i : i + (1 << 16)] / _LOG10])


# -- scoring -------------------------------------------------------------------

_OUT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]
)
_OUT_SQL = "doc_id long, held_out boolean, row long, n_tokens long, n_bytes long, n_known long, base double, score double"
_SUMMED = ("n_known", "base", "score")


def _load(files: tuple[str, ...]) -> tuple[HashTable, HashTable]:
    """Pairs and words of one block, from the shared folder."""
    none = np.zeros(0, np.uint64)
    room = 0
    for f in files:
        with open_read(f) as stream:
            room += pq.ParquetFile(stream).metadata.num_rows
    pairs, counts = HashTable(none, np.zeros(0, np.float32), room), HashTable(none, np.zeros(0, np.int64))
    for f in files:  # a file at a time: only the tables grow
        with open_read(f) as stream:
            for got in pq.ParquetFile(stream).iter_batches(1 << 18, columns=["kind", "key", "value"]):
                kind, key, value = (c.to_numpy(zero_copy_only=False) for c in got.columns)
                key, pair, word = key.view(np.uint64), kind == _PAIR, kind == _WORD
                pairs.add(key[pair], value[pair].astype(np.float32))
                counts.add(key[word], value[word].astype(np.int64))
    return pairs, counts


def _lookup(files: tuple[str, ...], ends: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over one block of the tables: tokens found, their log10 counts plus
    1/2 less log10 of 1/2, and the log10 probabilities of pairs. ``ends`` is
    the count of the end token, in one of the blocks."""
    pairs, counts = kept(files, partial(_load, files))
    gain = float(np.log10(ends + 0.5) - np.log10(0.5))
    for batch, texts in slices(batches, "text"):
        logp, n_bytes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for code, offsets in code_parts(texts):
            logp += segment_sum(pairs.get(code, 0.0)[0].astype(np.float64), offsets)
            n_bytes += np.diff(offsets)
        hashes, at = word_hashes(texts)
        c, found = counts.get(hashes, 0)
        base = segment_sum(np.log10(c + 0.5) - np.log10(0.5), at) + gain
        known = segment_sum(found, at) + int(ends > 0)
        yield batch_of(_OUT, [batch.column(0), batch.column(1), batch.column(2), np.diff(at) + 1, n_bytes, known, base, logp])


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n): pairs, training words and training tokens."""
    counted = map_batches(docs.select("doc_id", "held_out", "text"), _count, "kind byte, key long, n long")
    return materialize(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-counts")


def pair_probabilities(counts: DataFrame, split: int = SPLIT) -> DataFrame:
    """(key, logp): log10 P(byte | context) for every pair of the corpus."""
    pairs = counts.where(F.col("kind") == _PAIR).select("key", "n")
    two = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    # At most 65,536 rows; the common ones among them are fewer than ``split``.
    sizes = materialize(pairs.groupBy(two.alias("context")).agg(F.count("*").alias("pairs")), "ctw-contexts")
    total = sizes.agg(F.sum("pairs")).first()[0] or 0
    found = sizes.where(F.col("pairs") > total / split).select("context").toArrow()["context"].to_numpy()
    common = np.sort(found).astype(np.uint64)
    dealt = F.when(two.isin(common.tolist()), F.shiftright("key", 8).bitwiseAND(0xFFFFFF) + (1 << 24)).otherwise(two) if len(common) else two
    n = max(1, partitions(counts.sparkSession), -(-total // TASK))
    pairs = pairs.repartition(n, dealt)
    sums = map_batches(pairs, partial(_top_sums, common), "depth int, context int, prefix int, zeros double, ones double, weighted double")
    # At most (256 + split) * 255 rows.
    sums = sums.groupBy("depth", "context", "prefix").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")])
    root = _root(sums.orderBy("depth", "context", "prefix").toArrow(), common)
    return materialize(map_batches(pairs, partial(_pair_scores, root), "key long, logp double"), "ctw-pairs")


def _blocks(model: DataFrame, words: DataFrame, blocks: int) -> list[tuple[str, ...]]:
    """Write both tables dealt to blocks by key; the files of each block. Only
    their names pass through the driver."""
    both = model.select(F.lit(_PAIR).cast("int").alias("kind"), "key", F.col("logp").alias("value"))
    both = both.unionByName(words.select(F.lit(_WORD).cast("int").alias("kind"), "key", F.col("n").cast("double").alias("value")))
    both = both.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    path = scratch_path(model.sparkSession, "ctw-tables")
    both.repartition("block", F.pmod("key", F.lit(8))).write.partitionBy("block").parquet(path)
    found: list[list[str]] = [[] for _ in range(blocks)]
    for f in model.sparkSession.read.schema("kind int, key long, value double, block int").parquet(path).inputFiles():
        if m := re.search(r"/block=(\d+)/", f):
            found[int(m[1])].append(f)
    return [tuple(sorted(f)) for f in found]


def score_texts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Code lengths of all texts under a model learned from the training texts.

    Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability of the text), bits_per_byte. A null text is empty
    and has its end only. Very long texts are coded in parts. Null ids are training rows; repeated rows are scored
    and learned from row for row; other columns are ignored. Without training
    rows every byte has one bit a decision; an empty table stays empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = corpus_counts(rows)
    model = pair_probabilities(counts)
    tokens = counts.where(F.col("kind") == _TOKENS).agg(F.sum("n")).first()[0] or 0
    words = counts.where(F.col("kind") == _WORD)
    n_words, vocabulary = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = tokens - n_words
    log_total = float(np.log10(tokens + 0.5 * (vocabulary + (ends > 0) + 1)))

    identified = rows.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("row"), "text")
    blocks = -(-max(model.count(), vocabulary, 1) // block)
    parts = []
    for i, files in enumerate(_blocks(model, words, blocks)):
        parts.append(map_batches(identified, partial(_lookup, files, ends if i == 0 else 0), _OUT_SQL))
    if blocks == 1:
        scored = parts[0]
    else:  # rows meet again by their id and text; equal rows have equal sums
        key = ["doc_id", "held_out", "row"]
        once = [p.groupBy(*key).agg(*[F.first(c).alias(c) for c in (*_SUMMED, "n_tokens", "n_bytes")], F.count("*").alias("copies")) for p in parts]
        union = reduce(DataFrame.unionByName, once)
        scored = union.groupBy(*key).agg(*[F.sum(c).alias(c) for c in _SUMMED], *[F.first(c).alias(c) for c in ("n_tokens", "n_bytes", "copies")])
        scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("n_tokens") * F.lit(float(np.log10(0.5)) - log_total)).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
