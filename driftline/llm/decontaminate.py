"""Benchmark decontamination: BM25 retrieval by block-max WAND, then overlap.

Test items are the indexed documents, passages of training texts the queries.
Spark counts the terms of all items once: document frequencies, lengths and
impacts are those of the whole benchmark, however many shards the index has.
An item's impacts are divided by its own total, so a passage that holds every
term of an item scores 1 on it whatever the item's length, and one threshold
serves all. Passages are twice as long as the longest item and start at every
half of that, so each item lies whole in some passage.

A passage is bounded before it's searched: for each block of items the largest
impacts of its distinct terms are added up, for a whole batch of passages at
once, and only blocks that reach the threshold are opened. WAND then walks the
posting lists of the passage's terms item by item within those blocks: it moves
to the first item where the upper bounds of the lists before it could add up to
the threshold. Both bounds are exact, so every item above the threshold is
found. Block maxima are kept by posting list; only lists that reach a quarter of
all blocks have a dense row as well, so an index grows with its postings alone.
A found pair counts when enough of the item's five-word shingles occur in the
whole document, and some of its first half (the question) and of its second
(the answer) among them.

An index of up to ``SHARD`` postings is one file in the shared folder that each
Python worker reads once. A larger benchmark has several, and the texts are
searched once for each.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import HashTable, batch_of, kept, map_batches, materialize, mix64, open_read, open_write, runs, scratch_path, slices, word_hashes

K1, B = 1.2, 0.75
SCORE = 0.6  # of an item's total impact
OVERLAP_PERCENT = 80
SHINGLE = 5
SHARD = 2_000_000  # postings in one index: about 100 MB at most
WINDOW = 1 << 18  # words of a text that are searched at a time
ITEM_BLOCK = 4
SLACK = 1e-3  # of bounds, for their single precision
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        out = out * _GOLD + hashes[j : j + n]
    return mix64(out)


@dataclass
class Index:
    ids: np.ndarray  # of the items
    shingles: list[tuple[int, np.ndarray, int]]  # word count, distinct shingles in order, how many are the question's
    terms: HashTable  # word hash -> term
    lists: np.ndarray  # first entry of each term's list of blocks
    block: np.ndarray  # of each entry, ascending in a list
    bound: np.ndarray  # largest impact in it
    posts: np.ndarray  # first posting of each entry
    items: np.ndarray  # item of each posting, ascending in a list
    impacts: np.ndarray
    dense_of: np.ndarray  # term -> row of dense, or -1
    dense: np.ndarray  # bounds of long lists, rows x blocks
    passage: int  # words

    @property
    def blocks(self) -> int:
        return self.dense.shape[1]


def build(keys: np.ndarray, ids: np.ndarray, texts: list[bytes], post_key: np.ndarray, post_term: np.ndarray, post_impact: np.ndarray, passage: int) -> Index:
    """Items by ``keys``, and their postings (key, term, impact)."""
    hashes, at = _hash_each(texts)
    # Items of like length share blocks: their impacts are alike, bounds tight.
    order = np.lexsort((keys, np.diff(at)))
    shingles = []
    for i in order.tolist():
        w = hashes[at[i] : at[i + 1]]
        k = min(SHINGLE, len(w))
        run = rolled(w, k)
        first = np.sort(np.unique(run, return_index=True)[1])
        shingles.append((k, run[first], int((first < (len(run) + 1) // 2).sum())))
    by_key = np.argsort(keys[order], kind="stable")
    item = by_key[np.searchsorted(keys[order][by_key], post_key)] if len(keys) else np.zeros(0, np.int64)
    vocabulary, term = np.unique(post_term.view(np.uint64), return_inverse=True)
    sort = np.lexsort((item, term))
    term, item, impact = term[sort], item[sort], post_impact[sort]
    block = item // ITEM_BLOCK
    entry = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
    bound = np.maximum.reduceat(impact, entry) if len(entry) else np.zeros(0)
    lists = np.searchsorted(term[entry], np.arange(len(vocabulary) + 1))
    n_blocks = max(1, -(-len(order) // ITEM_BLOCK))
    long = np.flatnonzero(np.diff(lists) * 4 >= n_blocks)
    dense_of = np.full(len(vocabulary), -1, dtype=np.int64)
    dense_of[long] = np.arange(len(long))
    dense = np.zeros((len(long), n_blocks), dtype=np.float32)
    row = np.repeat(dense_of, np.diff(lists))
    dense[row[row >= 0], block[entry][row >= 0]] = bound[row >= 0]
    table = HashTable(vocabulary, np.arange(len(vocabulary), dtype=np.int32))
    return Index(ids[order], shingles, table, lists, block[entry], bound, np.append(entry, len(term)), item, impact, dense_of, dense, passage)


def _hash_each(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [word_hashes([t])[0] for t in texts]
    return np.concatenate([*found, np.zeros(0, np.uint64)]), np.append(0, np.cumsum([len(f) for f in found])).astype(np.int64)


def _entries(index: Index, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the terms' lists, and for each the place of its term."""
    n = index.lists[terms + 1] - index.lists[terms]
    return np.repeat(index.lists[terms], n) + runs(n), np.repeat(np.arange(len(terms)), n)


def block_max_wand(index: Index, terms: np.ndarray, blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with score >= threshold in the given blocks."""
    out = []
    entry, _ = _entries(index, terms)
    entry = entry[np.isin(index.block[entry], blocks)]
    entry = entry[np.argsort(index.block[entry], kind="stable")]
    cuts = np.flatnonzero(np.append(True, np.diff(index.block[entry]) != 0)).tolist() if len(entry) else []
    for start, stop in zip(cuts, [*cuts[1:], len(entry)], strict=True):
        lists = []
        for e in entry[start:stop].tolist():
            i, j = index.posts[e], index.posts[e + 1]
            lists.append([0, index.items[i:j].tolist(), index.impacts[i:j].tolist(), float(index.bound[e])])
        while lists:
            lists.sort(key=lambda x: x[1][x[0]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= threshold - SLACK:
                    pivot = x[1][x[0]]
                    break
            if pivot is None:
                break
            found = []
            for x in lists:
                at, items = x[0], x[1]
                while at < len(items) and items[at] < pivot:
                    at += 1
                if at < len(items) and items[at] == pivot:
                    found.append(x[2][at])
                    at += 1
                x[0] = at
            # The exact sum: it doesn't depend on the order of the lists.
            score = math.fsum(found)
            if score >= threshold:
                out.append((pivot, score))
            lists = [x for x in lists if x[0] < len(x[1])]
    return out


def _open_blocks(index: Index, terms: np.ndarray, first: np.ndarray, threshold: float) -> np.ndarray:
    """Passages x blocks: whether the bounds of a passage's terms reach the
    threshold. Passage i has ``terms[first[i]:first[i + 1]]``."""
    n = len(first) - 1
    passage = np.repeat(np.arange(n), np.diff(first))
    row = index.dense_of[terms]
    long = np.flatnonzero(row >= 0)
    bound = np.zeros((n, index.blocks), dtype=np.float32)
    if len(long):
        own = passage[long]
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        bound[own[cut]] = np.add.reduceat(index.dense[row[long]], cut)
    short = np.flatnonzero(row < 0)
    entry, at = _entries(index, terms[short])
    if len(entry):
        cell = passage[short][at] * index.blocks + index.block[entry]
        bound += np.bincount(cell, weights=index.bound[entry], minlength=bound.size).reshape(bound.shape)
    return bound >= threshold - SLACK


def _retrieve(index: Index, hashes: np.ndarray, at: np.ndarray, threshold: float, best: dict[tuple[int, int], float]) -> None:
    """Best scores of (text, item) over the passages of the texts' words."""
    term, known = index.terms.get(hashes, -1)
    n_words = np.diff(at)
    step = index.passage // 2
    # Half passages: number of each word's, counted on over all texts.
    halves = -(-n_words // step)
    first_half = np.append(0, np.cumsum(halves))
    where = np.flatnonzero(known)
    text = np.searchsorted(at, where, side="right") - 1
    t, h = term[where].astype(np.int64), first_half[text] + (where - at[text]) // step
    text_of = np.repeat(np.arange(len(n_words)), halves)
    n_terms = len(index.dense_of)
    # A passage is a half and the next of the same text; a term counts once.
    ok = (h > 0) & (text_of[np.maximum(h - 1, 0)] == text_of[h])
    pairs = np.unique(np.concatenate([h * n_terms + t, (h[ok] - 1) * n_terms + t[ok]]))
    passage, tt = pairs // n_terms, pairs % n_terms
    if not len(passage):
        return
    start = np.append(np.flatnonzero(np.append(True, passage[1:] != passage[:-1])), len(passage))
    # Bounds of whole runs of passages, a few million sums at a time.
    rows = max(1, min((1 << 21) // index.blocks, 512))
    for a in range(0, len(start) - 1, rows):
        cut = start[a : a + rows + 1]
        open_ = _open_blocks(index, tt[cut[0] : cut[-1]], cut - cut[0], threshold)
        for s in np.flatnonzero(open_.any(axis=1)).tolist():
            own = int(text_of[passage[cut[s]]])
            for item, score in block_max_wand(index, tt[cut[s] : cut[s + 1]], np.flatnonzero(open_[s]), threshold):
                best[own, item] = max(best.get((own, item), 0.0), score)


def search(index: Index, texts: list[bytes], threshold: float = SCORE) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(text, item, best score, shared shingles, of the question, of the answer)
    for retrieved pairs; not yet cut by overlap."""
    hashes, at = word_hashes(texts)
    if not len(hashes) or not len(index.ids):
        return
    best: dict[tuple[int, int], float] = {}
    if len(texts) > 1 or len(hashes) <= 2 * WINDOW:
        _retrieve(index, hashes, at, threshold, best)
    else:  # a very long text, window by window; each begins with the half before it
        step = index.passage // 2
        wide = -(-WINDOW // step) * step
        for low in range(0, len(hashes), wide):
            own = hashes[max(0, low - step) : low + wide]
            _retrieve(index, own, np.array([0, len(own)]), threshold, best)
    sets: dict[tuple[int, int], np.ndarray] = {}
    for (text, item), score in sorted(best.items()):
        k, shingles, question = index.shingles[item]
        if (text, k) not in sets:
            sets[text, k] = np.unique(rolled(hashes[at[text] : at[text + 1]], k))
        hit = np.isin(shingles, sets[text, k])
        yield text, item, score, int(hit.sum()), int(hit[:question].sum()), int(hit[question:].sum())


def _contaminated(index: Index, texts: list[bytes], percent: int) -> list[tuple]:
    out = []
    for text, item, score, shared, question, answer in search(index, texts):
        n = len(index.shingles[item][1])
        if 100 * shared >= percent * n and question and (answer or n == 1):
            out.append((text, item, n, shared, score, question, answer))
    return out


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("score", pa.float64()), ("question_shared", pa.int64()), ("answer_shared", pa.int64())]
)


_TERMS = pa.schema([("item", pa.int64()), ("term", pa.int64()), ("tf", pa.int64()), ("length", pa.int64())])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, "text"):
        hashes, at = word_hashes(texts)
        for i, item in enumerate(batch.column(0).to_pylist()):
            term, tf = np.unique(hashes[at[i] : at[i + 1]], return_counts=True)
            n = np.full(len(term), item), term.view(np.int64), tf, np.full(len(term), at[i + 1] - at[i])
            yield batch_of(_TERMS, list(n))


def _read(path: str) -> Index:
    with open_read(path) as f:
        return pickle.loads(f.read())


def _pairs(path: str, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = kept(path, partial(_read, path))
    for batch, texts in slices(batches, "text"):
        ids = batch.column(0)
        rows = [(ids[text].as_py(), int(index.ids[item]), n, *rest) for text, item, n, *rest in _contaminated(index, texts, percent)]
        if rows:
            yield batch_of(_OUT, [list(c) for c in zip(*rows, strict=True)])


def _clean(path: str, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = kept(path, partial(_read, path))
    for batch, texts in slices(batches, "text"):
        keep = np.ones(len(texts), dtype=bool)
        keep[[row[0] for row in _contaminated(index, texts, percent)]] = False
        yield batch.filter(pa.array(keep))


def indexes(benchmark: DataFrame, shard: int = SHARD) -> list[str]:
    """Index files of at most about ``shard`` postings each, all with the
    statistics of the whole benchmark. The driver holds one shard at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.where("item_id is not null and text is not null").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    posts = materialize(map_batches(items.select("item", "text"), _item_terms, "item long, term long, tf long, length long"), "bm25-terms")
    # Items without words have no postings and drop out: nothing can contain them.
    lengths = posts.groupBy("item").agg(F.first("length").alias("length"))
    n, mean, longest = lengths.agg(F.count("*"), F.avg("length"), F.max("length")).first()
    total = posts.count()
    if not n:
        return []
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    posts = posts.join(df, "term").select("item", "term", impact.alias("impact"))
    whole = posts.groupBy("item").agg(F.sum("impact").alias("whole"))
    shards = -(-total // shard)
    own = F.pmod(F.xxhash64("item"), F.lit(shards))
    posts = materialize(posts.join(whole, "item").select(own.alias("shard"), "item", "term", (F.col("impact") / F.col("whole")).alias("impact")), "bm25-postings")
    items = items.join(whole.select("item"), "item", "left_semi").withColumn("shard", own)
    out = []
    for i in range(shards):
        rows = items.where(F.col("shard") == i).orderBy("item").select("item", "item_id", "text").toArrow()
        post = posts.where(F.col("shard") == i).toArrow()
        index = build(rows["item"].to_numpy(), rows["item_id"].to_numpy(), [t.encode() for t in rows["text"].to_pylist()], *(post[c].to_numpy() for c in ("item", "term", "impact")), 2 * longest)
        out.append(scratch_path(spark, "bm25-index"))
        with open_write(out[-1]) as f:
            f.write(pickle.dumps(index))
    return out


_PAIRS = "doc_id long, item_id long, n_item long, n_shared long, score double, question_shared long, answer_shared long"


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, percent: int = OVERLAP_PERCENT, shard: int = SHARD) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, score, question_shared,
    answer_shared) of every document that holds a test item.

    Null and blank texts hold nothing; null items are left out; rows of the
    benchmark that repeat both id and text are one item, rows that share an id
    only are items of their own; documents that repeat an id are searched one by
    one; very long texts window by window; other columns are ignored; empty
    tables give no pairs. Pairs and scores are the same for any ``shard``.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [map_batches(rows, partial(_pairs, path, percent), _PAIRS) for path in indexes(benchmark, shard)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], _PAIRS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = OVERLAP_PERCENT, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that hold no test item."""
    for path in indexes(benchmark, shard):
        docs = map_batches(docs, partial(_clean, path, percent), docs.schema)
    return docs


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingle_sql(table: str, key: str) -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+')"
    return (
        f"SELECT DISTINCT {key}, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s "
        f"FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)"
    )


ORACLE_SQL = f"""
WITH item AS ({_shingle_sql("benchmark", "item_id")}),
doc AS ({_shingle_sql("documents", "doc_id")}),
size AS (SELECT item_id, count(*) AS n_item FROM item GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc JOIN item USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM shared JOIN size USING (item_id)
WHERE 100 * n_shared >= {OVERLAP_PERCENT} * n_item
"""
