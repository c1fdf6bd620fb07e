"""Phrases of two to four words that keep together, by language.

Texts are cut into pieces in the JVM, and equal pieces become one with a
multiplicity. Blocks of pieces then count phrases a length at a time: a phrase
is sent only where both phrases it is made of, one word shorter, are common. A
block sends each distinct phrase once, with its weight, to the bucket of the
phrase's hash; DuckDB adds a bucket up out of core, and what is common goes back
to the blocks that asked. So a block ends up with the counts of every part of
its own common phrases, looked up by shuffled requests, and the block of the
least number that has a phrase scores it.

Phrases are told apart by 64-bit hashes of language and words; that two of n
share one has probability n^2 / 2^65. Counts and scores are whole numbers.

Defined cases: null texts are empty, a null language is ``und``; an empty table
and texts without words give no rows; repeated rows all count; columns of other
names are ignored. Long texts are split by the JVM; a piece is read whole.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.blocks import pack, read_block, unpack, write_blocks
from driftline.llm.common import Scratch, mix64, partitions, ship, span_hashes, words

LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
BLOCK = 8 << 20
#: Bytes of text for each phrase expected of a length, and phrases to a bucket.
_EXPECTED = {1: 30, 2: 8, 3: 40, 4: 60}
_BUCKET = 1 << 20
_SPLIT = r"[.,;:!?\x0A-\x0D]"
_MEMORY = "192MB"
_FOUND = "kind int, lang string, key long, phrase string, a long, l long, r long, score long"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_GAPS = np.zeros(256, dtype=bool)
_GAPS[[0x20, 0x0A]] = True


def distinct_pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m): pieces as words with single spaces, and how often."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(lang.alias("lang"), F.explode(F.split(text, _SPLIT)).alias("piece"))
    rows = rows.select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).where("piece <> ''")
    return rows.groupBy("lang", "piece").agg(F.count("*").alias("m"))


class Phrases:
    """The words of a block, and the phrases that begin at each."""

    def __init__(self, path: str) -> None:
        rows = read_block(path)
        self.langs = rows["lang"].combine_chunks().dictionary_encode()
        names = self.langs.dictionary.to_pylist()
        lang_of = self.langs.indices.to_numpy()
        pieces = rows["piece"].cast(pa.large_binary()).to_pylist()
        self.text = b"\n".join(pieces) + b"\n"
        self.start, self.end = words(np.frombuffer(self.text, np.uint8), _GAPS)
        begin = np.append(0, np.cumsum([len(p) + 1 for p in pieces]))[:-1]
        self.piece = np.searchsorted(begin, self.start, side="right") - 1
        seed = np.array([int.from_bytes(blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], dtype=np.uint64)
        self.names, self.lang = names, lang_of[self.piece]
        self.weight = rows["m"].to_numpy()[self.piece]
        hashes = span_hashes(np.frombuffer(self.text, np.uint8), self.start, self.end)
        self.key = {1: mix64(hashes ^ seed[self.lang])}
        for k in range(2, LONGEST + 1):
            before = self.key[k - 1]
            n = max(0, len(before) - 1)
            self.key[k] = mix64(before[:n] * np.uint64(0x9E3779B97F4A7C15) + self.key[1][k - 1 :][:n] + np.uint64(k))

    def whole(self, k: int) -> np.ndarray:
        """Where a phrase of k words lies within its piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :][:n]

    def counts(self, k: int, known: np.ndarray) -> np.ndarray:
        """What is known of the phrases of k words: columns of ``known`` for the
        sorted keys in its first, zeros for others."""
        key = self.key[k]
        out = np.zeros(len(key), dtype=np.int64)
        if len(known[0]):
            at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
            out = np.where((known[0][at] == key) & self.whole(k), known[1][at], 0)
        return out


def _known(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common phrases of a length that a block has: keys, counts, whether it's
    the block that scores them."""
    got = [unpack(d, np.uint64, np.int64, np.uint8) for d in data]
    if not got:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8)
    key, count, own = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(key)
    return key[order], count[order], own[order]


def _replies(rows: pa.Table) -> tuple[int, str, dict[int, list[bytes]]]:
    path = next(p for p in rows["path"].to_pylist() if p is not None)
    by_length: dict[int, list[bytes]] = {}
    for k, data in zip(rows["length"].to_pylist(), rows["data"].to_pylist(), strict=True):
        if data is not None:
            by_length.setdefault(k, []).append(data)
    return rows["block"][0].as_py(), path, by_length


def _ask(k: int, buckets: int, rows: pa.Table) -> pa.Table:
    """The block's distinct phrases of k words with their weights, by bucket."""
    block, path, replies = _replies(rows)
    p = Phrases(path)
    if k == 1:
        use = np.ones(len(p.piece), dtype=bool)
    else:
        common = p.counts(k - 1, _known(replies.get(k - 1, []))) > 0
        use = common[:-1] & common[1:]
        use = use[: len(p.whole(k))] & p.whole(k)
    at = np.flatnonzero(use)
    order = np.argsort(p.key[k][at])
    key, weight = p.key[k][at][order], p.weight[at][order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, dtype=np.int64)
    key, weight = key[new], np.add.reduceat(weight, new) if len(new) else weight
    cut = np.append(np.searchsorted(((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets)), len(key))
    sent = [(b, block, pack(key[i:j], weight[i:j])) for b, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]
    columns = zip(*sent, strict=True) if sent else [[]] * 3
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "data"])


def _add_up(k: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one bucket, by DuckDB out of core: it spills to a folder of the
    task's own, which goes with the task. Replies to each block that asked."""
    import duckdb

    folder = tempfile.mkdtemp(prefix="driftline-duckdb-")
    con = duckdb.connect(config={"memory_limit": _MEMORY, "threads": 1, "temp_directory": folder, "preserve_insertion_order": "false"})
    try:
        con.execute("CREATE TABLE asked (key UBIGINT, block BIGINT, m BIGINT)")
        for batch in batches:
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key, weight = unpack(data, np.uint64, np.int64)
                rows = pa.table({"key": key, "block": np.full(len(key), block), "m": weight})  # noqa: F841  read by the statement
                con.execute("INSERT INTO asked SELECT * FROM rows")
        con.execute(f"CREATE TABLE common AS SELECT key, sum(m)::BIGINT AS f, min(block) AS own FROM asked GROUP BY key HAVING sum(m) >= {least}")
        got = con.sql("SELECT block, key, f, own = block AS own FROM asked JOIN common USING (key) ORDER BY block").to_arrow_reader(1 << 17)
        held: list[pa.RecordBatch] = []

        def reply(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            data = pack(t["key"].to_numpy(), t["f"].to_numpy(), t["own"].to_numpy().astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([t["block"][0].as_py()]), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["block", "length", "data"])

        for batch in got:
            block = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0].column(0)[0].as_py() != block[i]:
                    yield reply(held)
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield reply(held)
    finally:
        con.close()
        shutil.rmtree(folder, ignore_errors=True)


def _score(scale: int, rows: pa.Table) -> pa.Table:
    """Candidates that the block is to score (kind 0), phrases that a longer
    one takes the place of (1), and words by language (2)."""
    _, path, replies = _replies(rows)
    p = Phrases(path)
    known = {k: _known(replies.get(k, [])) for k in range(1, LONGEST + 1)}
    f = {k: p.counts(k, known[k]) for k in known}
    found: list[tuple] = []
    signed = {k: p.key[k].view(np.int64) for k in p.key}
    for k in range(2, LONGEST + 1):
        mine = p.counts(k, (known[k][0], known[k][2]))
        at = np.flatnonzero(mine)
        _, first = np.unique(p.key[k][at], return_index=True)
        for i in at[np.sort(first)].tolist():
            a = int(f[k][i])
            cuts = [(scale * a // (int(f[c][i]) + int(f[k - c][i + c])), c) for c in range(1, k)]
            score, c = min(cuts)
            phrase = p.text[p.start[i] : p.end[i + k - 1]].decode()
            found.append((0, p.names[p.lang[i]], int(signed[k][i]), phrase, a, int(f[c][i]), int(f[k - c][i + c]), score))
            for s in range(2, k):
                for o in range(k - s + 1):
                    if 100 * a >= 80 * int(f[s][i + o]):
                        found.append((1, None, int(signed[s][i + o]), None, None, None, None, None))
    totals = np.zeros(len(p.names), dtype=np.int64)
    np.add.at(totals, p.lang, p.weight)
    for i, n in enumerate(totals.tolist()):
        found.append((2, p.names[i], None, None, n, None, None, None))
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = zip(*found, strict=True) if found else [[]] * 8
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "lang", "key", "phrase", "a", "l", "r", "score"])


def _on_blocks(blocks: DataFrame, replies: DataFrame | None, tasks: int):
    """Each block with the replies to it; few rows, but each is much work."""
    own = blocks.select("block", "path", F.lit(None).cast("int").alias("length"), F.lit(None).cast("binary").alias("data"))
    if replies is not None:
        own = own.unionByName(replies.select("block", F.lit(None).cast("string").alias("path"), "length", "data"))
    return own.repartition(tasks, "block").groupBy("block")


def _tables(f: Callable[..., pa.Table], *args: object) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        return f(*args, rows)

    return run


def _batches(f: Callable[..., Iterator[pa.RecordBatch]], *args: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return f(*args, batches)

    return run


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, scale: int = SCALE, block_bytes: int = BLOCK) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a: how often the phrase stands, ``least`` at least; l and r: how often the
    two parts do, at the cut with the least score ``scale * a // (l + r)``
    (equal ones: the shortest first part); n: words of the language. Phrases
    within a longer one that has four fifths of their count are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch()
    blocks = write_blocks(distinct_pieces(docs, text_col, lang_col), "piece", "phrase-blocks", block_bytes)
    scratch.tables.append(blocks)
    n_blocks, size = blocks.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    tasks = max(partitions(spark), n_blocks)
    all_replies, last = None, None
    for k in range(1, LONGEST + 1):
        buckets = max(1, -(-size // (_EXPECTED[k] * _BUCKET)), min(partitions(spark), n_blocks))
        asked = _on_blocks(blocks, last, tasks).applyInArrow(_tables(_ask, k, buckets), "bucket int, block long, data binary")
        last = scratch.write(asked.groupBy("bucket").applyInArrow(_batches(_add_up, k, least), "block long, length int, data binary"), f"phrase-replies-{k}")
        all_replies = last if all_replies is None else all_replies.unionByName(last)
    found = scratch.write(_on_blocks(blocks, all_replies, tasks).applyInArrow(_tables(_score, scale), _FOUND), "phrase-scores")
    scratch.close(found)
    candidates = found.where("kind = 0")
    n = found.where("kind = 2").groupBy("lang").agg(F.sum("a").alias("n"))
    left = candidates.join(found.where("kind = 1").select("key").distinct(), "key", "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
gram AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest(range(1, {LONGEST + 1})) AS k))),
f AS (SELECT lang, k, g, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= {LEAST}),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
cand AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM f WHERE k >= 2),
cut AS (
  SELECT c.lang, c.k, c.g, c.f AS a, c.c, x.f AS l, y.f AS r, ({SCALE}::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS c FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.k = c.c AND x.g = array_to_string(c.w[1 : c.c], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - c.c AND y.g = array_to_string(c.w[c.c + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_ AS (
  SELECT DISTINCT c.lang, array_to_string(c.w[c.o : c.o + c.s - 1], ' ') AS g, c.f
  FROM (SELECT *, unnest(range(1, k - s + 2)) AS o FROM (SELECT *, unnest(range(2, k)) AS s FROM cand)) c),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = b.lang AND i.g = b.g AND 100 * i.f >= 80 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
