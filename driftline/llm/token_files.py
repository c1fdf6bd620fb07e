"""Token ids in length-delimited binary files with an offset index.

One record a document, framed so that a reader can stream, check and resume::

    u64 length | u32 masked crc of those 8 bytes | payload | u32 masked crc of the payload

all little-endian. The payload is ``u8 flags | i64 doc_id | u32 n | n ids``;
flag 1: there is a doc_id; flag 2: ids take two bytes each, else four.
A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so
that a checksum over bytes that hold checksums stays sound. Beside each data
file lies an index of fixed-width entries (u64 offset, u32 frame length, u32
tokens): a reader that shuffles seeks to any record.

Shards hold ascending, disjoint ranges of document ids. A task writes its shard
under a name of its own attempt, and only the names that successful tasks return
make up the data set, so retries and lost executors leave no half-read files.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import PART, WHITE, HashTable, batch_of, kept, map_batches, open_read, open_write, pieces_of, scratch_path, slices, span_hashes

END_ID = 2
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<BqI")
_CRC = struct.Struct("<I")
_ENTRY = struct.Struct("<QII")
_DELTA = 0xA282EAD8  # the mask's constant; fixed value of the format


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, _CRC.pack(masked_crc(length)), payload, _CRC.pack(masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """The payload of one whole frame; raises ValueError where it's damaged."""
    if len(data) < _HEAD.size + _CRC.size:
        raise ValueError("record cut short")
    length, crc = _HEAD.unpack_from(data)
    if masked_crc(data[:8]) != crc:
        raise ValueError("damaged record length")
    payload = data[_HEAD.size : _HEAD.size + length]
    if len(data) != _HEAD.size + length + _CRC.size or masked_crc(payload) != _CRC.unpack_from(data, _HEAD.size + length)[0]:
        raise ValueError("damaged record")
    return payload


def pack_record(doc_id: int | None, ids: np.ndarray) -> tuple[bytes, int]:
    narrow = not len(ids) or int(ids.max()) < 1 << 16
    flags = (doc_id is not None) | narrow << 1
    return frame(_META.pack(flags, doc_id or 0, len(ids)) + ids.astype("<u2" if narrow else "<u4").tobytes()), len(ids)


def unpack_record(data: bytes) -> tuple[int | None, np.ndarray]:
    payload = unframe(data)
    flags, doc_id, n = _META.unpack_from(payload)
    ids = np.frombuffer(payload, dtype="<u2" if flags & 2 else "<u4", offset=_META.size)
    if len(ids) != n:
        raise ValueError("damaged record: its count and ids disagree")
    return (doc_id if flags & 1 else None), ids.astype("<u4")


class Encoder:
    """Ids of whole texts as the library gives them.

    The library splits texts before it merges, and no piece crosses from a
    visible character to white space, or from a letter to a plain mark. So a
    text's ids are those of its runs that begin at such places. Runs are found
    and hashed for whole batches at once; each distinct run is encoded by the
    library once and its ids kept, up to ``limit`` runs. Texts with white space
    beyond the six ASCII characters or with a special token's string go to the
    library as they are. Long texts are taken in parts that begin with white
    space after a visible ASCII character, where no piece can cross.
    """

    _WIDE = r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
    _RARE = re.compile(rf"[{_WIDE}]")
    _MARK = np.zeros(256, dtype=bool)
    _MARK[list(b",.!?;:|%$#*&")] = True
    _LETTER = np.zeros(256, dtype=bool)
    _LETTER[[*range(65, 91), *range(97, 123)]] = True

    def __init__(self, path: str, limit: int = 300_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        """Forget all runs: number n has ids[bounds[n]:bounds[n + 1]]."""
        self.numbers = HashTable(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32))
        self.ids = np.zeros(1 << 16, dtype="<u4")
        self.bounds = np.zeros(1 << 15, dtype=np.int64)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, keys: np.ndarray, runs: list[str]) -> None:
        n = self.numbers.size
        got = self._library(runs)
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        end = self.bounds[n] + np.cumsum(lengths)
        if n + len(runs) + 1 > len(self.bounds):
            self.bounds = np.resize(self.bounds, 2 * (n + len(runs) + 1))
        if len(end) and end[-1] > len(self.ids):
            self.ids = np.resize(self.ids, 2 * int(end[-1]))
        self.ids[self.bounds[n] : self.bounds[n] + lengths.sum()] = np.fromiter(chain.from_iterable(got), dtype="<u4", count=int(lengths.sum()))
        self.bounds[n + 1 : n + 1 + len(runs)] = end
        self.numbers.add(keys, np.arange(n, n + len(runs), dtype=np.int32))

    def _by_runs(self, texts: list[bytes]) -> list[np.ndarray]:
        if self.numbers.size > self.limit:
            self._clear()
        text = b"".join(texts)
        data = np.frombuffer(text, dtype=np.uint8)
        at = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        begins = WHITE[data]
        begins[1:] &= ~WHITE[data[:-1]]
        letter = self._LETTER[data]
        accented = (data[1:] >= 0x80) & (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter[1:] |= accented
        begins[1:] |= self._MARK[data[1:]] & letter[:-1]
        begins[at[:-1][at[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys = span_hashes(data, starts, ends)
        number, found = self.numbers.get(keys, -1)
        if not found.all():
            lost = np.flatnonzero(~found)
            new, first = np.unique(keys[lost], return_index=True)
            first = lost[first]
            self._keep(new, [text[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            number[lost] = self.numbers.get(keys[lost], -1)[0]
        low = self.bounds[number]
        lengths = self.bounds[number + 1] - low
        done = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=done[1:])
        ids = self.ids[np.arange(done[-1]) + np.repeat(low - done[:-1], lengths)]
        cut = done[np.searchsorted(starts, at)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _safe_parts(self, text: bytes, limit: int = PART) -> Iterator[bytes]:
        """A long text cut only before white space that follows a visible
        ASCII character."""
        start, size = 0, len(text)
        while size - start > limit:
            end = seen = start
            cut = 0
            while not cut and end < size:
                end = min(end + limit, size)
                data = np.frombuffer(text, np.uint8, end - seen, seen)
                at = np.flatnonzero(WHITE[data[1:]] & (data[:-1] > 32) & (data[:-1] < 127))
                cut = seen + int(at[-1]) + 1 if len(at) else 0
                seen = end - 1
            if not cut:
                break
            yield text[start:cut]
            start = cut
        yield text[start:]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of UTF-8 texts as unsigned 32-bit integers."""
        if any(len(t) > PART for t in texts):
            return [np.concatenate([self._encode([p])[0] for p in self._safe_parts(t)]) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = []
        for i, raw in enumerate(texts):
            text = raw.decode()
            if self._RARE.search(text) or any(s in text for s in self.special):
                whole.append(i)
        skip = set(whole)
        out = self._by_runs([b"" if i in skip else t for i, t in enumerate(texts)] if whole else texts)
        for i in whole:
            ids = self._library([p.decode() for p in self._safe_parts(texts[i], 1 << 16)])
            out[i] = np.array(list(chain.from_iterable(ids)), dtype="<u4")
        return out


def encoder(path: str) -> Encoder:
    return kept(("encoder", path), partial(Encoder, path))


_MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])


def _write_shard(tokenizer: str, folder: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    shard = task.partitionId()
    file = f"{folder}/shard-{shard:06d}-{task.taskAttemptId()}"
    end = np.uint32(end_id)
    at = docs = tokens = 0
    data = index = None
    for batch, texts in slices(batches, "text"):
        if data is None:
            data, index = open_write(f"{file}.records"), open_write(f"{file}.index")
        encoded = encoder(tokenizer).encode(texts)
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
            record, n = pack_record(doc_id, np.append(ids, end))
            data.write(record)
            index.write(_ENTRY.pack(at, len(record), n))
            at, docs, tokens = at + len(record), docs + 1, tokens + n
    if data is not None:
        data.close(), index.close()
        yield batch_of(_MANIFEST, [[shard], [file], [docs], [tokens]])


@dataclass(frozen=True)
class TokenFiles:
    """Written shards in order: (file stem, documents, tokens)."""

    folder: str
    shards: tuple[tuple[str, int, int], ...]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> TokenFiles:
    """Encode whole texts and write them in ascending id order.

    A null text is empty and yields the end id alone; null ids come first and
    are kept as such; rows that repeat an id are separate records, in the order
    of a hash of their text. Very long texts are encoded in parts. An empty
    table writes no shard. Other columns are ignored. Shards are as many as the
    session's shuffle partitions, more for more bytes; the driver gets one row
    a shard.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The second key deals rows that share an id, or have none, to several tasks.
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(pieces_of(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    manifest = map_batches(rows, partial(_write_shard, tokenizer, folder, end_id), "shard int, file string, docs long, tokens long").collect()
    return TokenFiles(folder, tuple((m.file, m.docs, m.tokens) for m in sorted(manifest, key=lambda m: m.shard)))


def read_records(file: str, order: np.ndarray | None = None) -> Iterator[tuple]:
    """(doc_id, ids) of one shard, checked. Without an order the file is
    streamed; an order is a list of record numbers, read through the index."""
    with open_read(f"{file}.index") as f:
        index = np.frombuffer(f.read(), dtype=np.dtype([("offset", "<u8"), ("length", "<u4"), ("n", "<u4")]))
    with open_read(f"{file}.records") as f:
        for i in range(len(index)) if order is None else order:
            if order is not None:
                f.seek(int(index["offset"][i]))
            doc_id, ids = unpack_record(f.read(int(index["length"][i])))
            if len(ids) != index["n"][i]:
                raise ValueError("record and index disagree")
            yield doc_id, ids


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows: list[tuple] = []
            for doc_id, ids in read_records(file):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
                if len(rows) == 10_000:
                    yield batch_of(_DIGEST, [list(c) for c in zip(*rows, strict=True)])
                    rows = []
            if rows:
                yield batch_of(_DIGEST, [list(c) for c in zip(*rows, strict=True)])


def read_digests(spark, files: TokenFiles) -> DataFrame:
    """Per record, from the files: doc_id, start, n_tokens, ids_crc32."""
    starts, at = [], 0
    for file, _, tokens in files.shards:
        starts.append((file, at))
        at += tokens
    frame_ = spark.createDataFrame(starts, "file string, start long")
    return map_batches(frame_.repartition(max(1, len(starts))), _digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
