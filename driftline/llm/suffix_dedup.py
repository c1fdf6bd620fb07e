"""Repeated 50-byte strings by a distributed merge sort of suffixes.

Texts are cut into blocks. Each task sorts suffixes of its block into runs that
know the common prefix of neighbours, cuts them at splitters into parts and
exchanges them front-coded: the length of the common prefix and the rest. A
part's runs are combined by loser trees over (common prefix with the last
winner, suffix): a longer prefix wins without a look at the bytes, and equal
ones are compared from there on only. Many trees over disjoint ranges of the
part step together as arrays. Equal suffixes leave the trees side by side, and
what they say of one another goes back to their blocks as replies.

Suffixes begin at anchors, so that one in fourteen is sorted, not all. The
anchor of a 50-byte string is its 24-byte string (core) of least hash: equal
strings have equal anchors. Three rounds, each over what the last left open:

1. cores. Strings whose core no other text has can't occur elsewhere, and need
   no sorting: a core whose fingerprint no other text has is left out.
2. for the others the whole stretch of the strings that have this anchor goes
   through the merge. If a text with a smaller id has the stretch, all its
   strings are found. Stretches of one core leave the trees side by side, and
   their single strings are compared there, by what they share left and right.
3. where a core's stretches fill more than a part, its single 50-byte strings
   go through a merge of their own. Most inputs have no such core.

Nothing is found by hashes: they choose anchors, and equal fingerprints only let
cores through to the merge, where results compare bytes.

Defined cases: null and empty texts have nothing to remove; rows without an id
neither remove nor lose anything; rows with the same id don't remove from one
another; an empty table gives no rows; other columns are ignored. A text longer
than a block is a block by itself and is worked on a quarter of a megabyte at a time.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.blocks import BLOCK, pack, read_block, read_bytes, unpack, write_blocks
from driftline.llm.common import Scratch, open_write, partitions, runs, ship

WINDOW = 50
CORE = 24
#: Bytes scanned at a time: arrays of its positions stay in the cache.
CHUNK = 1 << 18
#: Suffixes in a sorted run, and in a part, at most but for equal ones.
RUN = 1 << 20
PART = 1 << 20
#: Bytes of a key in each merge: whole words.
WIDTH = {2: 80, 3: 56}
#: Bytes of a core's fingerprint.
PRINT = 6
#: States of an anchor: a bit for each string that is to go, by the bytes it has
#: before the core; all of them; what the next round has to tell.
_SIDE = WINDOW - CORE
_ALL = np.uint32((1 << (_SIDE + 1)) - 1)
_OPEN = np.uint32(1 << 31)
_LOW = np.uint64((1 << 24) - 1)
_PAD = b"\0" * 96
_REPLY = "block long, round int, run int, part int, open long, data binary"


# -- anchors -----------------------------------------------------------------------


def _words(buf: bytes) -> np.ndarray:
    """The eight bytes from every position, as a number that orders like them."""
    n = len(buf) - 7
    out = np.empty(n, dtype=np.uint64)
    for o in range(8):
        out[o::8] = np.frombuffer(buf, ">u8", (n - o + 7) // 8, o)
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: size - width], x[width - size :]) if size < width else x


class Chunk:
    """Pieces of texts side by side, and the anchors of their 50-byte strings.

    Of anchor j, ``first[j]`` to ``last[j]`` are the strings that have it.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]]) -> None:
        self.row = np.array([p[0] for p in pieces])
        self.offset = np.array([p[1] for p in pieces])
        sizes = np.array([len(p[2]) for p in pieces])
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.buf = b"".join(p[2] for p in pieces) + _PAD
        self.strings_of = sizes - WINDOW + 1

    def scan(self) -> None:
        """Find the anchors."""
        w, n = _words(self.buf), int(self.end[-1])
        h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        for at in range(8, CORE, 8):
            h = (h ^ w[at : n + at]) * np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(31)
        whole = h
        h = _least((h & ~_LOW) | np.arange(n, dtype=np.uint64), WINDOW - CORE + 1)
        at = np.repeat(self.start, self.strings_of) + runs(self.strings_of)
        piece = np.repeat(np.arange(len(self.start)), self.strings_of)
        least = h[at] & _LOW
        new = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])))
        self.anchor, self.first = least[new].astype(np.int64), at[new]
        self.last = np.append(at[new[1:] - 1], at[-1])
        self.piece = piece[new]
        h = whole[self.anchor] * np.uint64(0x9FB21C651E98DF25)
        self.prints = (h ^ (h >> np.uint64(32))) >> np.uint64(64 - 8 * PRINT)

    def shown(self) -> tuple[np.ndarray, np.ndarray]:
        """The anchors in two bytes each: more strings, and from the last to it."""
        return (self.last - self.first).astype(np.uint8), (self.anchor - self.last).astype(np.uint8)

    def restore(self, more: np.ndarray, gap: np.ndarray) -> int:
        """The anchors from what was shown of them; how many are this chunk's."""
        total = np.append(0, np.cumsum(self.strings_of))
        end = np.cumsum(more[: int(total[-1])].astype(np.int64) + 1)
        n = int(np.searchsorted(end, total[-1])) + 1
        begin = np.append(0, end[: n - 1])
        self.piece = np.searchsorted(total, begin, side="right") - 1
        self.first = self.start[self.piece] + begin - total[self.piece]
        self.last = self.first + more[:n]
        self.anchor = self.last + gap[:n]
        return n

    def stretches(self, which: np.ndarray) -> np.ndarray:
        """The core, then what stands right and left of it in the strings."""
        a, s, e = self.anchor[which], self.first[which], self.last[which] + WINDOW
        data = np.frombuffer(self.buf, np.uint8)
        side = np.arange(_SIDE)
        key = np.zeros((len(a), WIDTH[2]), dtype=np.uint8)
        key[:, :CORE] = data[a[:, None] + np.arange(CORE)]
        key[:, CORE], key[:, CORE + 1] = e - a, a - s
        right = a[:, None] + CORE + side
        key[:, 26:52] = np.where(right < e[:, None], data[right], 0)
        left = s[:, None] + side
        key[:, 52:78] = np.where(left < a[:, None], data[left], 0)
        return key.view(">u8").astype(np.uint64)

    def places(self, which: np.ndarray) -> np.ndarray:
        n = self.last[which] - self.first[which] + 1
        return np.repeat(self.first[which], n) + runs(n)

    def strings(self, at: np.ndarray) -> np.ndarray:
        w = _words(self.buf)
        key = np.stack([w[at + i] for i in range(0, WIDTH[3], 8)], axis=1)
        key[:, 6] &= ~np.uint64((1 << 48) - 1)
        return key


def _chunks(ids: list, texts: list) -> Iterator[Chunk]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row, (id_, text) in enumerate(zip(ids, texts, strict=True)):
        if id_ is None or text is None or len(text) < WINDOW:
            continue
        for at in range(0, len(text) - WINDOW + 1, CHUNK):
            piece = text[at : at + CHUNK + WINDOW - 1]
            if size and size + len(piece) > CHUNK + WINDOW:
                yield Chunk(held)
                held, size = [], 0
            held.append((row, at, piece))
            size += len(piece)
    if held:
        yield Chunk(held)


class Block:
    """A block's texts, and its suffixes in each merge, always in the same order."""

    def __init__(self, path: str, notes: list[str]) -> None:
        rows = read_block(path)
        self.given = rows.column(0)
        self.ids = self.given.cast(pa.int64()).to_pylist()
        self.texts = rows.column(1).cast(pa.large_binary()).to_pylist()
        self.chunks = list(_chunks(self.ids, self.texts))
        if notes:
            more, gap = unpack(read_bytes(notes[0]), np.uint8, np.uint8)
            at = 0
            for c in self.chunks:
                at += c.restore(more[at:], gap[at:])
        else:
            for c in self.chunks:
                c.scan()
        self.numbers = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        self.anchors = sum(len(c.anchor) for c in self.chunks)

    def cut(self, values: np.ndarray) -> Iterator[tuple[Chunk, np.ndarray]]:
        """Values of all anchors, those of a chunk at a time."""
        at = 0
        for c in self.chunks:
            yield c, values[at : at + len(c.anchor)]
            at += len(c.anchor)

    def suffixes(self, round_: int, chosen: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, ids) in runs; ``chosen`` are the anchors that take part."""
        keys, ids, n = [], [], 0
        for c, which in self.cut(np.ones(self.anchors, dtype=bool) if chosen is None else chosen):
            which = np.flatnonzero(which)
            owner = self.numbers[c.row[c.piece[which]]]
            if round_ == 1:
                keys.append(c.prints)
            elif round_ == 2:
                keys.append(c.stretches(which))
            else:
                keys.append(c.strings(c.places(which)))
                owner = np.repeat(owner, c.last[which] - c.first[which] + 1)
            ids.append(owner)
            n += len(owner)
            if n >= RUN:
                yield np.concatenate(keys), np.concatenate(ids)
                keys, ids, n = [], [], 0
        if n:
            yield np.concatenate(keys), np.concatenate(ids)


# -- runs --------------------------------------------------------------------------


def _bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes a number above zero has."""
    # The highest bit and no bit after it: no rounding reaches the next power.
    power = (x & ~(x >> np.uint64(1))).astype(np.float64).view(np.int64) >> 52
    return (((power - 1023) >> 3) + 1).astype(np.int16)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bytes that rows of words have in common from the left."""
    words = x.shape[1]
    out = np.full(len(x), 8 * words, dtype=np.int16)
    left: np.ndarray | slice = slice(None)
    for word in range(words):
        diff = x[left, word] ^ y[left, word]
        differ = np.flatnonzero(diff)
        rows = differ if word == 0 else left[differ]
        out[rows] = 8 * word + 8 - _bytes(diff[differ])
        left = np.flatnonzero(diff == 0) if word == 0 else left[diff == 0]
        if not len(left):
            break
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of words: by the first, then equal ones by five bytes
    more at a time."""
    order = np.argsort(keys[:, 0], kind="stable")
    first = keys[order, 0]
    same = np.flatnonzero(first[1:] == first[:-1])
    group = np.cumsum(np.append(True, first[1:] != first[:-1])) if len(same) else None
    width = 8 * keys.shape[1]
    for at in range(8, width, 5):
        if not len(same):
            break
        among = np.zeros(len(order), dtype=bool)
        among[same] = among[same + 1] = True
        tied = np.flatnonzero(among)
        rows, word, bits = order[tied], at >> 3, np.uint64(8 * (at & 7))
        part = keys[rows, word] << bits
        if at & 7 > 3 and word + 1 < keys.shape[1]:
            part |= keys[rows, word + 1] >> (np.uint64(64) - bits)
        new = np.cumsum(np.append(True, np.diff(group[tied]) != 0)).astype(np.uint64)
        part = (new << np.uint64(40)) | (part >> np.uint64(24))
        by = np.argsort(part, kind="stable")
        order[tied], part = rows[by], part[by]
        equal = part[1:] == part[:-1]
        group[tied] = np.cumsum(np.append(True, ~equal))
        same = tied[:-1][equal]
    return order


def _sorted_run(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, common prefixes with the one before, the least
    and the greatest id of each, and for every row which key it has."""
    order = _order(keys)
    keys, ids = keys[order], ids[order]
    common = np.append(0, _common(keys[1:], keys[:-1])).astype(np.uint8)
    new = common < 8 * keys.shape[1]
    at = np.flatnonzero(new)
    of_row = np.empty(len(order), dtype=np.int32)
    of_row[order] = np.cumsum(new) - 1
    return keys[at], common[at], np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at), of_row


def _texts(keys: np.ndarray) -> np.ndarray:
    """Rows of words as byte strings of one width."""
    return np.ascontiguousarray(keys.astype(">u8")).view(f"S{8 * keys.shape[1]}").ravel()


def _send(block: int, number: int, round_: int, run: tuple, splitters: list[bytes]) -> Iterator[tuple]:
    """The run, front-coded, in parts."""
    keys, common, low, high, _ = run
    width = WIDTH[round_]
    bounds = [0, *np.searchsorted(_texts(keys), np.array(splitters, dtype=f"S{width}")).tolist(), len(keys)]
    common = common.copy()
    common[[b for b in bounds[:-1] if b < len(keys)]] = 0
    rest = keys.astype(">u8").view(np.uint8)[np.arange(width) >= common[:, None]]
    at = np.append(0, np.cumsum(width - common.astype(np.int64)))
    for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            yield part, block, number, pack(common[a:b], rest[at[a] : at[b]], low[a:b])


def _received(data: list[bytes], round_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of runs one after another, common prefixes, where runs begin, and
    the least id of each key."""
    width = WIDTH[round_]
    got = [unpack(d, np.uint8, np.uint8, np.int64) for d in data]
    common = np.concatenate([g[0] for g in got])
    starts = np.append(0, np.cumsum([len(g[0]) for g in got]))
    said = np.concatenate([g[2] for g in got])
    flat = np.zeros((len(common), width), dtype=np.uint8)
    flat[np.arange(width) >= common[:, None]] = np.concatenate([g[1] for g in got])
    column, row = np.ascontiguousarray(flat.T), np.arange(len(common), dtype=np.int32)
    # A byte that a row shares is that of the last row before that brings its own.
    for j in range(int(common.max())):
        shares = np.flatnonzero(common > j)
        if 8 * len(shares) > len(row):
            column[j] = column[j, np.maximum.accumulate(np.where(common <= j, row, 0))]
        else:
            own = np.flatnonzero(common <= j)
            column[j, shares] = column[j, own[np.searchsorted(own, shares) - 1]]
    return np.ascontiguousarray(column.T).view(">u8").astype(np.uint64), common, starts, said


# -- fingerprints ------------------------------------------------------------------


def _send_prints(block: int, number: int, prints: np.ndarray, ids: np.ndarray, parts: int) -> tuple[list[tuple], np.ndarray]:
    """The distinct fingerprints of a run in equal ranges, as differences and
    whether texts with several ids have each; and which of them every row has."""
    order = np.argsort(prints)
    prints, ids = prints[order], ids[order]
    new = np.append(True, prints[1:] != prints[:-1])
    at = np.flatnonzero(new)
    of_row = np.empty(len(order), dtype=np.int32)
    of_row[order] = np.cumsum(new) - 1
    prints, several = prints[at], np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
    inner = [(i << 8 * PRINT) // parts for i in range(1, parts)]
    bounds = [0, *np.searchsorted(prints, np.array(inner, dtype=np.uint64)).tolist(), len(prints)]
    out = []
    for part, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            steps = np.diff(prints[a:b], prepend=np.uint64(0))
            out.append((part, block, number, pack(steps.view(np.uint8).reshape(-1, 8)[:, :PRINT].T, np.packbits(several[a:b]))))
    return out, of_row


def _shared_prints(data: list[bytes]) -> list[bytes]:
    """For each run, which of its fingerprints texts with several ids have."""
    prints, several = [], []
    for d in data:
        steps, said = unpack(d, np.uint8, np.uint8)
        n = len(steps) // PRINT
        raw = np.zeros((n, 8), dtype=np.uint8)
        raw[:, :PRINT] = steps.reshape(PRINT, n).T
        prints.append(np.cumsum(raw.view(np.uint64).ravel(), dtype=np.uint64))
        several.append(np.unpackbits(said, count=n).astype(bool))
    starts = np.append(0, np.cumsum([len(x) for x in prints]))
    prints, several = np.concatenate(prints), np.concatenate(several)
    order = np.argsort(prints)
    prints = prints[order]
    equal = prints[1:] == prints[:-1]
    # Of equal ones in different runs the ids may be the same: the merge will tell.
    found = several[order] | np.append(equal, False) | np.append(False, equal)
    back = np.empty_like(found)
    back[order] = found
    return [pack(np.packbits(back[a:b]), np.array([b - a])) for a, b in zip(starts[:-1], starts[1:], strict=True)]


# -- loser trees -------------------------------------------------------------------


def merge(keys: np.ndarray, common: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all rows, and the common prefix of each with the row before.

    Rows ``starts[r]:starts[r + 1]`` are a sorted run without equal rows, and
    ``common`` their common prefixes. The rows are cut into ranges of keys; one
    loser tree for each range, and all trees take their next step together.
    """
    n, n_runs = len(keys), len(starts) - 1
    if n_runs == 1:
        return np.arange(n), common.astype(np.int16)
    leaves = 1 << (n_runs - 1).bit_length()
    n_trees = max(1, min(n // 256, 4096, (1 << 22) // leaves))
    names = _texts(keys)
    cuts = np.sort(names[:: max(1, n // (16 * n_trees))])
    cuts = np.unique(cuts[np.linspace(0, len(cuts), n_trees, endpoint=False).astype(int)[1:]])
    edge = np.stack([starts[r] + np.concatenate([[0], np.searchsorted(names[starts[r] : starts[r + 1]], cuts), [starts[r + 1] - starts[r]]]) for r in range(n_runs)], axis=1)
    total = (edge[1:] - edge[:-1]).sum(axis=1)
    written = np.append(0, np.cumsum(total))[:-1]
    large = np.argsort(-total, kind="stable")
    large = large[total[large] > 0]
    total, written, n_trees = total[large], written[large], len(large)
    # Heads of the runs; a run that has ended has -1 in common with anything.
    head = np.zeros((n_trees, leaves), dtype=np.int32)
    stop = np.zeros((n_trees, leaves), dtype=np.int32)
    head[:, :n_runs], stop[:, :n_runs] = edge[:-1][large], edge[1:][large]
    head, stop = head.ravel(), stop.ravel()
    base = np.arange(n_trees, dtype=np.int32) * np.int32(leaves)
    flat, words = keys.ravel(), keys.shape[1]
    common = common.astype(np.int16)

    def compare(a: np.ndarray, b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether b is less than a, and what they have in common, of which
        ``known`` bytes are known: nothing before is looked at."""
        word = np.minimum(known.astype(np.int32) >> 3, words - 1)
        x, y = flat.take(a * words + word), flat.take(b * words + word)
        again = np.flatnonzero(x == y)
        if len(again):  # all words at once
            rows, others = keys[a[again]], keys[b[again]]
            next_ = (rows != others).argmax(axis=1).astype(np.int32)
            at = np.arange(len(again))
            x[again], y[again], word[again] = rows[at, next_], others[at, next_], next_
        diff = x ^ y
        return y < x, np.where(diff == 0, 8 * words, 8 * word + 8 - _bytes(np.maximum(diff, np.uint64(1)))).astype(np.int16)

    def play(tree: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, ...]:
        """Winner and loser of runs a and b, each with its common prefix: the
        winner's with the last row put out, the loser's with the winner."""
        swap, keep = lb > la, np.minimum(la, lb)
        same = np.flatnonzero((la == lb) & (la >= 0))
        if len(same):
            t = tree[same]
            less, both = compare(head[t + a[same]], head[t + b[same]], la[same])
            swap[same], keep[same] = less, both
        return np.where(swap, b, a), np.maximum(la, lb), np.where(swap, a, b), keep

    loser = np.zeros((n_trees, leaves), dtype=np.int32)
    shares = np.zeros((n_trees, leaves), dtype=np.int16)
    runner = np.broadcast_to(np.arange(leaves, dtype=np.int32), (n_trees, leaves))
    prefix = np.where((head < stop).reshape(n_trees, leaves), np.int16(0), np.int16(-1))
    size = leaves
    while size > 1:
        size //= 2
        tree = np.repeat(base, size)
        won, prefix, lost, kept = play(tree, runner[:, ::2].ravel(), prefix[:, ::2].ravel(), runner[:, 1::2].ravel(), prefix[:, 1::2].ravel())
        runner, prefix = won.reshape(n_trees, size), prefix.reshape(n_trees, size)
        loser[:, size : 2 * size], shares[:, size : 2 * size] = lost.reshape(n_trees, size), kept.reshape(n_trees, size)
    runner, prefix, loser, shares = runner.ravel(), prefix.ravel(), loser.ravel(), shares.ravel()

    order, out = np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int16)
    live = n_trees
    for step in range(int(total[0])):
        while total[live - 1] <= step:
            live -= 1
        runner, prefix, tree = runner[:live], prefix[:live], base[:live]
        at = tree + runner
        row = head[at]
        order[written[:live] + step], out[written[:live] + step] = row, prefix
        head[at] = row + 1
        prefix = np.where(row + 1 < stop[at], common.take(row + 1, mode="clip"), np.int16(-1))
        node = (runner + leaves) >> 1
        for _ in range(leaves.bit_length() - 1):
            where = tree + node
            runner, prefix, loser[where], shares[where] = play(tree, runner, prefix, loser[where], shares[where])
            node = node >> 1
    # The first row of a range against the last of the range before.
    first = np.sort(written)[1:]
    out[first] = _common(keys[order[first]], keys[order[first - 1]])
    return order, out


# -- merges and replies --------------------------------------------------------------


def _sides(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by group and the bytes beside the core, the bytes each
    row has in common with the one before, and the most with any of its group."""
    words = np.zeros((len(group), 32), dtype=np.uint8)
    words[:, :_SIDE] = side
    keys = np.column_stack([group.astype(np.uint64), words.view(">u8").astype(np.uint64)])
    order = _order(keys)
    common = np.minimum(np.append(0, _common(keys[order[1:]], keys[order[:-1]])) - 8, _SIDE)
    most = np.empty(len(order), dtype=np.int64)
    most[order] = np.maximum(common, np.append(common[1:], -8))
    return order, common, most


def _found(keys: np.ndarray, group: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which single strings of different stretches texts with smaller ids have
    than the stretch: a bit for each, by its bytes before the core.

    ``group`` numbers the cores. A string is the same in two stretches of a core
    if they share its bytes right of the core and left of it.
    """
    out = np.zeros(len(keys), dtype=np.uint32)
    raw = keys.astype(">u8").view(np.uint8).reshape(len(keys), WIDTH[2])
    right, left = raw[:, CORE].astype(np.int64) - CORE, raw[:, CORE + 1].astype(np.int64)
    # Only rows that share enough bytes with any other go on, first by the right side.
    rows = np.flatnonzero(np.minimum(right, _sides(group, raw[:, 26:52])[2]) + left >= _SIDE)
    if not len(rows):
        return out
    group, raw, right, left, least = group[rows], raw[rows], right[rows], left[rows], least[rows]
    away = left[:, None] - 1 - np.arange(_SIDE)  # left bytes from the core on
    back = np.where(away >= 0, np.take_along_axis(raw, 52 + np.maximum(away, 0), axis=1), 0)
    order_r, common_r, most_r = _sides(group, raw[:, 26:52])
    order_l, common_l, most_l = _sides(group, back)
    right, left = np.minimum(right, most_r), np.minimum(left, most_l)

    def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(common < depth)
        return number

    found = np.zeros(len(rows), dtype=np.uint32)
    for before in range(_SIDE + 1):
        has = np.flatnonzero((left >= before) & (right >= _SIDE - before))
        if not len(has):
            continue
        pair = (classes(order_l, common_l, before)[has] << 32) | classes(order_r, common_r, _SIDE - before)[has]
        order = np.argsort(pair)
        pair, has = pair[order], has[order]
        new = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        first = np.repeat(np.minimum.reduceat(least[has], new), np.diff(np.append(new, len(pair))))
        found[has] |= (first < least[has]).astype(np.uint32) << np.uint32(before)
    out[rows] = found
    return out


def _merge_part(round_: int, splitters: list[bytes], rows: pa.Table) -> pa.Table:
    """Replies to every run of a part. What tasks keep for themselves passes."""
    part = rows["part"][0].as_py()
    blocks, numbers, data = (rows[c].to_pylist() for c in ("block", "run", "data"))
    if part < 0:
        return _reply(blocks, [0] * len(blocks), numbers, [part] * len(blocks), [0] * len(blocks), data)
    by_run = sorted(range(len(blocks)), key=lambda i: (blocks[i], numbers[i]))
    blocks, numbers, data = ([x[i] for i in by_run] for x in (blocks, numbers, data))
    open_ = [0] * len(blocks)
    if round_ == 1:
        pieces = _shared_prints(data)
    else:
        keys, common, starts, said = _received(data, round_)
        order, shared = merge(keys, common, starts)
        new = np.flatnonzero(np.append(True, shared[1:] < WIDTH[round_]))
        size = np.diff(np.append(new, len(order)))
        least = np.minimum.reduceat(said[order], new)
        back = np.empty_like(said)
        back[order] = np.repeat(least, size)
        pieces = []
        if round_ == 2:
            core = np.cumsum(np.append(True, shared[1:] < CORE))[new] - 1
            several = np.bincount(core) > 1
            # Of a core that is cut by the part's ends the strings stay open.
            cut = np.zeros(len(several), dtype=bool)
            for end, at in ((part - 1, 0), (part, -1)):
                if 0 <= end < len(splitters) and len(splitters[end]) > CORE:
                    cut[at] |= _texts(keys[order[at : at + 1 or None]])[0][:CORE].ljust(CORE, b"\0") == splitters[end][:CORE]
            state = np.where(cut[core], _OPEN, np.uint32(0))
            among = np.flatnonzero((several & ~cut)[core])
            if len(among):
                state[among] = _found(keys[order[new[among]]], core[among], least[among])
            of = np.empty(len(order), dtype=np.uint32)
            of[order] = np.repeat(state, size)
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            if round_ == 2:
                pieces.append(pack(back[a:b], of[a:b]))
                open_[i] = int((of[a:b] == _OPEN).sum())
            else:
                pieces.append(pack(back[a:b]))
    return _reply(blocks, [round_] * len(blocks), numbers, [part] * len(blocks), open_, pieces)


def _reply(block: list, round_: list, run: list, part: list, open_: list, data: list) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip((block, round_, run, part, open_, data), kinds, strict=True)], names=["block", "round", "run", "part", "open", "data"])


class Notes:
    """What a block's tasks keep for later merges, in files beside the block: the
    anchors, then for each merge the state of the anchors before it and which
    key of its run every suffix has. A task that runs again writes new files."""

    def __init__(self, block: int, path: str, files: list[str]) -> None:
        self.block, self.path, self.files = block, path, files

    def keep(self, round_: int, *arrays: np.ndarray) -> bytes:
        file = f"{self.path}-{round_}-{TaskContext.get().taskAttemptId()}"
        with open_write(file) as f:
            f.write(pack(*arrays))
        return "\n".join([*self.files, file]).encode()

    def last(self) -> tuple[np.ndarray, list[np.ndarray]]:
        anchors = [np.uint8, np.uint8] if len(self.files) == 1 else []
        state, of_row, sizes = unpack(read_bytes(self.files[-1]), *anchors, np.uint32, np.int32, np.int64)[-3:]
        return state, np.split(of_row, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _state(rows: pa.Table) -> tuple[Notes, dict[int, list[bytes]]]:
    """Of one block: what was kept, and replies by run in the order of parts."""
    path = next(p for p in rows["path"].to_pylist() if p is not None)
    files: list[str] = []
    found = []
    for run, part, data in zip(rows["run"].to_pylist(), rows["part"].to_pylist(), rows["data"].to_pylist(), strict=True):
        if data is None:
            continue
        if part < 0:
            files = data.decode().split("\n")
        else:
            found.append((run, part, data))
    replies: dict[int, list[bytes]] = {}
    for run, _, data in sorted(found, key=lambda r: r[:2]):
        replies.setdefault(run, []).append(data)
    return Notes(rows["block"][0].as_py(), path, files), replies


def _after(block: Block, round_: int, notes: Notes, replies: dict[int, list[bytes]]) -> tuple[np.ndarray, np.ndarray | None]:
    """State of each anchor after a round and, after the third, the least id of
    each open string."""
    if round_ == 0:
        return np.full(block.anchors, _OPEN), None
    state, of_rows = notes.last()
    none = np.empty(0, dtype=np.int64)
    if round_ == 1:
        shared = [none.astype(np.uint8)]
        for run, of_row in enumerate(of_rows):
            said = [unpack(d, np.uint8, np.int64) for d in replies[run]]
            shared.append(np.concatenate([np.unpackbits(b, count=int(n[0])) for b, n in said])[of_row])
        return np.where(np.concatenate(shared), _OPEN, np.uint32(0)), None
    least, found = [none], [none.astype(np.uint32)]
    for run, of_row in enumerate(of_rows):
        said = [unpack(d, np.int64, np.uint32) if round_ == 2 else (*unpack(d, np.int64), none.astype(np.uint32)) for d in replies[run]]
        least.append(np.concatenate([v for v, _ in said])[of_row])
        if round_ == 2:
            found.append(np.concatenate([f for _, f in said])[of_row])
    least, found = np.concatenate(least), np.concatenate(found)
    if round_ == 3:
        return state, least
    open_ = np.flatnonzero(state == _OPEN)
    owner = np.concatenate([none, *[block.numbers[c.row[c.piece]] for c in block.chunks]])
    state = np.zeros(block.anchors, dtype=np.uint32)
    state[open_] = np.where(owner[open_] > least, _ALL, found)
    return state, None


def _sort_block(round_: int, parts: int, splitters: list[bytes], rows: pa.Table) -> pa.Table:
    """The runs of one block for a merge, and where its task kept what."""
    notes, replies = _state(rows)
    block = Block(notes.path, notes.files)
    state, _ = _after(block, round_ - 1, notes, replies)
    out, of_rows = [], []
    for run, (keys, ids) in enumerate(block.suffixes(round_, None if round_ == 1 else state == _OPEN)):
        if round_ == 1:
            sent, of_row = _send_prints(notes.block, run, keys, ids, parts)
        else:
            sorted_ = _sorted_run(keys, ids)
            sent, of_row = _send(notes.block, run, round_, sorted_, splitters), sorted_[-1]
        out.extend(sent)
        of_rows.append(of_row)
    shown = [c.shown() for c in block.chunks] if round_ == 1 else []
    anchors = [np.concatenate([np.empty(0, np.uint8), *x]) for x in zip(*shown, strict=True)] if shown else [np.empty(0, np.uint8)] * 2 if round_ == 1 else []
    kept = notes.keep(round_, *anchors, state, np.concatenate([np.empty(0, np.int32), *of_rows]), np.array([len(o) for o in of_rows], dtype=np.int64))
    out.append((-1 - ((notes.block >> 32) + notes.block) % (1 << 30), notes.block, -1, kept))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["part", "block", "run", "data"])


def _finish(id_kind: pa.DataType, last: int, rows: pa.Table) -> pa.Table:
    """What is left of the texts of one block after the last round."""
    notes, replies = _state(rows)
    block = Block(notes.path, notes.files)
    states, least = _after(block, last, notes, replies)
    covered: dict[int, np.ndarray] = {}
    at = 0
    for c, state in block.cut(states):
        sure, open_ = np.flatnonzero(state == _ALL), np.flatnonzero(state == _OPEN)
        some = np.flatnonzero((state > 0) & (state < _ALL))
        which, before = np.nonzero(state[some, None] >> np.arange(_SIDE + 1, dtype=np.uint32) & np.uint32(1))
        single = c.anchor[some[which]] - before
        begin, end = [c.first[sure], single], [c.last[sure] + WINDOW, single + WINDOW]
        if len(open_):
            places = c.places(open_)
            owner = np.repeat(block.numbers[c.row[c.piece[open_]]], c.last[open_] - c.first[open_] + 1)
            places = places[owner > least[at : at + len(owner)]]
            at += len(owner)
            begin.append(places)
            end.append(places + WINDOW)
        begin, end = np.concatenate(begin), np.concatenate(end)
        if not len(begin):
            continue
        n = int(c.end[-1])
        over = np.cumsum(np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n] > 0
        for row, offset, a, b in zip(c.row.tolist(), c.offset.tolist(), c.start.tolist(), c.end.tolist(), strict=True):
            if over[a:b].any():
                mask = covered.setdefault(row, np.zeros(len(block.texts[row]), dtype=bool))
                mask[offset : offset + b - a] |= over[a:b]
    sizes, removed, spans, digests = [], [], [], []
    for row, text in enumerate(block.texts):
        text = text or b""
        mask = covered.get(row)
        sizes.append(len(text))
        removed.append(0 if mask is None else int(mask.sum()))
        spans.append(0 if mask is None else int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()))
        left = text if mask is None else np.frombuffer(text, np.uint8)[~mask].tobytes()
        digests.append(hashlib.sha256(left).hexdigest())
    return pa.table([block.given.cast(id_kind), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys at the first anchors of each chunk, to choose splitters by."""
    for batch in batches:
        stretches, strings = [], []
        for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
            rows = read_block(path)
            rows = rows.take(np.arange(0, rows.num_rows, max(1, rows.num_rows // 64)))
            texts = [t and t[: 1 << 15] for t in rows.column(1).cast(pa.large_binary()).to_pylist()]
            for c in _chunks(rows.column(0).to_pylist(), texts):
                c.scan()
                some = np.arange(0, len(c.anchor), max(1, len(c.anchor) // 512))
                stretches += _texts(c.stretches(some)).tolist()
                strings += _texts(c.strings(c.first[some])).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(stretches, pa.binary()), pa.array(strings, pa.binary())], names=["stretch", "string"])


def _splitters(sample: DataFrame, column: str, width: int, parts: int) -> list[bytes]:
    """At most 32 sampled keys a part come to the driver, and no more than a million."""
    key = F.substring(F.col(column), 1, width)
    got = sample.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(min(32 * parts, 1 << 20)).toArrow()["k"].to_pylist()
    got = sorted(got)
    return sorted({got[len(got) * i // parts].rstrip(b"\0") for i in range(1, parts)}) if got else []


def _at_cores(splitters: list[bytes]) -> list[bytes]:
    """Splitters where cores begin, except within those that fill more than a part."""
    core = [s[:CORE].ljust(CORE, b"\0") for s in splitters]
    times = Counter(core)
    return sorted({c.rstrip(b"\0") if times[c] == 1 else s for c, s in zip(core, splitters, strict=True)})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK, part_rows: int = PART) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 of the bytes that stay.

    A byte goes if a 50-byte string over it also begins in a row with a smaller
    id. Matches don't cross rows; all is judged on the texts as they came in.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch()
    blocks = write_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", "suffix-blocks", block_bytes)
    sample = scratch.write(blocks.repartition(partitions(spark), "block").select("path").mapInArrow(_sample, "stretch binary, string binary"), "suffix-sample")
    n_blocks, size = blocks.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    tasks = max(partitions(spark), n_blocks)
    # Fingerprints are few bytes each: twice the keys make a part.
    expected = {1: size // 28, 2: size // 40, 3: 0}
    replies, last = None, 0
    for round_ in (1, 2, 3):
        if round_ == 3:
            expected[3] = (_SIDE + 1) * (replies.agg(F.sum("open")).first()[0] or 0)
            if not expected[3]:
                break
        parts = max(1, -(-expected[round_] // part_rows), min(partitions(spark), 4 * n_blocks))
        splitters = [] if round_ == 1 else _splitters(sample, "string" if round_ == 3 else "stretch", WIDTH[round_], parts)
        if round_ == 2:
            splitters = _at_cores(splitters)
        runs_ = _of_block(blocks, replies, tasks).applyInArrow(_by_group(_sort_block, round_, parts, splitters), "part int, block long, run int, data binary")
        replies = scratch.write(runs_.groupBy("part").applyInArrow(_by_group(_merge_part, round_, splitters), _REPLY), f"suffix-replies-{round_}")
        last = round_
    out = _of_block(blocks, replies, tasks).applyInArrow(_by_group(_finish, _arrow(docs, id_col), last), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    out = scratch.write(out, "suffix-result")
    scratch.close(out)
    return out.withColumnRenamed("id", id_col)


def _by_group(f: Callable[..., pa.Table], *args: object) -> Callable[[pa.Table], pa.Table]:
    """f with its first arguments, in a form whose types Spark can read."""

    def run(rows: pa.Table) -> pa.Table:
        return f(*args, rows)

    return run


def _arrow(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def _of_block(blocks: DataFrame, replies: DataFrame | None, tasks: int):
    """Each block with the replies to it; few rows, but each is much work."""
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    own = blocks.select("block", "path", none("int", "round"), none("int", "run"), none("int", "part"), none("binary", "data"))
    if replies is not None:
        own = own.unionByName(replies.select("block", none("string", "path"), "round", "run", "part", "data"))
    return own.repartition(tasks, "block").groupBy("block")
