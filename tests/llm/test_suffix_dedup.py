"""Repeated strings against a plain version, and the loser trees alone."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from driftline.llm import suffix_dedup
from driftline.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string"


def _plain(rows: list[tuple]) -> list[tuple]:
    least: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for at in range(len(t) - 49 if i is not None else 0):
            least[t[at : at + 50]] = min(i, least.get(t[at : at + 50], i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for at in range(len(t) - 49 if i is not None else 0):
            if least[t[at : at + 50]] < i:
                gone[at : at + 50] = b"\1" * 50
        spans = sum(1 for j in range(len(t)) if gone[j] and not (j and gone[j - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _corpus(seed: int, n: int = 160) -> list[tuple]:
    pick = random.Random(seed)
    syllables = ["ta", "ri", "on ", "the ", "é", "ver", "so", ". ", "漢", "\n", "\0"]
    prose = lambda k: "".join(pick.choice(syllables) for _ in range(k))
    passages = [prose(pick.randint(12, 90)) for _ in range(8)]
    texts: list = []
    for _ in range(n):
        kind = pick.random()
        if kind < 0.15 and texts:
            texts.append(pick.choice(texts))
        elif kind < 0.35 and texts:  # a near copy
            t = list(pick.choice(texts) or "")
            for _ in range(pick.randint(1, 3)):
                if t:
                    t[pick.randrange(len(t))] = pick.choice("xyzé")
            texts.append("".join(t))
        elif kind < 0.7:
            texts.append(prose(pick.randint(0, 60)) + pick.choice(passages) + prose(pick.randint(0, 60)) + pick.choice(passages))
        else:
            texts.append(pick.choice([None, "", "x" * 49, "x" * 50, "x" * 51, "ab" * 300, "x" * 400, prose(200)]))
    ids = list(range(n))
    pick.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("seed", "block_bytes", "part_rows"), [(1, 1 << 24, 1 << 20), (2, 3000, 1 << 20), (3, 3000, 2000)])
def test_equals_the_plain_version(spark, seed, block_bytes, part_rows):
    rows = _corpus(seed)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), block_bytes=block_bytes, part_rows=part_rows)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(rows)


def test_odd_rows(spark):
    """Missing and repeated ids, repeated rows, clashing columns, no rows."""
    long = "every word of this sentence is found in more than one of the texts here"
    rows = [(None, long), (None, long), (3, long), (3, long), (7, long), (3, "x" + long), (9, None), (10, "")]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA + ", id string, block int")
    assert sorted(map(tuple, remove_repeats(df).collect()), key=repr) == _plain(rows)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_beyond_a_block(spark):
    pick = random.Random(5)
    long = "".join(pick.choice("abcdefgh ") for _ in range(2_500_000))
    changed = long[:1_048_560] + "#" + long[1_048_561:]
    rows = [(1, long), (2, changed), (3, long[1_048_000:1_049_000])]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), block_bytes=1 << 20).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, len(long) - 1, 2)
    assert (got[2].kept_sha256, got[3].n_removed, got[3].n_spans) == (hashlib.sha256(b"#").hexdigest(), 1000, 1)


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 40])
def test_loser_trees(runs):
    rng = np.random.RandomState(runs)
    keys, common, starts = [], [], [0]
    for r in range(runs):
        raw = rng.choice(list(b"ab\0" if r % 2 else b"abcdefgh"), size=(rng.randint(1, 2000), 24)).astype(np.uint8)
        raw[:, :8] = 97
        own, shared, _, _, of_row = suffix_dedup._sorted_run(raw.view(">u8").astype(np.uint64), np.arange(len(raw)))
        assert (own[of_row] == raw.view(">u8")).all()
        keys.append(own), common.append(shared), starts.append(starts[-1] + len(own))
    order, shared = suffix_dedup.merge(np.concatenate(keys), np.concatenate(common), np.array(starts))
    names = [x.tobytes() for x in np.concatenate(keys)[order].astype(">u8")]
    assert names == sorted(names) and sorted(order) == list(range(starts[-1]))
    for a, b, h in zip(names[:-1], names[1:], shared[1:].tolist(), strict=True):
        assert h == next((j for j in range(24) if a[j] != b[j]), 24)


@pytest.fixture
def written(monkeypatch):
    """Labels of the scratch tables that a call writes."""
    labels: list[str] = []
    write = suffix_dedup.Scratch.write
    monkeypatch.setattr(suffix_dedup.Scratch, "write", lambda self, df, label: labels.append(label) or write(self, df, label))
    return labels


def test_single_strings_need_no_merge_of_their_own(spark, written):
    """Ends of matches are told where the stretches of their core meet."""
    rows = _corpus(11, 300)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), block_bytes=6000)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(rows)
    assert "suffix-replies-2" in written and "suffix-replies-3" not in written


def test_a_core_with_more_stretches_than_a_part(spark, written):
    """Such a core is cut, and its strings go through the third merge."""
    pick = random.Random(12)
    passage = "a passage of sixty bytes that stands between sides of two letters"
    side = lambda: "".join(pick.choice("ab") for _ in range(pick.randint(0, 12)))
    rows = [(i, side() + passage + side()) for i in pick.sample(range(3000), 600)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(4), block_bytes=8000, part_rows=40)
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(rows)
    assert "suffix-replies-3" in written


def test_cores_are_exchanged_as_fingerprints():
    """A core takes no more than seven bytes; equal ones of several texts are found."""
    rng = np.random.RandomState(3)
    prints = rng.randint(0, 1 << 48, size=(2, 20_000)).astype(np.uint64)
    prints[1, :500] = prints[0, :500]
    prints[0, 1000:1100] = prints[0, 2000:2100]
    sent = [suffix_dedup._send_prints(r, 0, prints[r], np.arange(20_000) + 20_000 * r, 3) for r in range(2)]
    assert sum(len(x[3]) for out, _ in sent for x in out) < 7 * prints.size
    found = [[], []]
    for part in range(3):
        pieces = [x for out, _ in sent for x in out if x[0] == part]
        for x, said in zip(pieces, suffix_dedup._shared_prints([x[3] for x in pieces]), strict=True):
            bits, n = suffix_dedup.unpack(said, np.uint8, np.int64)
            found[x[1]].append(np.unpackbits(bits, count=int(n[0])))
    shared = [np.concatenate(f)[of_row] for f, (_, of_row) in zip(found, sent, strict=True)]
    assert np.flatnonzero(shared[0]).tolist() == [*range(500), *range(1000, 1100), *range(2000, 2100)]
    assert np.flatnonzero(shared[1]).tolist() == [*range(500)]


def test_single_strings_of_stretches():
    pick = random.Random(4)
    keys, groups, spans = [], [], []
    for _ in range(400):
        left, right = pick.randint(0, 26), pick.randint(0, 26)
        if left + right < 26:
            left = 26 - right
        core = bytes([97 + pick.randrange(3)]) * 24
        text = [bytes(pick.choice(b"aaaaaaaaaaab\0") for _ in range(n)) for n in (left, right)]
        keys.append(core + bytes([24 + right, left]) + text[1].ljust(26, b"\0") + text[0].ljust(26, b"\0") + b"\0\0")
        groups.append(core[0]), spans.append((text[0] + core + text[1], left))
    least = np.array([pick.randrange(300) for _ in keys])
    words = np.frombuffer(b"".join(keys), ">u8").reshape(len(keys), 10).astype(np.uint64)
    found = suffix_dedup._found(words, np.array(groups), least)
    owner: dict[tuple, int] = {}
    strings = [[(g, b, t[n - b : n - b + 50]) for b in range(27) if b <= n and n - b + 50 <= len(t)] for (t, n), g in zip(spans, groups, strict=True)]
    for of, i in zip(strings, least.tolist(), strict=True):
        for x in of:
            owner[x] = min(i, owner.get(x, i))
    want = [sum(1 << x[1] for x in of if owner[x] < i) for of, i in zip(strings, least.tolist(), strict=True)]
    assert found.tolist() == want and any(want)
