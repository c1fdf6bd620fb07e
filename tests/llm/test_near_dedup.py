from __future__ import annotations

import random

import numpy as np
import pytest

from driftline.llm import near_dedup as m
from driftline.llm.components import connected_components

from . import plain


def _texts(seed: int) -> dict[int, str | None]:
    """Exact copies, a hot group of edited copies, chains, shared passages."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    text = lambda n: [word() for _ in range(n)]
    out: list = [None, "", " \t\n", "one", "ONE", "one two", "x " * 4000]
    base, passage = text(120), text(60)
    for _ in range(60):
        copy = list(base)
        for _ in range(r.randint(0, 12)):
            copy[r.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    out += [" ".join(base)] * 25
    chain = text(80)
    for i in range(0, 40, 4):
        chain = [*chain[:i], *text(3), *chain[i + 3 :]]
        out.append(" ".join(chain))
    out += [" ".join(text(40) + passage + text(30)) for _ in range(20)]
    out += [" ".join(text(r.randint(1, 90))) for _ in range(40)]
    r.shuffle(out)
    return {3 * i + 1: t for i, t in enumerate(out)}


@pytest.mark.parametrize(("seed", "k", "percent", "tile", "many"), [(1, 3, 85, m.TILE, m.MANY_TILES), (2, 5, 80, m.TILE, m.MANY_TILES), (3, 3, 85, 500, 0)])
def test_against_all_pairs(spark, monkeypatch, seed, k, percent, tile, many):
    """With leaders and tiles as they come, and with small tiles and as many
    leader rounds as find links."""
    monkeypatch.setattr(m, "TILE", tile)
    monkeypatch.setattr(m, "MANY_TILES", many)
    texts = _texts(seed)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in m.near_duplicates(df, k=k, percent=percent).collect()}
    want = plain.near_duplicates(texts, k, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(plain.shingles(texts[i], k)) and r.kept == (i == r.component_id) for i, r in got.items())


def test_odd_cases(spark):
    """Null and repeated ids, null and blank texts: every row is a document."""
    rows = [(1, "a b c d", 1.0), (1, "a b c d", 2.0), (None, "a b c d", 3.0), (2, None, None), (2, "a b c d", None), (3, "", 0.0), (None, "x y z", 0.0), (None, "x y z", 1.0)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, component double, node int, id int")
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in m.near_duplicates(df).collect())
    assert got == sorted(str(x) for x in [(1, 1, True)] * 2 + [(None, 1, False), (2, 2, True), (2, 1, False), (3, 3, True)] + [(None, None, True)] * 2)
    kept = m.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(x) for x in [(1, "a b c d"), (2, None), (3, ""), (None, "x y z")])
    assert m.near_duplicates(df.limit(0)).count() == 0 and m.drop_near_duplicates(df.limit(0)).count() == 0


def test_long_texts_in_parts():
    """The same hashes whether a text is taken whole or in parts."""
    from driftline.llm import common

    r = random.Random(1)
    text = " ".join("".join(r.choice("abcé ") for _ in range(r.randint(1, 12))) for _ in range(60_000)).encode() + b" " + b"z" * 300_000 + b" end"
    want, at = common.word_hashes([text])
    pieces = list(common.parts(text, limit=10_000))
    assert b"".join(pieces) == text and len(pieces) > 20
    assert np.array_equal(np.concatenate([common.word_hashes([p])[0] for p in pieces]), want) and at.tolist() == [0, len(want)]
    lower = [w.lower() for w in text.split()]
    assert len(lower) == len(want) and len(set(lower)) == len(set(want.tolist()))


def test_sketch_estimates():
    r = np.random.RandomState(5)
    for share in (0.7, 0.85, 0.95):
        same = int(2000 * share)
        common = r.randint(0, 1 << 62, same).astype(np.uint64)
        rest = r.randint(0, 1 << 62, (2, (2000 - same) // 2)).astype(np.uint64)
        a, b = (m.odd_sketch(m.minhashes(np.concatenate([common, x]))) for x in rest)
        bits = int(np.bitwise_count(a ^ b).sum())
        true = same / (same + rest.size)
        assert abs(m.estimated_similarity(bits) - true) < 0.15
        assert true < 0.85 or bits <= m.widest_xor(0.85)


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components(spark, local):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (None, 3)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), local_edges=local).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    union = plain.Union({x for e in real for x in e})
    for a, b in real:
        union.join(a, b)
    assert got == {i: union.root(i) for i in union.up}
    assert connected_components(spark.createDataFrame([], "a long, b long"), local_edges=local).count() == 0
