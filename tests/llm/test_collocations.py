"""Collocations against a plain version over dictionaries."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from driftline.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string"


def _plain(rows: list[tuple], least: int, top: int = 2000, scale: int = 2_000_000) -> list[tuple]:
    f: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang, *_ in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]", piece) if x]
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        gone = {q for p, v in cand.items() for s in range(2, len(p)) for o in range(len(p) - s + 1) if 100 * v >= 80 * c[q := p[o : o + s]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((scale * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, r, n, -s))
    return sorted(out)


def _corpus(seed: int) -> list[tuple]:
    pick = random.Random(seed)
    vocabulary = ["New", "york", "of", "the", "the", "a", "é", "city", "ÀB", "x y", "\x01"]
    phrases = ["New York City", "of the the the", "a a a a a", "é é"]
    rows = []
    for i in range(150):
        words = [pick.choice(vocabulary) if pick.random() < 0.6 else pick.choice(phrases) for _ in range(pick.randint(0, 40))]
        text = "".join(w + pick.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!?"]) for w in words)
        rows.append((i, pick.choice([text, text, text, None, ""]), pick.choice(["en", "en", "en", "fr", None, "und", ""])))
    return rows + rows[:40]


@pytest.mark.parametrize(("seed", "block_bytes", "top"), [(1, 1 << 23, 2000), (2, 400, 2000), (3, 400, 7)])
def test_equals_the_plain_version(spark, seed, block_bytes, top):
    rows = _corpus(seed)
    got = collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=4, block_bytes=block_bytes, top=top)
    want = _plain(rows, 4, top)
    assert len(want) > 20 and sorted(map(tuple, got.collect())) == want


def test_one_piece_most_of_the_time_and_long_texts(spark):
    rows = [(1, "Hot phrase here. " * 80_000, "en"), (2, "hot\tPHRASE  here", "en"), (3, "w" * 200_000 + " x", None)]
    df = spark.createDataFrame([(*r, "k", 2) for r in rows], SCHEMA + ", key string, m int")
    got = collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _plain(rows, 30) == [("en", 1, "hot phrase here", 80_001, 80_001, 80_001, 240_003, 1_000_000)]


def test_no_rows(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([(1, " . \t", "en"), (2, None, None)], SCHEMA)).collect() == []
