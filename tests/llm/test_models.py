from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np

from driftline.llm import common, lm_ctw, quality_crf, toxicity_fm
from driftline.llm.common import table

from . import plain

SF = "/root/testdata/sf0.01"


def _kt(a: int, b: int) -> float:
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class PlainTree:
    """The same model by recursion over dictionaries."""

    def __init__(self, streams: list[bytes], depth: int) -> None:
        self.depth, self.counts = depth, Counter()
        for s in streams:
            for context, prefix, bit in self.decisions(s):
                for d in range(depth + 1):
                    self.counts[context[depth - d :], prefix, bit] += 1
        self.nodes = {(c, p) for c, p, _ in self.counts}
        self.below: dict = {}
        for c, p in self.nodes:
            if c:
                self.below.setdefault((c[1:], p), set()).add((c, p))
        self.memo: dict = {}

    def decisions(self, s: bytes):
        data = b"\n" * self.depth + s
        for i in range(self.depth, len(data)):
            bits = f"{data[i]:08b}"
            for j in range(8):
                yield data[i - self.depth : i], bits[:j], int(bits[j])

    def weighted(self, c: bytes, p: str) -> float:
        if (c, p) not in self.memo:
            kt = _kt(self.counts[c, p, 0], self.counts[c, p, 1])
            self.memo[c, p] = kt if len(c) == self.depth else np.logaddexp(kt, sum(self.weighted(*x) for x in self.below[c, p])) - math.log(2)
        return self.memo[c, p]

    def logp(self, s: bytes) -> float:
        total = 0.0
        for context, p, bit in self.decisions(s):
            q = None
            for d in range(self.depth, -1, -1):
                c = context[self.depth - d :]
                if (c, p) not in self.nodes:
                    continue
                a, b = self.counts[c, p, 0], self.counts[c, p, 1]
                own = (b + 0.5) / (a + b + 1)
                share = 1.0 if q is None else math.exp(_kt(a, b) - self.weighted(c, p)) / 2
                q = own if q is None else share * own + (1 - share) * q
            q = 0.5 if q is None else q
            total += math.log10(q if bit else 1 - q)
        return total


def test_language_model(spark):
    texts = {i: t for i, t in enumerate(["the cat sat", "The cat\tsat on a mat", None, "", "the dog", "ÄÖ ß x", "a rat sat on the cat", "the cat sat", "zzz qqq"] * 2)}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(None, "the cat", 1)], "doc_id long, text string, score int")
    out = lm_ctw.score_texts(df).collect()
    rows = {r.doc_id: r for r in out}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts} | {None: False}
    texts[None] = "the cat"
    stream = {i: b" ".join(plain.words(t)) + b"\n" for i, t in texts.items()}
    tree = PlainTree([stream[i] for i in texts if not held[i]], lm_ctw.DEPTH)
    count = Counter()
    for i, t in texts.items():
        if not held[i]:
            count.update([*plain.words(t), b"\n"])
    n, v = sum(count.values()), len(count)
    assert any(held.values())
    for i, r in rows.items():
        w = [*plain.words(texts[i]), b"\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-9
        assert abs(r.score - tree.logp(stream[i])) < 1e-5
        assert abs(r.bits_per_byte + r.score * math.log2(10) / len(stream[i])) < 1e-9
    blocks = {r.doc_id: r for r in lm_ctw.score_texts(df.unionByName(df), block=40).collect()}
    twice = {r.doc_id: r for r in lm_ctw.score_texts(df.unionByName(df)).collect()}
    assert all(abs(blocks[i].score - twice[i].score) < 1e-6 and blocks[i].n_known == twice[i].n_known for i in twice)
    assert lm_ctw.score_texts(df.limit(0)).count() == 0
    # Few pairs are common at 1 / 512 of all here; all or none give the same.
    counts = lm_ctw.corpus_counts(df.select("doc_id", lm_ctw.held_out().alias("held_out"), "text"))
    one, all_ = ({r.key: r.logp for r in lm_ctw.pair_probabilities(counts, n).collect()} for n in (1, 1 << 30))
    assert one.keys() == all_.keys() and max(abs(one[k] - all_[k]) for k in one) < 1e-9
    assert len(lm_ctw.score_texts(df.unionByName(df), block=40).collect()) == 2 * len(out)


def test_long_texts_in_parts(monkeypatch):
    """Codes and line features are the same, taken whole or in parts."""
    import random

    r = random.Random(3)
    lines = ["".join(r.choice("ab Cé. %1") for _ in range(r.randint(0, 60))) for _ in range(3000)] * 2
    text = "\n".join(lines).encode()
    whole = lm_ctw.pair_codes([text])
    x, length, offsets = quality_crf.line_features([text])
    for module in (lm_ctw, quality_crf):
        monkeypatch.setattr(module, "PART", 5000)
        monkeypatch.setattr(module, "parts", lambda t, s=module.WHITE if module is quality_crf else common.WHITE: common.parts(t, s, 5000))
    got = list(lm_ctw.code_parts([text]))
    assert len(got) > 20 and np.array_equal(np.concatenate([c for c, _ in got]), whole[0])
    y, length_y, offsets_y = quality_crf.line_features([text])
    assert np.array_equal(x, y) and np.array_equal(length, length_y) and np.array_equal(offsets, offsets_y)
    assert len(x) == 6000 and x[:, 11].sum() > 5000


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 2, 7.5, 100, 1e5, 1e9])
    assert np.allclose(lm_ctw._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


def test_chain_by_enumeration():
    r = np.random.RandomState(2)
    scores, offsets = r.normal(size=9), np.array([0, 1, 5, 5, 9])
    move = r.normal(size=(2, 2))
    bad, pair = quality_crf.chain(scores, offsets, move)
    k = 0
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        ways = {y: math.exp(sum(scores[a + i] for i in range(b - a) if y[i]) + sum(move[y[i - 1], y[i]] for i in range(1, b - a))) for y in itertools.product((0, 1), repeat=b - a)}
        z = sum(ways.values())
        for i in range(b - a):
            assert abs(bad[a + i] - sum(w for y, w in ways.items() if y[i]) / z) < 1e-9
            if i:
                for s, t in itertools.product((0, 1), repeat=2):
                    assert abs(pair[k, s, t] - sum(w for y, w in ways.items() if (y[i - 1], y[i]) == (s, t)) / z) < 1e-9
                k += 1


def test_machine_pairs():
    r = np.random.RandomState(1)
    w, v = r.normal(size=6), r.normal(size=(6, 3))
    at, offsets = np.array([0, 2, 5, 1]), np.array([0, 3, 3, 4])
    z, _ = toxicity_fm._odds(0.5, w, v, at, offsets)
    assert np.allclose(z, [0.5 + w[0] + w[2] + w[5] + v[0] @ v[2] + v[0] @ v[5] + v[2] @ v[5], 0.5, 0.5 + w[1]])


def _accuracy(rows, known):
    held = [(r.predicted, known[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in known]
    return np.mean([p == y for p, y, _ in held])


def test_classifiers_on_held_out(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    for scores, label, least in ((quality_crf.quality_scores, "quality", 0.93), (toxicity_fm.toxicity_scores, "toxic", 0.92)):
        rows = scores(docs, labels).collect()
        known = {r.doc_id: r[label] for r in labels.collect()}
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
        assert _accuracy(rows, known) >= least
        again = scores(docs.repartition(5), labels.repartition(3)).collect()
        assert np.allclose(sorted(r.score for r in rows), sorted(r.score for r in again), rtol=0, atol=1e-9)


def test_classifier_odd_cases(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a\n\nb", "x"), (2, "word " * 50_000, "x")], "doc_id long, text string, label string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert quality_crf.quality_scores(docs, labels).count() == 4
        assert toxicity_fm.toxicity_scores(docs, labels).count() == 4
        assert quality_crf.quality_scores(docs.limit(0), labels).count() == 0
        assert toxicity_fm.toxicity_scores(docs.limit(0), labels).count() == 0
    kept = quality_crf.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == 4
