"""Whole queries of the classifiers against plain versions, and texts beyond a
megabyte through Spark."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np

from driftline.llm import common, labels, mixing, quality_crf, token_counts, token_files, toxicity_fm
from driftline.llm.common import table
from driftline.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def _known(spark, label: str) -> dict[int, int]:
    """Labels that may be learned, by a plain pass over the rows."""
    out: dict[int, int] = {}
    for r in table(spark, SF, "labels").collect():
        if r.doc_id is not None and r[label] is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            out[r.doc_id] = max(r[label], out.get(r.doc_id, 0))
    return out


def _agree(got: list, want: dict[int, float], threshold: float) -> None:
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-6
        assert r.predicted == (r.score >= threshold) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_by_all_pairs(spark):
    """Buckets by sets, and every pair of a document's terms summed up one by one."""
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, SF, "documents").collect()}
    known = _known(spark, "toxic")
    assert len(known) <= toxicity_fm.SAMPLE
    number: dict[bytes, int] = {}

    def buckets(text: bytes) -> list[int]:
        terms = set(re.findall(rb"[0-9a-z\x80-\xff]+", text.lower()))
        for t in terms - number.keys():
            number[t] = int(common.word_hashes([t])[0][0] >> np.uint64(64 - toxicity_fm.BITS))
        return sorted({number[t] for t in terms})

    sets = {i: buckets(t) for i, t in docs.items()}
    train = sorted((i for i in known if i in docs), key=lambda i: (sum(b * b % 1_000_003 for b in sets[i]), len(sets[i]), known[i]))
    offsets = np.append(0, np.cumsum([len(sets[i]) for i in train]))
    model = toxicity_fm.fit(np.array([b for i in train for b in sets[i]]), offsets, np.array([known[i] for i in train]))
    place = {b: k for k, b in enumerate(model.active.tolist())}
    want = {}
    for i, own in sets.items():
        at = [place[b] for b in own if b in place]
        z = model.bias + sum(float(model.weights[k]) for k in at)
        for m, a in enumerate(at):
            for b in at[m + 1 :]:
                z += float(model.factors[a] @ model.factors[b])
        want[i] = 1 / (1 + math.exp(-min(max(z, -35), 35)))
    _agree(toxicity_fm.toxicity_scores(table(spark, SF, "documents"), table(spark, SF, "labels")).collect(), want, toxicity_fm.THRESHOLD)


_SIGNS = [b"!?", b"%$#*&@^~_=+<>\\{}[]", b"|", b"0123456789", b".,;:"]


def _features(text: bytes) -> tuple[list[list[float]], list[int]]:
    """A list of features for each line, spelled out."""
    lines = text.split(b"\n")
    often = Counter(lines)
    own = []
    for line in lines:
        latin = [line[k] for k in range(len(line)) if k and line[k - 1] == 0xC3]
        upper = sum(65 <= c <= 90 for c in line) + sum(0x80 <= c <= 0x9E for c in latin)
        lower = sum(97 <= c <= 122 for c in line) + sum(c > 0x9E for c in latin)
        words = re.findall(rb"[^\x20\x09-\x0d]+", line)
        w, letters = max(len(words), 1), upper + lower
        n = [sum(c in s for c in line) for s in _SIGNS]
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        own.append([1, upper / max(letters, 1), *[min(2 * x / w, 2) for x in n[:3]], repeats / w, n[3] / max(len(line), 1), min(n[4] / w, 2), min(letters / w, 20) / 10, math.log1p(len(line)) / 10, len(words) < 3, often[line] > 1 and len(line) > 0])
    none = [0.0] * 6
    rows = [[*own[k], *(own[k - 1][1:7] if k else none), *(own[k + 1][1:7] if k + 1 < len(own) else none)] for k in range(len(own))]
    return rows, [len(x) for x in lines]


def _marginals(scores: list[float], move: np.ndarray) -> list[float]:
    """P(bad) of each line, by sums over the labels before and after it."""
    emit = [(1.0, math.exp(min(max(s, -30), 30))) for s in scores]
    step = [[math.exp(move[a][b]) for b in (0, 1)] for a in (0, 1)]

    def one_way(order: range, next_: bool) -> list[tuple[float, float]]:
        out, last = {}, None
        for k in order:
            if last is None:
                v = emit[k]
            else:
                v = tuple(emit[k][b] * sum(last[a] * (step[b][a] if next_ else step[a][b]) for a in (0, 1)) for b in (0, 1))
            last = out[k] = (v[0] / sum(v), v[1] / sum(v))
        return [out[k] for k in range(len(emit))]

    there, back = one_way(range(len(emit)), False), one_way(range(len(emit) - 1, -1, -1), True)
    out = []
    for e, f, b in zip(emit, there, back, strict=True):
        good, bad = f[0] * b[0] / e[0], f[1] * b[1] / e[1]
        out.append(bad / (good + bad))
    return out


def test_quality_line_by_line(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, SF, "documents").collect()}
    known = _known(spark, "quality")
    assert len(known) <= quality_crf.SAMPLE
    lines = {i: _features(t) for i, t in docs.items()}
    train = sorted((i for i in known if i in docs), key=lambda i: (zlib.crc32(docs[i]) << 31 | len(docs[i]), known[i]))
    x = np.array([f for i in train for f in lines[i][0]], dtype=np.float32)
    length = np.array([n for i in train for n in lines[i][1]], dtype=float)
    offsets = np.append(0, np.cumsum([len(lines[i][1]) for i in train]))
    model = quality_crf.fit(x, length, offsets, np.array([known[i] for i in train]))
    want = {}
    for i, (rows, sizes) in lines.items():
        bad = _marginals([float(np.float32(r) @ model.weights) for r in np.array(rows, dtype=np.float32)], model.transition)
        weight = [n + 1e-6 for n in sizes]
        badness = sum(b * w for b, w in zip(bad, weight, strict=True)) / sum(weight)
        want[i] = 1 / (1 + math.exp(-min(max(model.intercept - model.slope * badness, -35), 35)))
    _agree(quality_crf.quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels")).collect(), want, quality_crf.THRESHOLD)


def test_the_sample_is_bounded(spark):
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    assert labels.labelled_sample(docs, known, "toxic", 10).count() == 10


def test_texts_beyond_a_megabyte(spark):
    """Parts are entered: counts and ids are the library's, sizes are whole."""
    from tokenizers import Tokenizer

    texts = ["Some words, and MORE of them. " * 60_000, "x" * 1_300_000, None, "é漢 " * 300_000]
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for name, run in (("word_bpe_49k.json", token_counts.token_counts), ("byte_bpe_50k.json", None)):
        library = Tokenizer.from_file(tokenizer_path(name))
        ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        if run is not None:
            assert {r.doc_id: r.n_tokens for r in run(df, tokenizer_path(name)).collect()} == {i: len(x) for i, x in enumerate(ids)}
            continue
        files = token_files.write_token_files(df, tokenizer_path(name))
        got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.read_digests(spark, files).collect()}
        assert got == {i: (len(x) + 1, zlib.crc32(np.array([*x, 2], dtype="<u4").tobytes())) for i, x in enumerate(ids)}
    sizes = {r.doc_id: r.size for r in mixing.mixing_report(df).collect()}
    assert sizes == {i: len((t or "").split()) for i, t in enumerate(texts)}
