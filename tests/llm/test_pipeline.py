"""The pipeline stage by stage against plain reimplementations."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as pipeline
from driftline.llm import mixing, quality_crf
from driftline.llm.common import table
from driftline.llm.queries import tokenizer_path

from . import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    documents = table(spark, SF, "documents")
    kept, docs = [], documents
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if i < len(pipeline.STAGES) - 1:
            assert docs.schema.simpleString() == documents.schema.simpleString()
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs)
    quality, unique, clean, mix, tokens = kept
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    scores = quality_crf.quality_scores(documents, table(spark, SF, "labels")).collect()
    assert set(rows(quality)) == {r.doc_id for r in scores if r.score >= 0.7}
    good = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1}
    assert len(good & set(rows(quality))) >= 0.95 * len(good & set(rows(documents)))

    component = plain.near_duplicates(rows(quality), 5, 80)
    assert set(rows(unique)) == {i for i, c in component.items() if i == c}

    items = [plain.shingles(r.text, 5) for r in table(spark, SF, "benchmark").collect()]
    hit = lambda t: any(100 * len(s & plain.shingles(t, 5)) >= 80 * len(s) for s in items)
    assert set(rows(clean)) == {i for i, t in rows(unique).items() if not hit(t)} < set(rows(unique))

    taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mixing_report(clean).collect() if r.size}
    copies = Counter(r.doc_id for r in mix.collect())
    assert {i: n for i, n in copies.items() if i in taken} == {i: n for i, n in taken.items() if n}

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, at = [], 0
    for r in sorted(mix.collect(), key=lambda r: r.doc_id):
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in tokens.collect()) == sorted(want)
    assert sorted(tuple(r) for r in pipeline.run(spark, SF).collect()) == sorted(want)


def test_odd_documents(spark):
    """Nulls, repeated rows, ids that are missing or shared, ties, a text beyond a
    megabyte, and columns with names that operators use."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "x " * 60_000, None, "s", None)]
    story = "the town council met again on a rainy evening to talk about the old bridge over the river"
    rows += [(i, story + f" and of {i}", "en", "t", 1) for i in (7, 8, 8)] + [(9, f"{story} in other words of my own. " * 15_000, "en", "t", 1), (None, story, "en", None, 1)]
    names = ["node", "component", "kept", "size", "start", "rank", "finish", "place", "target", "copies", "epoch", "score", "label", "id", "hash", "b"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for part in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            part = stage(spark, part, SF)
            part = spark.createDataFrame(part.collect(), part.schema)
            if name != "token-ID output":
                assert part.columns == docs.columns
                assert all(tuple(r)[5:] == tuple(names) for r in part.collect())
            if name == "MinHash near-dedup":
                kept = Counter(r.doc_id for r in part.collect())
                assert kept[8] == 0 and kept[7] <= 1 and max(kept.values(), default=0) <= 2
        assert part.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
