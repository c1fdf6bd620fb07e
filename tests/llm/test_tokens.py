from __future__ import annotations

import zlib

import numpy as np
import pytest

from driftline.llm import token_counts, token_files
from driftline.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "a  b", " a\n\n b ", "don't, it's!!", "x  y", "naïve, été;;'s", "<|endoftext|> hi <|startoftext|>", "a,b c.d 1,2 3%% $$ ,'ll a'll",
    "café, é, x", "tab\t\tb \n", "　 a", "it,'s ok", "no!'s", "\x1c a\x1d ", "日本語 テキスト。 emoji 👍🏽,", "word " * 30_000, "Ünïcödé ÄÖÜ×÷, ÿ.", "a  b"]


def _library(name: str, texts: list) -> list[list[int]]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)] + [(None, "a b", 0), (3, TEXTS[3], 0)], "doc_id long, text string, n_tokens int")
    rows = token_counts.token_counts(df, tokenizer_path("word_bpe_49k.json")).collect()
    want = [len(x) for x in _library("word_bpe_49k.json", TEXTS)]
    got = {r.doc_id: r for r in rows}
    assert [got[i].n_tokens for i in range(len(TEXTS))] == want
    assert [got[i].n_bytes for i in range(len(TEXTS))] == [len((t or "").encode()) for t in TEXTS]
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows) and got[17].over_limit
    assert len(rows) == len(df.collect()) and got[None].n_tokens == 2
    assert token_counts.token_counts(df.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_special_strings_in_other_case():
    texts = ["a <|ENDOFTEXT|> b", "<|EndOfText|>", "x<|STARTOFTEXT|>y", "<|endoftext|>A <|ENDOFTEXT|>"]
    got = token_counts.Counter(tokenizer_path("word_bpe_49k.json")).count([t.encode() for t in texts])
    assert got == [len(x) for x in _library("word_bpe_49k.json", texts)]


def test_proven_strings_are_one_token():
    c = token_counts.Counter(tokenizer_path("word_bpe_49k.json"))
    assert len(c.proven) > 30_000
    sample = sorted(c.proven)[::97]
    assert all(len(x) == 1 for x in _library("word_bpe_49k.json", [s.decode() for s in sample]))


def test_files(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "x"), (3, TEXTS[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    files = token_files.write_token_files(df, tokenizer_path("byte_bpe_50k.json"), str(tmp_path))
    got = token_files.read_digests(spark, files).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (doc_id, _, _), ids in zip(got, order, _library("byte_bpe_50k.json", [r[1] for r in order]), strict=True):
        ids = np.array([*ids, 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    file = max(files.shards, key=lambda s: s[1])[0]
    streamed = list(token_files.read_records(file))
    shuffled = list(token_files.read_records(file, order=np.arange(len(streamed))[::-1]))
    assert [(i, x.tolist()) for i, x in streamed] == [(i, x.tolist()) for i, x in shuffled][::-1]
    assert token_files.read_digests(spark, token_files.write_token_files(df.limit(0), tokenizer_path("byte_bpe_50k.json"))).count() == 0


def test_damage_is_noticed():
    record, n = token_files.pack_record(5, np.array([1, 70_000], dtype="<u4"))
    assert n == 2 and token_files.unpack_record(record)[1].tolist() == [1, 70_000]
    for at in range(len(record)):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack_record(bytes(bad))
    with pytest.raises(ValueError):
        token_files.unpack_record(record[:-1])
