"""The Merkle manifest against a plain version, in one list after another."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from driftline.llm.merkle import FIELDS, _row, merkle_manifest


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row: dict) -> str:
    return _h("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def _altered(row: dict) -> str:
    text = row["text"]
    if row["doc_id"] is not None and text is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return _leaf({**row, "text": text})


def _tree(level: list[str]) -> list[list[str]]:
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([_h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def _plain(rows: list[dict]) -> list[tuple]:
    order = lambda x: (x is not None, x.encode() if isinstance(x, str) else x if x is not None else 0)
    groups = sorted({r["lang"] for r in rows}, key=order)
    own = {g: sorted((r for r in rows if r["lang"] == g), key=lambda r: (order(r["doc_id"]), _leaf(r))) for g in groups}
    trees = {g: _tree([_leaf(r) for r in own[g]]) for g in groups}
    upper = _tree([trees[g][-1][0] for g in groups])
    out = []
    for number, g in enumerate(groups):
        for at, r in enumerate(own[g]):
            now, proof = _altered(r), ""
            for levels, place in ((trees[g], at), (upper, number)):
                for level in levels[:-1]:
                    run, i = level[place // 8 * 8 : place // 8 * 8 + 8], place % 8
                    proof += "".join(run[:i] + run[i + 1 :])
                    now, place = _h("".join([*run[:i], now, *run[i + 1 :]])), place // 8
            out.append((r["doc_id"], _leaf(r), trees[g][-1][0], upper[-1][0], _h(proof), now, now == upper[-1][0]))
    return out


def _rows(sizes: dict, seed: int = 1) -> list[dict]:
    pick = random.Random(seed)
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            text = pick.choice([None, "", "small", "Some TEXT", "ÄÖ Ünïcode", "x" * 50_000 + "Q"])
            rows.append({"doc_id": len(rows) * 3 % 1009, "source": pick.choice([None, "", "web"]), "lang": lang, "n_chars": pick.choice([None, 7]), "text": text})
    pick.shuffle(rows)
    return rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 600, "é": 65, "": 1, None: 8, "de": 64}, {f"l{i}": 1 + i % 3 for i in range(70)}])
def test_equals_the_plain_version(spark, sizes):
    rows = _rows(sizes)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(7)
    got = [tuple(r) for r in merkle_manifest(df).collect()]
    assert sorted(got, key=repr) == sorted(_plain(rows), key=repr)
    assert {r[-1] for r in got} <= {True, False}


def test_repeated_and_missing_ids_and_other_columns(spark):
    rows = _rows({"en": 20, None: 3})
    for i in (0, 3, 5):
        rows[i]["doc_id"] = None
    rows += [dict(rows[1]), {**rows[2], "text": "other"}]
    df = spark.createDataFrame([(*r.values(), 1, "x") for r in rows], SCHEMA + ", id int, grp string")
    got = merkle_manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_plain(rows), key=repr)


def test_no_rows(spark):
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_leaves_that_nobody_altered_are_folded_too():
    leaf, other, wrong = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c"))
    root = bytes.fromhex(_h(leaf.hex() + other.hex()))
    assert _row(leaf, (1, leaf), root, root, ((0, [leaf, other]),))[-2:] == (root.hex(), True)
    # A sibling that doesn't lead to the root shows, whether the leaf was altered or not.
    assert _row(leaf, (1, leaf), root, root, ((0, [leaf, wrong]),))[-2:] == (_h(leaf.hex() + wrong.hex()), False)
