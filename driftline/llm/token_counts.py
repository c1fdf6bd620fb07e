"""Token counts with a whole-token shortcut.

The tokenizer drops white space and lower-cases, so ASCII white space always
ends a word and a text's count is the sum over its words. Offline, before any
text is read, every vocabulary string that ends a word is encoded alone; those
that come back as exactly one token are proven. A pre-token in the proven set
counts 1 without a merge. Other words are merged by the library and their count
kept while there is room. A text that holds a special token's string, in
any case, goes to the library whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import PART, batch_of, kept, map_batches, open_read, open_write, parts, scratch_path, slices

LIMIT = 2048


_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = sorted(set(range(256)) - set(_SHOWN))
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(_HIDDEN)}


class Counter:
    """Counts of texts. ``proven`` is the result of ``prove``, made once; where
    it isn't given it's made here."""

    def __init__(self, path: str, proven: frozenset[bytes] | None = None, limit: int = 200_000) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.proven = self.prove() if proven is None else proven
        # Two generations: what is still in use moves on when one is full.
        self.kept: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.limit = limit

    def prove(self) -> frozenset[bytes]:
        """Vocabulary strings that encode alone as themselves, as UTF-8."""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        ends = sorted((s, i) for s, i in vocabulary.items() if s.endswith("</w>"))
        texts = [self.tokenizer.decoder.decode([s]) if self.tokenizer.decoder else self._bytes(s[:-4]) for s, _ in ends]
        pairs = [(t, i) for t, (_, i) in zip(texts, ends, strict=True) if t and t.isprintable() and " " not in t]
        encoded = self.tokenizer.encode_batch_fast([t for t, _ in pairs], add_special_tokens=False)
        return frozenset(t.encode() for (t, i), e in zip(pairs, encoded, strict=True) if e.ids == [i])

    @staticmethod
    def _bytes(s: str) -> str:
        """Undo the byte-level alphabet: printable bytes stand for themselves,
        the others for characters from U+0100 on, in order."""
        try:
            return bytes(_BYTE_OF[c] for c in s).decode()
        except (KeyError, UnicodeDecodeError):
            return ""

    def count(self, texts: list[bytes]) -> list[int]:
        proven, kept, out = self.proven, self.kept, [0] * len(texts)
        if len(kept) > self.limit:
            self.old, self.kept = kept, {}
            kept = self.kept
        split: dict[int, list[bytes]] = {}
        missing: set[bytes] = set()
        for i, text in enumerate(texts):
            # Words are lower-cased below, and may only then look special.
            low = text.lower()
            if any(s in low for s in self.special):
                out[i] = len(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
                continue
            # bytes.lower() is A-Z only: the library lower-cases the same.
            words = low.split()
            whole = sum(map(proven.__contains__, words))
            out[i] = whole
            if whole < len(words):
                split[i] = rest = [w for w in words if w not in proven]
                missing.update(set(rest).difference(kept))
        if missing:
            kept.update((w, self.old[w]) for w in missing if w in self.old)
            new = list(missing.difference(kept))
            got = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
            kept.update(zip(new, (len(e.ids) for e in got), strict=True))
        for i, rest in split.items():
            out[i] += sum(map(kept.__getitem__, rest))
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _load(path: str, proven: str) -> Counter:
    with open_read(proven) as f:
        return Counter(path, frozenset(f.read().split(b"\n")))


def _count_batches(path: str, proven: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = kept(("counter", path, proven), partial(_load, path, proven))
    for batch, texts in slices(batches, "text"):
        if any(len(t) > PART for t in texts):  # white space ends a word, so parts add up
            n = np.array([sum(counter.count([p])[0] for p in parts(t)) for t in texts], dtype=np.int64)
        else:
            n = np.array(counter.count(texts), dtype=np.int64)
        yield batch_of(_OUT, [batch.column(0), [len(t) for t in texts], n, n > limit])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``).

    The proof is made once, here, and written to the shared folder (a line for
    each proven string); executors read it. A null text is empty: no bytes, no
    tokens. Very long texts are counted in parts. Null and repeated ids are
    kept row for row; other columns are ignored; an empty table stays empty.
    """
    proven = scratch_path(docs.sparkSession, "proven")
    with open_write(proven) as f:
        f.write(b"\n".join(sorted(Counter(tokenizer).proven)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, partial(_count_batches, tokenizer, proven, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
