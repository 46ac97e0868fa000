"""Word-level substring removal by seed and extend.

Documents are joined on winnowed anchors (runs of 8 words), every shared anchor is extended both ways to the
windows that chose it, and the maximal repeated intervals over the length threshold are removed; the first
occurrence of each stays.  See ``repeats`` for the exchange.

Defined results: a null or empty text has no words; a null doc_id counts as smaller than any id; rows that
repeat a doc_id stand at the same place, so of their equal windows those that start later go, whichever row
they are in, and those with equal starts stay; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tolera.llm import common as C
from tolera.llm import repeats

SEED = 8


def spec(window: int = 20) -> repeats.Spec:
    return repeats.spec(window, SEED, words=True, within=True)


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    words = text.split()
    if len(starts):
        stay = repeats.keep_of(len(words), starts, ends)
        words, n = [w for w, s in zip(words, stay.tolist(), strict=True) if s], len(words)
    else:
        n = len(words)
    return n, n - len(words), b" ".join(words)


def digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(i, text, starts, ends):  # noqa: ANN001, ANN202
        n, gone, kept = _kept(text, starts, ends)
        return i, n, gone, hashlib.sha256(kept).hexdigest()

    return repeats.remove(docs, spec(window), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", arrow)


def removed(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, text (what is left; unchanged where nothing is removed), n_words, n_removed, spans of removed words,
    place (xxhash64 of the whole text: with doc_id it names the row that a verdict is for)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("place", pa.int64())])

    def finish(i, text, starts, ends):  # noqa: ANN001, ANN202
        n, gone, kept = _kept(text, starts, ends)
        return i, (kept if gone else text).decode(), n, gone, [{"start": int(a), "end": int(z)} for a, z in zip(starts, ends, strict=True)], int(np.uint64(xxhash.xxh64_intdigest(text, 42)).view(np.int64))

    return repeats.remove(docs, spec(window), finish, "doc_id long, text string, n_words long, n_removed long, spans array<struct<start:long,end:long>>, place long", arrow)


__all__ = ["C", "digest", "removed", "spec"]
