"""Byte-level substring removal (exact repeats of 50 bytes and more, across documents).

Defined results: a null text is empty; a null doc_id counts as smaller than any id; rows that repeat a doc_id
stand at the same place and never remove each other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tolera.llm import repeats

SEED = 16  # bytes; the seed hash reads two 8-byte words


def spec(window: int = 50) -> repeats.Spec:
    return repeats.spec(window, SEED, words=False, within=False)


def digest(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every document."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def finish(i, text, starts, ends):  # noqa: ANN001, ANN202
        gone = int((ends - starts).sum())
        kept = np.frombuffer(text, np.uint8)[repeats.keep_of(len(text), starts, ends)].tobytes() if gone else text
        return i, len(text), gone, len(starts), hashlib.sha256(kept).hexdigest()

    return repeats.remove(docs, spec(window), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", arrow)
