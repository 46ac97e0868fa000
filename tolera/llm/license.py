"""License scans by ordered signature rules.

Hundreds of hand-written patterns are gated by a keyword prefilter (one Aho-Corasick pass over the text), so a
pattern runs only on texts that hold its keyword.  Overlapping detections are resolved by priority and interval
containment: a detection inside another of the same or a higher priority is suppressed.

Texts are compared as words joined by single spaces, so punctuation, line breaks and comment signs between the
words of a licence don't matter.

Defined results: a null or wordless text has no detections, null word places, empty labels and score zero; null
and repeated ids are carried through, one result row per input row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolera.llm import common as C
from tolera.llm.license_rules import BASE, RULES

#: Lower case; ASCII that is neither letter nor digit parts words.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Found(NamedTuple):
    start: int  # first word
    end: int  # after the last word
    priority: int
    label: str
    weight: float


@functools.lru_cache(maxsize=1)
def _compiled() -> tuple[object, list[tuple[int, str, float, re.Pattern[bytes]]]]:
    import ahocorasick

    gate = ahocorasick.Automaton()
    by: dict[str, list[int]] = {}
    rules = []
    for label, priority, weight, keyword, pattern in RULES:
        for word in keyword.split("/"):
            by.setdefault(word, []).append(len(rules))
        rules.append((priority, label, weight, re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")))
    for keyword, numbers in by.items():
        gate.add_word(keyword, numbers)
    gate.make_automaton()
    return gate, rules


def suppress(found: list[Found]) -> list[Found]:
    """Without detections that lie in another of the same or a higher priority; of equals the first label and its
    largest weight stay.

    One sweep by start, longest first: whatever contains a detection has come before it, and has come to an end at least
    as far.  The furthest end of each priority is all that has to be known of them, so many detections cost no pairs."""
    furthest: dict[int, int] = {}
    kept: list[Found] = []
    for f in sorted(found, key=lambda f: (f.start, -f.end, -f.priority, f.label, -f.weight)):
        if all(end < f.end for priority, end in furthest.items() if priority >= f.priority):
            kept.append(f)
        furthest[f.priority] = max(furthest.get(f.priority, 0), f.end)
    return sorted(kept)


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[Found]]:
    """Words, base detections (first word, label), signature detections that remain."""
    words = text.translate(_NORMAL).split()
    line = b" ".join(words)
    gate, rules = _compiled()
    # Keywords are ASCII, and Latin-1 keeps byte places.
    wanted = {r for _, numbers in gate.iter(line.decode("latin-1")) for r in numbers}  # type: ignore[attr-defined]
    if not wanted:
        return len(words), [], []
    starts = []
    at = 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    word = lambda byte: bisect.bisect_right(starts, byte) - 1
    base = []
    for phrase, label in BASE.items():
        parts, at = phrase.encode().split(), -1
        while (at := line.find(b" ".join(parts), at + 1)) >= 0:
            i = word(at)
            if starts[i] == at and words[i : i + len(parts)] == parts:
                base.append((i, label))
    found = []
    for r in sorted(wanted):
        priority, label, weight, pattern = rules[r]
        for m in pattern.finditer(line):
            if m.end() > m.start():
                found.append(Found(word(m.start()), word(m.end() - 1) + 1, priority, label, weight))
    return len(words), sorted(base), suppress(found)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "doc_id long, start long, end long, priority int, label string, weight double"


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the probability that at least one
    detection is right, each taken as independent with its rule's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t in zip(b.column("doc_id").to_pylist(), C.as_bytes(b.column("text")), strict=True):
                n, base, found = scan(t)
                own = {x for _, x in base}
                wrong = 1.0
                for f in found:
                    wrong *= 1 - f.weight
                for _ in base:
                    wrong *= 0.1
                out.append((i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(own)), ",".join(sorted(own | {f.label for f in found})), 1 - wrong))
            if out:
                yield from C.rows(OUT, *zip(*out, strict=True)).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DDL)


def detections(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (words), priority, label, weight of every detection that remains."""
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int32()), ("label", pa.string()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *f) for i, t in zip(b.column("doc_id").to_pylist(), C.as_bytes(b.column("text")), strict=True) for f in scan(t)[2]]
            if out:
                yield from C.rows(arrow, *zip(*out, strict=True)).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SPANS)
