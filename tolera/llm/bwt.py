"""Merging the Burrows-Wheeler transforms of shards by refining their interleave, for collections that fit one task.

A shard's transform is built from its suffixes once.  Merging never sorts a suffix again: the interleave says, for each
place of the merged order, which shard the next suffix comes from.  It starts with the shards end to end; a step reads
every shard's transform in the order of the interleave and deals its places out, stably, by the symbol read, which
orders them by one more symbol.  Places that a step parts have a common prefix as long as the step's number, so after
``depth`` steps the places that are still together are the intervals of suffixes that share ``depth`` symbols.

``suffix`` uses another method for whole corpora: the README has the figures of this one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Shard(NamedTuple):
    """symbols: the symbol before each suffix, in the order of suffixes (0: a text starts there); doc, at: where each suffix
    starts.  The first suffixes are the ends of texts, in the order of texts."""

    symbols: np.ndarray
    doc: np.ndarray
    at: np.ndarray


def transform(texts: list[bytes]) -> Shard:
    """Of one shard, by doubling prefixes; ends of texts are smaller than any byte and differ from each other."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    ends = np.cumsum(sizes) - 1
    symbol = text.astype(np.int64) + 1
    symbol[ends] = 0
    doc = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(text)) - np.repeat(ends + 1 - sizes, sizes)
    n = len(text)
    rank = symbol + len(texts)
    rank[ends] = np.arange(len(texts))
    _, rank = np.unique(rank, return_inverse=True)
    order, step = np.argsort(rank, kind="stable"), 1
    while n and rank.max() + 1 < n:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        order = np.lexsort((after, rank))
        new = np.concatenate(([0], (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
    before = np.where(at[order] > 0, symbol[order - 1], 0).astype(np.uint16)
    return Shard(before, doc[order], at[order])


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each place in the merged order by ``depth`` symbols, whether a place starts an interval of common prefixes)."""
    size = np.array([len(s.symbols) for s in shards], np.int64)
    texts = np.array([int((s.symbols == 0).sum()) for s in shards], np.int64)
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    symbols = np.concatenate([s.symbols for s in shards]) if shards else np.zeros(0, np.uint16)
    shard = np.repeat(np.arange(len(shards), dtype=np.uint16), size)
    ends = np.repeat(np.arange(len(shards), dtype=np.uint16), texts)
    start = np.zeros(len(shard), bool)
    start[:1] = True
    for _ in range(depth):
        # the n-th place of a shard reads the n-th symbol of its transform
        by = np.argsort(shard, kind="stable")
        read = np.empty(len(shard), np.uint16)
        read[by] = symbols[np.arange(len(by)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(base, size)]
        order = np.argsort(read, kind="stable")
        group, moved = np.cumsum(start), read[order]
        start = np.concatenate(([True], (moved[1:] != moved[:-1]) | (group[order][1:] != group[order][:-1]))) if len(order) else start
        shard = shard[order]
        shard[: len(ends)] = ends  # ends of texts keep the order of texts
        start[: len(ends) + 1] = True
    return shard, start


def late(shards: list[Shard], places: list[np.ndarray], sizes: list[np.ndarray], depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per shard, (text, start) of each window of ``depth`` symbols that also starts in a text of a smaller place."""
    shard, start = merge(shards, depth)
    by = np.argsort(shard, kind="stable")
    doc, at, place, room = (np.empty(len(shard), np.int64) for _ in range(4))
    doc[by], at[by] = (np.concatenate([getattr(s, f) for s in shards]) for f in ("doc", "at"))
    place[by] = np.concatenate([p[s.doc] for s, p in zip(shards, places, strict=True)])
    room[by] = np.concatenate([z[s.doc] for s, z in zip(shards, sizes, strict=True)])
    whole = at + depth <= room
    head = np.flatnonzero(start)
    least = np.minimum.reduceat(np.where(whole, place, np.iinfo(np.int64).max), head) if len(head) else np.zeros(0, np.int64)
    gone = whole & (place > np.repeat(least, np.diff(np.append(head, len(shard)))))
    return [(doc[gone & (shard == k)], at[gone & (shard == k)]) for k in range(len(shards))]
