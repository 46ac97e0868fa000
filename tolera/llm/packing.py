"""Best-fit packing with a dominance reduction, on the histogram of piece lengths.

A packing depends on lengths only, and there are at most ``capacity`` of them, so the instance that is solved is
a count per length, whatever the number of documents.  The reduction (after Martello and Toth) permanently fixes
small sets that provably dominate every alternative for one of their pieces, for any piece, not only the largest:

* a piece that fills a sequence, or with which nothing else fits, stands alone;
* two pieces that fill a sequence exactly go together (any set beside the one could take the other's place);
* if no two others fit beside a piece, it goes with the largest piece that fits;
* if two others fit but not three, it goes with the largest piece that fits if that is no smaller than the best pair, or
  with the best pair if its larger piece is as large as any piece that fits, and no two pieces that are larger than
  its smaller one fit.

What is left is packed by best-fit decreasing, all pieces of a length at a time.  Pieces then get a number within
their length: buckets of pieces count their lengths, running sums over the buckets give each bucket its first numbers,
and each bucket numbers its own, so a length that many pieces share costs no task more than its share.

Defined results: a null or empty text is the end token alone; null and repeated ids are packed like any other,
one result row per piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tolera.llm import bpe
from tolera.llm import common as C
from tolera.llm.graph import settle

CAPACITY, END = 2048, 0
#: Distinct words that a task remembers.
KNOWN = 400_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocab: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end token, cut only where they are
    more than ``capacity``; then the first piece is the shorter one.  With ``added``, an added token of the
    vocabulary is one id wherever a text holds it, as in the tokenizers library by default; else it is plain text."""
    path = bpe.vocabulary(vocab)
    tail = np.uint32(end).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, split = bpe.encoder(path), bpe.splitter()
        literal, single = bpe.added(path) if added else (None, {})
        whole = {t: np.uint32(i).tobytes() for t, i in single.items()}
        known: dict[str, bytes] = {}
        for b in batches:
            out = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts, at = [], 0
                for m in literal.finditer(text or "") if literal else ():
                    parts += [(text[at : m.start()], b""), ("", whole[m[0]])]
                    at = m.end()
                coded = []
                for part, one in [*parts, ((text or "")[at:], b"")]:
                    words = split(part)
                    for w in words:
                        if w not in known:
                            known[w] = np.array(encode(w.encode()), np.uint32).tobytes()
                    coded += [known[w] for w in words]
                    coded.append(one)
                raw = b"".join(coded) + tail
                if len(known) > KNOWN:
                    known.clear()
                n = len(raw) // 4
                at, size, k = 0, n if n <= capacity else (n % capacity or capacity), 0
                while at < n:
                    out.append((i, k, at, size, zlib.crc32(raw[4 * at : 4 * (at + size)])))
                    at, size, k = at + size, capacity, k + 1
            if out:
                yield from C.rows(PIECES, *zip(*out, strict=True)).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES_DDL)


def reduce(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Takes dominating sets out of ``count`` (pieces per length, changed in place): (lengths, copies)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...], copies: int) -> None:
        if copies:
            fixed.append((lengths, copies))
            for x in lengths:
                count[x] -= copies

    fix((capacity,), int(count[capacity]))
    for a in range(capacity - 1, capacity // 2, -1):
        fix((a, capacity - a), int(min(count[a], count[capacity - a])))
    if capacity % 2 == 0:
        fix((capacity // 2, capacity // 2), int(count[capacity // 2] // 2))
    again = True
    while again:
        again = False
        for big in np.flatnonzero(count)[::-1].tolist():
            while count[big] and (found := dominating(count, capacity, big)):
                lengths, many = np.unique(found, return_counts=True)
                copies = int((count[lengths] // many).min())
                # with fewer pieces about, a set that is found once goes on dominating until one of its lengths runs out
                fix(found, copies if len(found) < 3 else 1)
                again = True
    return fixed


def dominating(count: np.ndarray, capacity: int, big: int) -> tuple[int, ...] | None:
    """A set that holds a piece of length ``big`` and dominates all others that do; None if none is known to."""
    others = count.copy()
    others[big] -= 1
    room = capacity - big
    fits = np.flatnonzero(others[: room + 1])
    if not len(fits):
        return (big,)
    mate = int(fits[-1])
    least = np.repeat(fits, np.minimum(others[fits], 3))[:3]  # the smallest others
    if mate == room or len(least) < 2 or least[:2].sum() > room:
        return big, mate
    if len(least) == 3 and least.sum() <= room:
        return None  # four fit together
    best = max(((int(a), int(b)) for a in fits if (b := _second(others, fits, int(a), room)) is not None), key=lambda p: (sum(p), p[0]), default=None)
    if best is None or mate >= sum(best):
        return big, mate
    a, b = max(best), min(best)
    if a == mate:
        above = np.flatnonzero(others[b + 1 : room + 1]) + b + 1
        two = np.repeat(above, np.minimum(others[above], 2))[:2]
        if len(two) < 2 or two.sum() > room:
            return big, a, b
    return None


def _second(others: np.ndarray, fits: np.ndarray, a: int, room: int) -> int | None:
    """The largest length, at most a, that fits beside a."""
    top = min(a, room - a)
    for b in fits[: np.searchsorted(fits, top, "right")][::-1].tolist():
        if b != a or others[a] > 1:
            return b
    return None


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of counts: (lengths, copies)."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by room that is left
    some = np.zeros(capacity + 1, bool)
    for size in range(capacity, 0, -1):
        left = int(count[size])
        while left:
            fits = np.flatnonzero(some[size:])
            if not len(fits):
                each = capacity // size
                full, over = divmod(left, each)
                for k, copies in ((each, full), (over, 1)):
                    if k and copies:
                        room = capacity - k * size
                        open_[room].append(((size,) * k, copies))
                        some[room] = True
                break
            room = size + int(fits[0])
            lengths, copies = open_[room].pop()
            used = min(copies, left)
            if used < copies:
                open_[room].append((lengths, copies - used))
            some[room] = bool(open_[room])
            open_[room - size].append(((*lengths, size), used))
            some[room - size] = True
            left -= used
    return [x for group in open_ for x in group]


def plan(count: np.ndarray, capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (first rank, first sequence, offset) of its slots, by rank; slot copies are consecutive."""
    left = count.astype(np.int64).copy()
    sets = reduce(left, capacity)
    sets += best_fit(left, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, copies in sets:
        at = 0
        for x in lengths:
            slots.setdefault(x, []).append((used.get(x, 0), sequence, at))
            used[x] = used.get(x, 0) + copies
            at += x
        sequence += copies
    return {x: tuple(np.array(v, np.int64) for v in zip(*s, strict=True)) for x, s in slots.items()}  # type: ignore[misc]


def pack(docs: DataFrame, vocab: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; parameters as in ``pieces``."""
    n = C.parts(docs.sparkSession)
    cut = settle(pieces(docs, vocab, capacity, end, added).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int")))
    counted = settle(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    lengths = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    total = np.zeros(capacity + 1, np.int64)
    for r in lengths:
        total[r["length"]] = r["n"]
    slots = plan(total, capacity)
    named = docs.sparkSession.sparkContext.broadcast(slots)  # sets of lengths: bounded by the capacity
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")  # a row per bucket, not per piece
    # under names of their own: sides of a cogroup that come from one table must not share columns
    first = counted.select(F.col("bucket").alias("slot"), F.col("length").alias("size"), before.alias("before"))
    arrow = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(own: pa.Table, first: pa.Table) -> pa.Table:
        if not len(own):
            return arrow.empty_table()
        own = own.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        length = own.column("length").to_numpy()
        head = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1])))
        base = dict(zip(first.column("size").to_pylist(), first.column("before").to_pylist(), strict=True))
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for a, z in zip(head.tolist(), [*head[1:].tolist(), len(length)], strict=True):
            start, number, at = named.value[int(length[a])]
            rank = base[int(length[a])] + np.arange(z - a)
            k = np.searchsorted(start, rank, "right") - 1
            sequence[a:z], offset[a:z] = number[k] + rank - start[k], at[k]
        out = own.select(PIECES.names).cast(PIECES)
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).cast(arrow)

    return cut.groupBy("bucket").cogroup(first.groupBy("slot")).applyInArrow(place, PIECES_DDL + ", sequence_id long, offset long")
