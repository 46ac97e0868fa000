"""Repeated windows of a corpus: seeds by winnowing, extension both ways, first occurrences by part.

Used by the word-level and the byte-level substring removal.  A *window* is ``width`` consecutive symbols of
one document.  A window is *late* if its symbols also start earlier: in a document of smaller id, or (with
``within``) earlier in the same document.

1. Winnowing picks for each window the least hash among its ``width - seed + 1`` seeds of ``seed`` symbols
   (the leftmost of equals).  Equal windows pick equal seeds at equal places, so no repeated window is missed.
2. Buckets of documents send their distinct seed keys, packed; a part answers which occur more than once.
3. For those seeds only, each bucket sends what surrounds them.  Equal surroundings in a bucket travel once,
   with the smallest place, so copies by the thousand add one entry per bucket to a part, not one each.
4. Each part extends every shared seed to all windows that chose it and finds the smallest place of each;
   its answer is a bit mask of late windows per entry.  For bytes, the surroundings that the buckets (shards) sent
   are merged like Burrows-Wheeler transforms, by refining their interleave one column at a time.
5. Buckets merge late windows into maximal repeated intervals.

Documents meet their answers in a cogroup by bucket; nothing is gathered on the driver, no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolera.llm import common as C

#: Positions take the low bits of a packed (hash, position) value.
POS_BITS = 24
_POS = np.uint64((1 << POS_BITS) - 1)
#: Symbols that are worked on at once, so that arrays stay in the cache.
PIECE = 1 << 18
PACKET = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
PACKET_DDL = "part int, bucket int, kind int, data binary"


@dataclass(frozen=True)
class Spec:
    """width: symbols of a window; seed: symbols of a seed; words: symbols are words, else bytes;
    within: earlier places of the same document count."""

    width: int
    seed: int
    words: bool
    within: bool

    def __post_init__(self) -> None:
        if not 1 <= self.seed <= self.width or self.choices > 64:  # a bit mask has a bit per choice
            raise ValueError(f"windows of {self.width} symbols can't have seeds of {self.seed}")

    @property
    def choices(self) -> int:
        return self.width - self.seed + 1


@dataclass
class Runs:
    """Runs of windows that chose one seed: document, first symbol of the seed in it and in ``values``, first and
    last window start relative to the seed (<= 0), seed key, hash of all the symbols that the windows cover."""

    doc: np.ndarray
    at: np.ndarray
    source: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    key: np.ndarray
    digest: np.ndarray
    values: np.ndarray

    def only(self, x: np.ndarray) -> Runs:
        return Runs(*[a[x] for a in (self.doc, self.at, self.source, self.lo, self.hi, self.key, self.digest)], self.values)


def spec(window: int, seed: int, words: bool, within: bool) -> Spec:
    """Seeds of ``seed`` symbols, shorter for shorter windows and longer for windows of more than 63 symbols beyond it."""
    return Spec(window, max(min(seed, window), window - 63), words, within)


def symbols(texts: list[bytes], spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(64-bit or byte symbols, document of each, place of each in its document), piece by piece.

    A document of more than 2**23 symbols comes in pieces that share width - 1 symbols, so that every window
    lies in exactly one piece."""
    most = 1 << (POS_BITS - 1)
    for a, b in C.chunks(texts, PIECE):
        buf = np.frombuffer(b"\n".join(texts[a:b]), np.uint8)
        sizes = np.fromiter((len(t) for t in texts[a:b]), np.int64, b - a)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        if spec.words:
            starts, _, values = C.words_of(buf)
            doc = np.searchsorted(begin, starts, "right") - 1
        else:
            values = buf
            doc = np.repeat(np.arange(b - a), sizes + 1)[: len(buf)]
        first = np.searchsorted(doc, np.arange(b - a))
        place = np.arange(len(values)) - first[doc] if len(values) else np.zeros(0, np.int64)
        doc = doc + a
        if not spec.words:
            inside = place < sizes[doc - a]  # not the separator
            doc = np.where(inside, doc, -1 - doc)
        for at in range(0, max(1, len(values) - spec.width + 1), most):
            to = at + most + spec.width - 1
            yield values[at:to], doc[at:to], place[at:to]


def runs(values: np.ndarray, doc: np.ndarray, place: np.ndarray, spec: Spec, digests: bool) -> Runs | None:
    n = len(values) - spec.width + 1
    if n <= 0:
        return None
    if spec.words or spec.seed != 16:
        seeds = C.window_hash(values if spec.words else C.BYTE_CODE[values], spec.seed)
    else:
        eight = np.ndarray(len(values) - 7, np.uint64, np.ascontiguousarray(values), strides=(1,)).copy()
        with np.errstate(over="ignore"):
            seeds = C.mix(eight[:-8] * np.uint64(C.BASE) + eight[8:] * np.uint64(0xD6E8FEB86659FD93))  # 16 bytes
    packed = (seeds & ~_POS) | np.arange(len(seeds), dtype=np.uint64)
    chosen = (C.sliding_min(packed, spec.choices) & _POS).astype(np.int64)
    valid = (doc[:n] == doc[spec.width - 1 :]) & (doc[:n] >= 0)
    # doc is constant over a valid window: ids only change at separators or word borders of documents
    s = np.flatnonzero(valid)
    if not len(s):
        return None
    c, d = chosen[s], doc[s]
    head = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (d[1:] != d[:-1]) | (np.diff(s) != 1))))
    tail = np.concatenate((head[1:], [len(s)])) - 1
    at, first, last = c[head], s[head], s[tail]
    digest = np.zeros(0, np.uint64)
    if digests:
        with np.errstate(over="ignore"):
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum((values if spec.words else C.BYTE_CODE[values]) * C.powers(len(values), C.BASE), out=total[1:])
            covered = (total[last + spec.width] - total[first]) * C.powers(len(values), C.BASE_INV)[first]
            digest = C.mix(covered ^ C.mix(((first - at) * 256 + last - at).astype(np.uint64), 3))
    return Runs(d[head].astype(np.int32), place[at], at, (first - at).astype(np.int8), (last - at).astype(np.int8), C.mix(seeds[at], 1), digest, values)


def _bucket(texts: list[bytes], spec: Spec, digests: bool) -> Iterator[Runs]:
    for piece in symbols(texts, spec):
        if (r := runs(*piece, spec, digests)) is not None:
            yield r


def _keys(texts: list[bytes], spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Distinct seed keys of a bucket in ascending order, and which occur more than once in it."""
    found = [r.key for r in _bucket(texts, spec, False)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    keys, count = np.unique(np.concatenate(found), return_counts=True)
    return keys, count > 1


def send_keys(spec: Spec, n: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        keys, more = _keys(C.in_order(group)[1], spec)
        sent = [(p, C.pack((keys[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.packbits(more[x]))) for p, x in C.deal(C.part_of(keys, n), n)]
        return C.rows(PACKET, [p for p, _ in sent], [bucket] * len(sent), [0] * len(sent), [z for _, z in sent])

    return run


def find_shared(group: pa.Table) -> pa.Table:
    """Per bucket and part, a bit for each of its keys: does the key occur anywhere else, or twice there?

    A part's keys share their high bits; those left are told apart by 32 bits more.  A chance match costs a
    needless comparison later, never a wrong result."""
    part = group.column("part")[0].as_py()
    buckets, data = group.column("bucket").to_pylist(), [C.unpack(x) for x in group.column("data").to_pylist()]
    keys = np.concatenate([d[0] for d in data])
    more = np.concatenate([np.unpackbits(d[1], count=len(d[0])).astype(bool) for d in data])
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = k[1:] == k[:-1]
    shared = np.empty(len(k), bool)
    shared[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    shared |= more
    out, at = [], 0
    for b, d in zip(buckets, data, strict=True):
        out.append((b, C.pack(np.packbits(shared[at : at + len(d[0])]), np.array([len(d[0])], np.int64))))
        at += len(d[0])
    return C.rows(PACKET, [part] * len(out), [b for b, _ in out], [1] * len(out), [z for _, z in out])


class Entries:
    """The shared seeds of a bucket; equal surroundings are one entry with the smallest place."""

    def __init__(self, ids: list, texts: list[bytes], shared: dict[int, np.ndarray], spec: Spec, n: int):
        pieces = list(_bucket(texts, spec, True))
        keys, at = np.unique(np.concatenate([r.key for r in pieces]) if pieces else np.zeros(0, np.uint64), return_inverse=True)
        wanted = np.zeros(len(keys), bool)
        for p, x in C.deal(C.part_of(keys, n), n):
            if p in shared:
                wanted[x] = shared[p][: x.stop - x.start]
        wanted = wanted[at]
        self.pieces, begin = [], 0
        for r in pieces:
            self.pieces.append(r.only(np.flatnonzero(wanted[begin : begin + len(r.key)])))
            begin += len(r.key)
        join = lambda name, t: np.concatenate([getattr(r, name) for r in self.pieces]).astype(t) if self.pieces else np.zeros(0, t)
        self.doc, self.at, self.lo, self.hi, self.key, digest = (join(*a) for a in (("doc", np.int64), ("at", np.int64), ("lo", np.int8), ("hi", np.int8), ("key", np.uint64), ("digest", np.uint64)))
        number = np.array([-(2**63) if i is None else i for i in ids], np.int64)
        self.place = number[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        # One row stands for all that are alike: part first, so that a part's entries are in one slice.
        order = np.lexsort((self.at, self.place, digest, self.key))
        k, g = self.key[order], digest[order]
        head = np.concatenate(([True], (k[1:] != k[:-1]) | (g[1:] != g[:-1]))) if len(order) else np.zeros(0, bool)
        self.unit = np.empty(len(order), np.int64)
        self.unit[order] = np.cumsum(head) - 1
        self.lead = order[head]
        self.part = C.part_of(self.key[self.lead], n)

    def around(self, spec: Spec) -> np.ndarray:
        """Of each lead.  Words: the hashes of the windows at -(choices-1) .. 0.  Bytes: the bytes that those windows
        cover.  What no window of the run needs is zero."""
        reach = spec.choices - 1
        wide = spec.choices if spec.words else 2 * reach + spec.seed
        out = np.zeros((len(self.lead), wide), np.uint64 if spec.words else np.uint8)
        col, begin = np.arange(-reach, wide - reach), 0
        for r in self.pieces:
            own = np.flatnonzero((self.lead >= begin) & (self.lead < begin + len(r.key)))
            if len(own):
                x = self.lead[own] - begin
                values = C.window_hash(r.values, spec.width) if spec.words else r.values
                lo, hi = r.lo[x][:, None].astype(np.int64), r.hi[x][:, None].astype(np.int64)
                need = (col >= lo) & (col <= (hi if spec.words else hi + spec.width - 1))
                out[own] = np.where(need, values[np.clip(r.source[x][:, None] + col, 0, len(values) - 1)], values.dtype.type(0))
            begin += len(r.key)
        return out


def _shared(packets: pa.Table, kind: int) -> dict[int, list[np.ndarray]]:
    kinds = packets.column("kind").to_pylist()
    chosen = [i for i, k in enumerate(kinds) if k == kind]
    part, data = packets.column("part"), packets.column("data")
    return {part[i].as_py(): C.unpack(data[i].as_py()) for i in chosen}


def _bits(packets: pa.Table) -> dict[int, np.ndarray]:
    return {p: np.unpackbits(b, count=int(n[0])).astype(bool) for p, (b, n) in _shared(packets, 1).items()}


def send_entries(spec: Spec, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, packets: pa.Table) -> pa.Table:
        if not len(docs) or not len(packets):
            return PACKET.empty_table()
        bucket = docs.column("bucket")[0].as_py()
        e = Entries(*C.in_order(docs), _bits(packets), spec, n)
        text, sent = e.around(spec), []
        for p, x in C.deal(e.part, n):
            i = e.lead[x]
            sent.append((p, C.pack(e.key[i], e.lo[i], e.hi[i], e.place[i], e.at[i], text[x].ravel())))
        return C.rows(PACKET, [p for p, _ in sent], [bucket] * len(sent), [2] * len(sent), [z for _, z in sent])

    return run


def interleaves(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(column, rows in the order of their suffixes from that column on), from the last column to the first.

    The rows are the aligned strings of all shards, shard after shard.  Before the first step nothing of a suffix is
    known, and the interleave lays the shards end to end.  A step reads the Burrows-Wheeler column, that is, the
    symbols that precede the suffixes in their present order, and deals the interleave out by it, stably: one counting
    pass refines the merged order by a symbol, and no suffixes are compared or sorted."""
    order = np.arange(len(text))
    columns = np.ascontiguousarray(text.T)
    for p in range(len(columns) - 1, -1, -1):
        order = order[np.argsort(columns[p][order], kind="stable")]
        yield p, order


def _starts(h: np.ndarray) -> np.ndarray:
    """Which of some hashes in order differ from the one before."""
    return np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)


def _by_bytes(text: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(r, entries with a window at r in the merged order of suffixes, which of them start an interval of equal windows).

    In that order the suffixes with a common prefix of ``width`` bytes are an interval.  A rolling hash of the prefix
    tells most ends; where neighbours have equal hashes their bytes are compared."""
    rolling = np.zeros(len(text), np.uint64)
    code, base, out_of = C.BYTE_CODE, np.uint64(C.BASE), C.powers(width + 1, C.BASE)[width]
    with np.errstate(over="ignore"):
        for p, order in interleaves(text):
            rolling = code[text[:, p]] + base * rolling
            if p + width < text.shape[1]:
                rolling -= out_of * code[text[:, p + width]]
            if (r := p - reach) <= 0:
                x = order[(lo[order] <= r) & (hi[order] >= r)]
                new = _starts(rolling[x])
                for i in np.array_split(like := np.flatnonzero(~new), 1 + len(like) // PIECE):
                    new[i] = (text[x[i], p : p + width] != text[x[i - 1], p : p + width]).any(axis=1)
                yield r, x, new


def _by_words(text: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for r in range(-reach, 1):
        x = np.flatnonzero((lo <= r) & (hi >= r))
        h = C.mix(text[x, r + reach] ^ C.mix(key[x], 2))
        order = np.argsort(h, kind="stable")
        yield r, x[order], _starts(h[order])


def find_late(spec: Spec) -> Callable[[pa.Table], pa.Table]:
    """Extends every seed of a part to its windows; answers with the late windows of each entry."""
    reach = spec.choices - 1

    def run(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        buckets, data = group.column("bucket").to_pylist(), [C.unpack(x) for x in group.column("data").to_pylist()]
        key, lo, hi, place, at, text = (np.concatenate([d[j] for d in data]) for j in range(6))
        text = text.reshape(len(key), -1)
        by = np.lexsort((at, place) if spec.within else (place,))
        new = np.concatenate(([True], place[by][1:] != place[by][:-1]))
        if spec.within:
            new[1:] |= at[by][1:] != at[by][:-1]
        rank = np.empty(len(key), np.int64)
        rank[by] = np.cumsum(new)
        late = np.zeros(len(key), np.uint64)
        # Words: the hash of a window comes with its entry.  Bytes: the merged order of the shards' suffixes.
        for r, x, new in _by_words(text, key, lo, hi, reach) if spec.words else _by_bytes(text, lo, hi, spec.width, reach):
            if len(x) < 2:
                continue
            head = np.flatnonzero(new)
            ranks = rank[x]
            least = np.repeat(np.minimum.reduceat(ranks, head), np.diff(np.concatenate((head, [len(x)]))))
            late[x[ranks > least]] |= np.uint64(1 << (r + reach))
        out, a = [], 0
        for b, d in zip(buckets, data, strict=True):
            out.append((b, C.pack(late[a : a + len(d[0])])))
            a += len(d[0])
        return C.rows(PACKET, [part] * len(out), [b for b, _ in out], [3] * len(out), [z for _, z in out])

    return run


def late_cover(ids: list, texts: list[bytes], packets: pa.Table, spec: Spec, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document, (starts, ends) of the maximal intervals of symbols that late windows cover."""
    none = np.zeros(0, np.int64)
    out = [(none, none)] * len(texts)
    if not len(packets):
        return out
    e = Entries(ids, texts, _bits(packets), spec, n)
    answers = {p: d[0] for p, d in _shared(packets, 3).items()}
    mask = np.zeros(len(e.lead), np.uint64)
    for p, x in C.deal(e.part, n):
        mask[x] = answers[p]
    reach = spec.choices - 1
    lead = e.lead[e.unit]
    later = e.place > e.place[lead]
    if spec.within:
        later |= (e.place == e.place[lead]) & (e.at > e.at[lead])
    docs, starts = [], []
    bits = mask[e.unit]
    for r in range(-reach, 1):
        x = np.flatnonzero((e.lo <= r) & (e.hi >= r) & (later | ((bits >> np.uint64(r + reach)) & np.uint64(1)).astype(bool)))
        docs.append(e.doc[x]), starts.append(e.at[x] + r)
    d, s = np.concatenate(docs), np.concatenate(starts)
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    if not len(d):
        return out
    head = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + spec.width))))
    tail = np.concatenate((head[1:], [len(d)])) - 1
    a, z, owner = s[head], s[tail] + spec.width, d[head]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in np.unique(owner):
        out[i] = (a[first[i] : first[i + 1]], z[first[i] : first[i + 1]])
    return out


def remove(docs: DataFrame, spec: Spec, finish: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """finish(id, text, starts, ends) -> the result's values for one document."""
    n = C.parts(docs.sparkSession)
    by_bucket = C.bucketed(docs, C.buckets(docs)).groupBy("bucket")
    keys = by_bucket.applyInArrow(send_keys(spec, n), PACKET_DDL)
    shared = keys.groupBy("part").applyInArrow(find_shared, PACKET_DDL)
    entries = by_bucket.cogroup(shared.groupBy("bucket")).applyInArrow(send_entries(spec, n), PACKET_DDL)
    late = entries.groupBy("part").applyInArrow(find_late(spec), PACKET_DDL)

    def end(group: pa.Table, packets: pa.Table) -> pa.Table:
        if not len(group):
            return arrow.empty_table()
        ids, texts = C.in_order(group)
        found = late_cover(ids, texts, packets, spec, n)
        got = [finish(i, t, a, z) for i, t, (a, z) in zip(ids, texts, found, strict=True)]
        return C.rows(arrow, *zip(*got, strict=True))

    return by_bucket.cogroup(shared.unionByName(late).groupBy("bucket")).applyInArrow(end, schema)


def keep_of(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n symbols stay."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, ends, -1)
    return np.cumsum(gone)[:n] == 0


__all__ = ["Spec", "keep_of", "remove", "spec"]
