"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, scored per token.

The model has order 2: p(w | u) = d(c) c(u, w) / c(u) where the pair was seen, else a(u) p(w); p(w) = d(c) c(w) / N where
the word was seen, else the mass that the discounts left, which all unknown words share.  a(u) is the left mass of u
over the lower-order mass of what u was not seen with, so that p(. | u) sums to one.  u of a first word is the start.

Counts live in partitioned tables: words by their hash, pairs by the hash of u, or, where u is so common that one part
would hold too much of the corpus (more than a quarter of a part's share), by the hash of the pair; the sums that such
a u needs are then added up over the parts.  Each bucket of documents asks for its distinct words and pairs (packed),
and scores its texts with the answers.  A few numbers about the whole corpus (N, the number of distinct words, how many
words have counts 1 to 6) are the only thing that the driver sees.

Defined results: a null or empty text is the end token alone; a null doc_id takes part in training; repeated rows count
and are scored each; with nothing to learn from, every token is unknown and its probability is one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolera.llm import common as C

FOLDS, HELD = 7, 2
#: Counts up to K are discounted.
K = 5
#: Bytes of text that are cut into words at once.
PIECE = 1 << 18
START, END, WHOLE = (C.mix(np.array([x], np.uint64), 99)[0] for x in (1, 2, 3))
LOW48 = np.uint64((1 << 48) - 1)
PACKET = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
DDL = "part int, bucket int, kind int, data binary"
WORDS, COUNTS, PAIRS, SCORES, SUMS, TOTALS, ASKED = range(7)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def discounts(n: np.ndarray) -> np.ndarray:
    """d[r] for r = 0..K from n[r], the number of events seen r times (n[1..K+1]); 1 beyond K.

    Good-Turing as Katz has it; where the counts of counts don't allow it, (r - 1/2) / r."""
    d = np.ones(K + 1)
    for r in range(1, K + 1):
        d[r] = (r - 0.5) / r
        if n[1] > 0 and n[r] > 0:
            common = (K + 1) * n[K + 1] / n[1]
            if common < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < x < 1:
                    d[r] = x
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return count * np.where(count <= K, d[np.minimum(count, K)], 1.0)


class Unigram:
    """p(w) from counts; stats: N, V, n[1..K+1]."""

    def __init__(self, stats: np.ndarray):
        self.n, self.v = int(stats[0]), int(stats[1])
        of = np.concatenate(([0], stats[2 : K + 3])).astype(float)
        self.d = discounts(of)
        left = sum((1 - self.d[r]) * r * of[r] for r in range(1, K + 1))
        self.total = float(self.n) if left > 0 else self.n + 1.0
        self.unknown = (left if left > 0 else 1.0) / self.total

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, discounted(count, self.d) / self.total, self.unknown)


def tokens(ids: list, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, whether it is its text's first, document, trained on) of a bucket, in text order; ends included."""
    word, first, doc, train = [], [], [], []
    learn = np.array([not held_out(i) for i in ids], bool)
    for a, z in C.chunks(texts, PIECE):
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[a:z]])[:-1])).astype(np.int64)
        starts, _, h = C.words_of(np.frombuffer(b"\n".join(texts[a:z]), np.uint8), lower=True)
        d = np.searchsorted(begin, starts, "right") - 1
        count = np.bincount(d, minlength=z - a)
        out = np.full(len(h) + z - a, END, np.uint64)
        out[np.arange(len(h)) + d] = h
        owner = np.repeat(np.arange(a, z, dtype=np.int32), count + 1)
        start = np.zeros(len(out), bool)
        start[np.cumsum(count + 1) - count - 1] = True
        word.append(out), first.append(start), doc.append(owner), train.append(learn[owner])
    whole = []
    for pieces in (word, first, doc, train):
        whole.append(np.concatenate(pieces))
        pieces.clear()
    return tuple(whole)  # type: ignore[return-value]


def _packets(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return C.rows(PACKET, *zip(*rows, strict=True)) if rows else PACKET.empty_table()


def _of_kind(packets: pa.Table, kind: int) -> dict[int, list[np.ndarray]]:
    k, p, d = packets.column("kind").to_pylist(), packets.column("part"), packets.column("data")
    return {p[i].as_py(): C.unpack(d[i].as_py()) for i, x in enumerate(k) if x == kind}


# ---- words --------------------------------------------------------------------------------------------------


def _distinct(x: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values ascending, how often each is in training, the number of each place's value; lean on memory."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(x) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    values = ordered[head]
    del ordered
    at = np.empty(len(x), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    count = np.add.reduceat(train[order], head, dtype=np.int64).astype(np.uint32) if len(x) else np.zeros(0, np.uint32)
    return values, count, at


def _word_counts(word: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words ascending, their local training counts, the number of each token's word."""
    return _distinct(word, train)


def _send_words(n: int, seen: Callable[[pa.Table], tuple[list, list[bytes]]]) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        word, _, _, train = tokens(*seen(group))
        keys, count, _ = _word_counts(word, train)
        bucket = group.column("bucket")[0].as_py()
        return _packets([(p, bucket, WORDS, C.pack(keys[x], count[x])) for p, x in C.deal(C.part_of(keys, n), n)])

    return run


def _scan_words(n: int) -> Callable:
    """As above from a scan, without dealing texts out: for numbers about the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []

        def send() -> Iterator[pa.RecordBatch]:
            word, _, _, train = tokens(ids, texts)
            keys, count, _ = _word_counts(word[train], train[train])
            yield from _packets([(p, 0, WORDS, C.pack(keys[x], count[x])) for p, x in C.deal(C.part_of(keys, n), n)]).to_batches()
            ids.clear(), texts.clear()

        size = 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), C.as_bytes(b.column("text")), strict=True):
                ids.append(i), texts.append(t)
                size += len(t)
                if size > 12 << 20:
                    yield from send()
                    size = 0
        if ids:
            yield from send()

    return run


def _totals(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, at = np.unique(keys, return_inverse=True)
    return np.bincount(at, weights=count, minlength=len(uniq)).astype(np.int64), at


def _stats(group: pa.Table) -> pa.Table:
    data = [C.unpack(x) for x in group.column("data").to_pylist()]
    total, _ = _totals(np.concatenate([d[0] for d in data]), np.concatenate([d[1] for d in data]))
    total = total[total > 0]
    found = np.concatenate(([total.sum(), len(total)], np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2])).astype(np.int64)
    return pa.table({f"s{i}": [int(x)] for i, x in enumerate(found)})


def corpus(docs: DataFrame) -> Unigram:
    n = C.parts(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = [f"s{i}" for i in range(K + 3)]
    found = plain.mapInArrow(_scan_words(n), DDL).groupBy("part").applyInArrow(_stats, ", ".join(f"{c} long" for c in names))
    total = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
    return Unigram(np.array([total[c] for c in names], np.int64))


def _count_words(group: pa.Table) -> pa.Table:
    part, bucket = group.column("part")[0].as_py(), group.column("bucket").to_pylist()
    data = [C.unpack(x) for x in group.column("data").to_pylist()]
    total, at = _totals(np.concatenate([d[0] for d in data]), np.concatenate([d[1] for d in data]))
    every, i, out = total[at].astype(np.uint32), 0, []
    for b, d in zip(bucket, data, strict=True):
        out.append((part, b, COUNTS, C.pack(every[i : i + len(d[0])])))
        i += len(d[0])
    return _packets(out)


# ---- pairs --------------------------------------------------------------------------------------------------


class Bucket:
    """A bucket's tokens, its distinct words with their counts in the corpus, its distinct pairs in part order."""

    def __init__(self, ids: list, texts: list[bytes], packets: pa.Table, model: Unigram, n: int):
        word, starts, self.doc, train = tokens(ids, texts)
        texts.clear()  # not needed again, and a task's memory is short
        self.keys, _, self.word = _word_counts(word, train)
        del word
        answers = _of_kind(packets, COUNTS)
        self.count = np.concatenate([answers[p][0] for p in sorted(answers)]).astype(np.int64)
        context = np.concatenate(([0], self.word[:-1]))
        context[starts] = len(self.keys)  # the start is no word
        every = np.append(self.keys, START)
        # a start is followed by a token in every training text, as often as there are ends
        at = np.searchsorted(self.keys, END)
        self.seen = np.append(self.count, self.count[at] if at < len(self.keys) and self.keys[at] == END else 0)
        uniq, local, self.pair = _distinct(context.astype(np.int64) * len(self.keys) + self.word, train)
        del context
        u, w = (uniq // len(self.keys)).astype(np.int32), (uniq % len(self.keys)).astype(np.int32)
        del uniq
        hot = self.seen[u] > max(1000, model.n // (4 * n))
        part = C.part_of(np.where(hot, C.mix(every[u] ^ C.mix(self.keys[w], 5), 6), C.mix(every[u], 7)), n)
        order = np.lexsort((self.keys[w], every[u], part))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.pair = rank[self.pair]
        self.u, self.w, self.local, self.hot, self.part = u[order], w[order], local[order], hot[order], part[order]
        self.every = every


def _send_pairs(model: Unigram, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, packets: pa.Table) -> pa.Table:
        if not len(docs):
            return PACKET.empty_table()
        b = Bucket(*C.in_order(docs), packets, model, n)
        bucket, out = docs.column("bucket")[0].as_py(), []
        for p, x in C.deal(b.part, n):
            u = b.u[x]
            head = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            follow = np.diff(np.concatenate((head, [len(u)]))).astype(np.uint32)
            w = b.w[x]
            known = np.where(b.local[x] > 0, b.count[w], 0).astype(np.uint32)  # only pairs seen here need p(w) there
            out.append((p, bucket, PAIRS, C.pack(b.every[u[head]], follow, b.hot[x][head].astype(np.uint8), b.keys[w] & LOW48, b.local[x], known)))
        common = np.append(np.unique(b.every[b.u[b.hot]]), WHOLE)
        to = C.part_of(C.mix(common, 8), n)
        order = np.argsort(to, kind="stable")
        out += [(p, bucket, ASKED, C.pack(common[order[x]])) for p, x in C.deal(to[order], n)]
        return _packets(out)

    return run


def _count_pairs(model: Unigram, n: int, far: bool) -> Callable[[pa.Table], pa.Table]:
    """To buckets: c(u, w) of each pair; n[1..K] and the lower-order mass of each u.  With ``far``, to parts instead: sums
    of common u, how many pairs have counts 1 to K+1, and what buckets asked for."""

    def run(group: pa.Table) -> pa.Table:
        part, bucket = group.column("part")[0].as_py(), group.column("bucket").to_pylist()
        kind, data = group.column("kind").to_pylist(), group.column("data").to_pylist()
        out = [(part, b, ASKED, d) for b, k, d in zip(bucket, kind, data, strict=True) if far and k == ASKED]
        bucket = [b for b, k in zip(bucket, kind, strict=True) if k == PAIRS]
        data = [C.unpack(d) for d, k in zip(data, kind, strict=True) if k == PAIRS]
        if not data:
            return _packets(out)
        head_u, follow, hot, w, local, known = (np.concatenate([d[i] for d in data]) for i in range(6))
        u_of = np.repeat(np.arange(len(head_u)), follow)
        us, u_at = np.unique(head_u, return_inverse=True)
        common = np.zeros(len(us), bool)
        common[u_at[hot > 0]] = True
        u = u_at[u_of]
        order = np.lexsort((w, u))
        a, b = u[order], w[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        head = np.flatnonzero(new)
        total = np.add.reduceat(local[order].astype(np.int64), head)
        least = np.maximum.reduceat(known[order], head)
        owner = a[head]
        sums = np.zeros((len(us), K + 1))
        for r in range(1, K + 1):
            sums[:, r - 1] = np.bincount(owner[total == r], minlength=len(us))
        seen = total > 0
        sums[:, K] = np.bincount(owner[seen], weights=model.p(least[seen].astype(np.int64)), minlength=len(us))
        if not far:
            every = np.empty(len(order), np.uint32)
            every[order] = total[np.cumsum(new) - 1]
            i, j = 0, 0
            for bk, d in zip(bucket, data, strict=True):
                k = u_at[i : i + len(d[0])]
                small = sums[k, :K].T.astype(np.uint32).ravel()
                out.append((part, bk, SCORES, C.pack(every[j : j + len(d[3])], small, sums[k, K])))
                i, j = i + len(d[0]), j + len(d[3])
            return _packets(out)
        spread = np.flatnonzero(common)
        keys = np.append(us[spread], WHOLE)
        whole = np.append(np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2], 0)[: K + 1]
        table = np.vstack((sums[spread], whole))
        to = C.part_of(C.mix(keys, 8), n)
        order = np.argsort(to, kind="stable")
        for p, x in C.deal(to[order], n):
            out.append((p, part, SUMS, C.pack(keys[order[x]], table[order[x]].ravel())))
        return _packets(out)

    return run


def _add_sums(group: pa.Table) -> pa.Table:
    """Sums of the common contexts that a part is in charge of, to each bucket those that it asked for."""
    part, kind = group.column("part")[0].as_py(), group.column("kind").to_pylist()
    bucket, data = group.column("bucket").to_pylist(), [C.unpack(x) for x in group.column("data").to_pylist()]
    sums = [d for d, k in zip(data, kind, strict=True) if k == SUMS]
    if not sums:
        return PACKET.empty_table()
    keys, at = np.unique(np.concatenate([d[0] for d in sums]), return_inverse=True)
    rows = np.concatenate([d[1].reshape(-1, K + 1) for d in sums])
    total = np.stack([np.bincount(at, weights=rows[:, j], minlength=len(keys)) for j in range(K + 1)], axis=1)
    out = []
    for b, d, k in zip(bucket, data, kind, strict=True):
        if k == ASKED:
            i = np.searchsorted(keys, d[0])
            known = keys[np.minimum(i, len(keys) - 1)] == d[0]
            out.append((part, b, TOTALS, C.pack(d[0][known], total[i[known]].ravel())))
    return _packets(out)


# ---- scores -------------------------------------------------------------------------------------------------

OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
OUT_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pair_probability(count: np.ndarray, context: np.ndarray, low: np.ndarray, few: np.ndarray, mass: np.ndarray, d: np.ndarray) -> np.ndarray:
    """p(w | u) from c(u, w), c(u), p(w), n[1..K] of u (rows of ``few``), lower-order mass of what follows u."""
    left = (few * ((1 - d[1:]) * np.arange(1, K + 1))).sum(axis=1)
    total = np.where(left > 0, context, context + 1.0)  # nothing discounted: one more event is kept for the unseen
    left = np.where(left > 0, left, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.where(count > 0, discounted(count, d) / total, left / total / (1 - mass) * low)
    return np.where(context > 0, p, low)


def _score(model: Unigram, n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, packets: pa.Table) -> pa.Table:
        if not len(docs):
            return OUT.empty_table()
        ids, texts = C.in_order(docs)
        b = Bucket(ids, texts, packets, model, n)
        answers = _of_kind(packets, SCORES)
        sums: dict[int, np.ndarray] = {}
        for keys, table in _of_kind(packets, TOTALS).values():
            sums.update(zip(keys.tolist(), table.reshape(-1, K + 1), strict=True))
        whole = sums.get(int(WHOLE), np.zeros(K + 1))
        d = discounts(np.concatenate(([0], whole)))
        log_p = np.zeros(len(b.u))
        for p, x in C.deal(b.part, n):
            count, small, mass = answers[p]
            u = b.u[x]
            new = np.concatenate(([True], u[1:] != u[:-1]))
            head, of = np.flatnonzero(new), np.cumsum(new) - 1
            few, mass = small.reshape(K, -1).T.astype(float), mass.copy()
            for i in np.flatnonzero(b.hot[x][head]):
                row = sums[int(b.every[u[head[i]]])]
                few[i], mass[i] = row[:K], row[K]
            log_p[x] = np.log10(pair_probability(count.astype(np.int64), b.seen[u], model.p(b.count[b.w[x]]), few[of], mass[of], d))
        m = len(ids)
        c = b.count[b.word]
        add = lambda v: np.bincount(b.doc, weights=v, minlength=m)
        base = add(np.log10((c + 1) / (model.n + model.v + 1)))
        size, known = np.bincount(b.doc, minlength=m), np.bincount(b.doc[c > 0], minlength=m)
        return C.rows(OUT, ids, [held_out(i) for i in ids], size, known, [model.n] * m, base, add(log_p[b.pair]))

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    n = C.parts(docs.sparkSession)
    model = corpus(docs)
    by_bucket = C.bucketed(docs, C.buckets(docs)).groupBy("bucket")
    counts = by_bucket.applyInArrow(_send_words(n, C.in_order), DDL).groupBy("part").applyInArrow(_count_words, DDL)
    sent = by_bucket.cogroup(counts.groupBy("bucket")).applyInArrow(_send_pairs(model, n), DDL)
    by_part = sent.groupBy("part")  # one exchange, read twice
    totals = by_part.applyInArrow(_count_pairs(model, n, True), DDL).groupBy("part").applyInArrow(_add_sums, DDL)
    answers = counts.unionByName(by_part.applyInArrow(_count_pairs(model, n, False), DDL)).unionByName(totals)
    return by_bucket.cogroup(answers.groupBy("bucket")).applyInArrow(_score(model, n), OUT_DDL)
