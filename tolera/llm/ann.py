"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes least distance by one more coordinate (root of the largest squared norm less the
vector's own; zero for queries), so p-stable hashes h(x) = floor((a.x + b) / w) of the longer vectors apply.  A
table's cell is the tuple of its hashes.  A query visits, in each table, its own cell and cells perturbed by -1 or
+1 in some hashes, in the estimated order of success: by the summed squared distances to the boundaries crossed,
enumerated from a template of their expected values.  Candidates of all tables are reranked by the exact measure.

The number of hashes follows the number of vectors, so that cells stay near ``CELL`` rows.  How many cells a query
visits is measured, not fixed: for ``SAMPLE`` queries (a documented bound, those of least id hash) the true neighbours
are found in blocks against all rows, and the fewest visits are taken that reach ``TARGET`` of them.  There is no cap: where
queries would have to visit so many cells that they met every row ``OVER`` times, they are compared with every row once,
in blocks; and so are single queries that found fewer than k.  Every vector is indexed.

Vectors travel once to each part that holds a cell of theirs, queries once to each part that they visit, and a
part's cells are read in place.  Cells of more than a block's rows are dealt to several parts, and probes visit all
of these.  There are at most 2**20 such cells, as a block is at least that share of all entries, so the list of
them is bounded, whatever the input.

Defined results: vectors that are null, zero, or with a null or non-finite component take no part; null ids take no
part; vectors of different lengths are not compared with each other; rows that repeat an id are separate candidates
(those of equal score count once), but a query's own id never is one of its candidates, and of repeated queries the rows together
are one query with the vector that comes first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import copy
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolera.llm import common as C
from tolera.llm.graph import settle

CELL, BLOCK, WIDTH = 256, 4096, 1.5
TABLES = 12
#: Queries whose true neighbours are looked up to choose the number of visits, and the share to be found.
SAMPLE, TARGET = 96, 0.95
#: How often a query may meet every row before it is better compared with all of them at once.
OVER = 8
#: Bytes of vectors in a part, and queries in a block, at most.
PART, ASKED = 32 << 20, 1024


def hashes_for(n: int) -> int:
    """Hashes of a table: a hash of width WIDTH (in norms) tells about 1.46 bits."""
    return max(1, round(math.log2(max(2.0, n / CELL)) / 1.46))


def template(k: int, probes: int) -> list[tuple[int, ...]]:
    """The first ``probes`` sets of ranks 0..2k-1 (boundaries from near to far) in ascending expected score.

    The ranks r and 2k-1-r are the two boundaries of one hash, so no set holds both."""
    cost = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) if j < k else 1 - (2 * k - j) / (k + 1) + (2 * k - j) * (2 * k - j + 1) / (4 * (k + 1) * (k + 2)) for j in range(2 * k)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, s = heapq.heappop(heap)
        if all(2 * k - 1 - j not in s for j in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*s, last + 1)))
    return out


class Tables:
    def __init__(self, dim: int, n: int, norm: float, tables: int = TABLES, probes: int = 1, seed: int = 11):
        self.k, self.norm, self.count = hashes_for(n), max(norm, 1e-300), tables
        rng = np.random.RandomState(seed)
        self.a = rng.standard_normal((dim + 1, tables * self.k))
        self.b = rng.uniform(0, WIDTH, tables * self.k)
        self.sets = template(self.k, probes)

    def visiting(self, probes: int) -> Tables:
        """The same tables with another number of cells that a query visits."""
        out = copy.copy(self)
        out.sets = template(self.k, probes)
        return out

    def _project(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.norm
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        return (x @ self.a[:-1] + more[:, None] * self.a[-1] + self.b) / WIDTH

    def _key(self, table: int, h: np.ndarray) -> np.ndarray:
        key = np.full(len(h), table + 1, np.uint64)
        for j in range(h.shape[1]):
            key = C.mix(key ^ h[:, j].astype(np.int64).view(np.uint64), j)
        return key.view(np.int64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) cell keys of indexed vectors."""
        h = np.floor(self._project(x, False))
        return np.stack([self._key(t, h[:, t * self.k : (t + 1) * self.k]) for t in range(self.count)], axis=1)

    def probes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables * sets) cell keys that queries visit."""
        p = self._project(x, True)
        out = []
        for t in range(self.count):
            own = p[:, t * self.k : (t + 1) * self.k]
            h = np.floor(own)
            away = np.concatenate((own - h, 1 - (own - h)), axis=1)  # to the lower, to the upper boundary
            order = np.argsort(away, axis=1, kind="stable")
            for s in self.sets:
                moved = h.copy()
                for rank in s:
                    which = order[:, rank]
                    moved[np.arange(len(h)), which % self.k] += np.where(which < self.k, -1, 1)
                out.append(self._key(t, moved))
        return np.stack(out, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(data)
    return data.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _lean(x: np.ndarray) -> np.ndarray:
    """As floats of half the size where that loses nothing."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return small if np.array_equal(small, x) else x


PACKET = pa.schema([("part", pa.int64()), ("asks", pa.bool_()), ("data", pa.binary())])
PACKET_DDL = "part long, asks boolean, data binary"
FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
FOUND_DDL = "query_id long, ids array<long>, scores array<double>"
FINAL = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
FINAL_DDL = "query_id long, rank int, vec_id long, score double"


def _send(keys_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], parts: int, asks: bool) -> Callable:
    """Packets for each part: ids and vectors that have a key there, once each, and (vector, key) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 1024):
                own = b.slice(at, 1024)
                x, ids = _matrix(own.column("x")), own.column("vec_id").to_numpy()
                who, key = keys_of(x, ids)
                part = C.part_of(C.mix(key.view(np.uint64), 21), parts)
                order = np.lexsort((key, who, part))
                who, key, part = who[order], key[order], part[order]
                lean, out = _lean(x), []
                for p, s in C.deal_some(part):
                    distinct, row = np.unique(who[s], return_inverse=True)
                    out.append((p, asks, C.pack(ids[distinct], lean[distinct].ravel(), row.astype(np.uint32), key[s])))
                if out:
                    yield from C.rows(PACKET, *zip(*out, strict=True)).to_batches()

    return run


def _joined(data: list[list[np.ndarray]], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, rows, keys) of a part's packets; the same vector in several packets stays several rows."""
    ids = np.concatenate([d[0] for d in data])
    x = np.concatenate([d[1].astype(np.float64).reshape(-1, dim) for d in data])
    base = np.cumsum([0, *[len(d[0]) for d in data]])
    return ids, x, np.concatenate([d[2].astype(np.int64) + o for d, o in zip(data, base, strict=False)]), np.concatenate([d[3] for d in data])


def few_of_equals(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Which rows stay if of equal vectors only those of the ``most`` smallest ids do: the others tie with them and lose."""
    mark = (x * np.random.RandomState(7).standard_normal(x.shape[1])).sum(axis=1)
    order = np.lexsort((ids, mark))
    new = np.concatenate(([True], mark[order][1:] != mark[order][:-1])) if len(order) else np.zeros(0, bool)
    like = np.flatnonzero(~new)
    new[like] = (x[order[like]] != x[order[like - 1]]).any(axis=1)
    same = np.concatenate(([False], ids[order][1:] == ids[order][:-1])) & ~new  # a row again
    count = np.cumsum(~same)
    keep = np.zeros(len(order), bool)
    keep[order] = ~same & (count - np.repeat(count[new], np.diff(np.append(np.flatnonzero(new), len(order)))) < most)
    return keep


class Pool:
    """The best rows seen of each query; ``bar`` is what a further row has to reach, less what rounding may hide."""

    def __init__(self, queries: int, k: int):
        self.bar, self.k, self.size = np.full(queries, -np.inf), k, 0
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.kept.append((query, row, score))
        self.size += len(query)
        if self.size > 1 << 21:
            self.squeeze()

    def squeeze(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all that may still be among the k best, by query."""
        query, row, score = (np.concatenate([p[i] for p in self.kept] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((row, query))
        query, row, score = query[order], row[order], score[order]
        once = np.concatenate(([True], (query[1:] != query[:-1]) | (row[1:] != row[:-1]))) if len(query) else np.zeros(0, bool)
        query, row, score = query[once], row[once], score[once]
        order = np.lexsort((-score, query))
        query, row, score = query[order], row[order], score[order]
        head = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
        full = head[np.diff(np.append(head, len(query))) >= self.k]
        last = score[full + self.k - 1]
        self.bar[query[full]] = last - 1e-9 * (1 + np.abs(last))
        stay = score >= self.bar[query]
        self.kept = [(query[stay], row[stay], score[stay])]
        self.size = int(stay.sum())
        return query[stay], row[stay]


def _compare(dim: int, k: int) -> Callable[[pa.Table], pa.Table]:
    """The k nearest in a part for each query that visits it, among all rows of the cells that it names: a cell's rows and
    its visitors are one product of matrices."""

    def run(group: pa.Table) -> pa.Table:
        asks = np.array(group.column("asks").to_pylist(), bool)
        if asks.all() or not asks.any():
            return FOUND.empty_table()
        data = [C.unpack(v) for v in group.column("data").to_pylist()]
        ids, x, row, key = _joined([d for d, a in zip(data, asks, strict=True) if not a], dim)
        stays = few_of_equals(x, ids, k + 1)[row]
        row, key = row[stays], key[stays]
        order = np.argsort(key, kind="stable")
        row, key = row[order], key[order]
        own, q, asker, cell = _joined([d for d, a in zip(data, asks, strict=True) if a], dim)
        order = np.argsort(cell, kind="stable")
        asker, cell = asker[order], cell[order]
        pool = Pool(len(own), k)
        for c, visit in C.deal_some(cell):
            who = asker[visit]
            first, end = (int(np.searchsorted(key, c, side)) for side in ("left", "right"))
            step = max(1, (1 << 21) // len(who))
            for at in range(first, end, step):
                rows = row[at : min(at + step, end)]
                rough = q[who] @ x[rows].T
                i, j = np.nonzero(rough >= pool.bar[who][:, None])
                other = ids[rows[j]] != own[who[i]]
                i, j = i[other], j[other]
                pool.add(who[i], rows[j], rough[i, j])
        query, rows = pool.squeeze()
        score = np.concatenate([(x[rows[a : a + 8192]] * q[query[a : a + 8192]]).sum(axis=1) for a in range(0, len(rows), 8192)] or [np.zeros(0)])
        order = np.lexsort((ids[rows], -score, query))
        query, near, score = query[order], ids[rows[order]], score[order]
        out = []
        for i, x_ in C.deal_some(query):
            z = min(x_.stop, x_.start + k)
            out.append((int(own[i]), near[x_.start : z], score[x_.start : z]))
        return C.rows(FOUND, *zip(*out, strict=True)) if out else FOUND.empty_table()

    return run


def _merge(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        query = np.repeat(group.column("query_id").to_numpy(), group.column("ids").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        ids = group.column("ids").combine_chunks().flatten().to_numpy()
        scores = group.column("scores").combine_chunks().flatten().to_numpy()
        # a candidate seen in several tables counts once
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        new = np.concatenate(([True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1]))) if len(query) else np.zeros(0, bool)
        query, ids, scores = query[new], ids[new], scores[new]
        head = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
        place = np.arange(len(query)) - np.repeat(head, np.diff(np.concatenate((head, [len(query)])))) + 1
        x = place <= k
        return C.rows(FINAL, query[x], place[x], ids[x], scores[x])

    return run


def merged(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from lists of candidates."""
    n = C.parts(found.sparkSession)
    return found.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int")).groupBy("part").applyInArrow(_merge(k), FINAL_DDL)


def compared_with_all(good: DataFrame, asked: DataFrame, dim: int, n: int, k: int) -> DataFrame:
    """Lists of the k nearest of all rows: rows are dealt into slots, queries into blocks, and each block meets each slot in
    a task of bounded size.  Rows travel once per block of queries."""
    slots = max(C.parts(good.sparkSession), -(-n * dim * 8 // PART))
    blocks = max(1, -(-asked.count() // ASKED))
    mine = np.arange(blocks, dtype=np.int64)

    def rows(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = (C.mix(ids.view(np.uint64), 31) % np.uint64(slots)).astype(np.int64)
        return np.repeat(np.arange(len(ids)), blocks), (slot[:, None] * blocks + mine).ravel()

    def queries(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = (C.mix(ids.view(np.uint64), 32) % np.uint64(blocks)).astype(np.int64)
        return np.repeat(np.arange(len(ids)), slots), (np.arange(slots, dtype=np.int64) * blocks + block[:, None]).ravel()

    # parts are the keys themselves, so that a task never holds two of them
    sent = good.mapInArrow(_send_by_key(rows, False), PACKET_DDL).unionByName(asked.mapInArrow(_send_by_key(queries, True), PACKET_DDL))
    return sent.groupBy("part").applyInArrow(_compare(dim, k), FOUND_DDL)


def _send_by_key(keys_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], asks: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 4096):
                own = b.slice(at, 4096)
                x, ids = _matrix(own.column("x")), own.column("vec_id").to_numpy()
                who, key = keys_of(x, ids)
                order = np.argsort(key, kind="stable")
                lean, out = _lean(x), []
                for p, s in C.deal_some(key[order]):
                    w = who[order[s]]
                    out.append((p, asks, C.pack(ids[w], lean[w].ravel(), np.arange(len(w), dtype=np.uint32), np.full(len(w), p, np.int64))))
                yield from C.rows(PACKET, *zip(*out, strict=True)).to_batches()

    return run


def visits_for(lsh: Tables, pairs: list[tuple[np.ndarray, np.ndarray]], most: float, target: float) -> int | None:
    """The fewest cells per table (a power of two) that find ``target`` of true pairs (query, its neighbours' vectors); None
    if that takes more than ``most``."""
    probes = 1
    q = np.stack([p[0] for p in pairs])
    cells = [lsh.cells(p[1]) for p in pairs]
    while probes <= most:
        tried = lsh.visiting(probes)
        seen = tried.probes(q).reshape(len(q), lsh.count, -1)
        found = total = 0
        for i, own in enumerate(cells):
            found += int(np.any([np.isin(own[:, t], seen[i, t]) for t in range(lsh.count)], axis=0).sum())
            total += len(own)
        if found >= target * total:
            return probes
        if len(tried.sets) < probes:  # there are no more cells to visit
            return None
        probes *= 2
    return None


def search(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for rows whose vec_id is divisible by ``every``, the k nearest found."""
    spark = vectors.sparkSession
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(
        "vec_id is not null and x is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('inf')) and exists(x, v -> v != 0)"
    )
    # one row per length of vectors
    dims = good.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("sq")).orderBy("dim").collect()
    out = spark.createDataFrame([], FINAL_DDL)
    for i, d in enumerate(dims):
        part = _of_length(good.where(F.size("x") == d["dim"]), d["dim"], d["n"], math.sqrt(d["sq"]), every, k, tables, target)
        out = part if not i else out.unionByName(part)
    return out


def _of_length(good: DataFrame, dim: int, n: int, norm: float, every: int, k: int, tables: int, target: float) -> DataFrame:
    """``search`` among vectors of one length."""
    lsh = Tables(dim, n, norm, tables)
    first = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    asked = settle(first)
    # The true neighbours of some queries tell how far one has to look.
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    true = settle(merged(compared_with_all(good, some, dim, n, k), k).select("query_id", "vec_id").distinct())
    of = good.join(F.broadcast(true.select("vec_id").distinct()), "vec_id").groupBy("vec_id").agg(F.min("x").alias("x"))
    near = true.join(of, "vec_id").join(some.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "query_id")
    by: dict[int, tuple[np.ndarray, list]] = {}
    for r in near.select("query_id", "q", "x").collect():  # at most SAMPLE * k rows
        by.setdefault(r["query_id"], (np.array(r["q"], float), []))[1].append(r["x"])
    pairs = [(q, np.array(x, float)) for q, x in by.values()]
    visits = visits_for(lsh, pairs, OVER * (n / (tables * CELL) + 1), target) if pairs else 1
    if visits is None:
        return merged(compared_with_all(good, asked, dim, n, k), k)
    lsh = lsh.visiting(visits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, count = np.unique(lsh.cells(_matrix(b.column("x"))).ravel(), return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(count)], names=["cell", "n"])

    block = max(BLOCK, -(-n * tables >> 20))
    large = good.select("x").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > block).collect()  # at most 2**20
    cell = np.array([r["cell"] for r in large], np.int64)
    order = np.argsort(cell)
    cell, blocks = cell[order], np.array([-(-r["n"] // block) for r in large], np.int64)[order]
    named = good.sparkSession.sparkContext.broadcast((cell, blocks))

    def blocks_of(key: np.ndarray) -> np.ndarray:
        cell, blocks = named.value
        if not len(cell):
            return np.ones(len(key), np.int64)
        at = np.minimum(np.searchsorted(cell, key), len(cell) - 1)
        return np.where(cell[at] == key, blocks[at], 1)

    def in_block(key: np.ndarray, number: np.ndarray) -> np.ndarray:
        return np.where(number > 0, C.mix(key.view(np.uint64) ^ C.mix(number.astype(np.uint64), 41), 42).view(np.int64), key)

    def rows(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who, key = np.repeat(np.arange(len(x)), tables), lsh.cells(x).ravel()
        spread = C.mix(ids.view(np.uint64) ^ C.mix(np.abs(x).sum(axis=1).view(np.uint64), 44), 43)[who]
        return who, in_block(key, (spread % blocks_of(key).astype(np.uint64)).astype(np.int64))

    def queries(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = lsh.probes(x)
        who, key = np.repeat(np.arange(len(x)), key.shape[1]), key.ravel()
        many = blocks_of(key)
        number = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(who, many), in_block(np.repeat(key, many), number)

    parts = max(C.parts(good.sparkSession), -(-n * tables * dim * 8 // PART))
    sent = good.mapInArrow(_send(rows, parts, False), PACKET_DDL).unionByName(asked.mapInArrow(_send(queries, parts, True), PACKET_DDL))
    best = settle(merged(sent.groupBy("part").applyInArrow(_compare(dim, k), FOUND_DDL), k))
    full = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = settle(asked.join(full, "vec_id", "left_anti"))
    if short.isEmpty():
        return best
    rest = merged(compared_with_all(good, short, dim, n, k), k)
    return best.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(*FINAL.names).unionByName(rest)
