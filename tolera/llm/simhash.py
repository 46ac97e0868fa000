"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are stored by plane: word p of a block holds bit p of 64 fingerprints.  A query's distance to the
whole block is then counted by carry-save adders, one plane at a time, in counters that are themselves bit
planes; a block is abandoned as soon as all of its counters exceed the radius.

Which blocks are compared: 64-bit fingerprints at radius 2 are cut into four bands, and any two within the
radius agree in two of them, so the six pairs of bands find every link (pigeonhole).  Cells with more than
``CELL`` fingerprints go another exact way: each emits itself and its 64 one-bit neighbours, and two within
distance 2 share such a midpoint; a midpoint has at most 65 fingerprints, whatever the data.
Only links that connect are emitted (at most one per member of a cell), and components come from ``graph``.

Defined results: null and wordless texts have fingerprint zero and are linked like any other; rows with a null
doc_id get fingerprints, but never name a component (a component of such rows only has a null id); repeated
rows are equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tolera.llm import common as C
from tolera.llm.graph import components, hub_join, settle

#: Distinct fingerprints of a cell that are compared in one task.
CELL = 2048
BANDS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


# ---- fingerprints -------------------------------------------------------------------------------------------


def _fingerprint(text: bytes, words: int) -> int:
    w = text.translate(C.LOWER.tobytes()).split()
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        h = np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    else:
        end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        start = np.concatenate(([0], end[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(line[a:z], 42) for a, z in zip(start[: len(w) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long): a bit is 1 if set in over half the XXH64 of the word shingles."""
    arrow = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            fps = np.array([_fingerprint(t, words) for t in C.as_bytes(b.column("text"))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fps)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- bit-sliced comparison -----------------------------------------------------------------------------------


def planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64 members, lanes) words -> (blocks, 64 * lanes planes): bit j of plane p is bit p of member j."""
    blocks, _, lanes = fps.shape
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(blocks, 64, 8 * lanes), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def within(plane: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Bit j of out[b, q]: member j of block b is within ``radius`` bits of query q of that block.

    plane: (blocks, planes); queries: (blocks, queries, lanes).  Counters are bit planes that start at
    2**k - 1 - radius and saturate on overflow; blocks whose counters have all overflowed leave early."""
    blocks, n, lanes = queries.shape
    width = max(1, int(radius).bit_length())
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    start = (1 << width) - 1 - radius
    counter = [np.full((blocks, n), full if start >> k & 1 else 0, np.uint64) for k in range(width)]
    over = np.zeros((blocks, n), np.uint64)
    out = np.zeros((blocks, n), np.uint64)
    live = np.arange(blocks)
    for p in range(64 * lanes):
        asked = (queries[:, :, p // 64] >> np.uint64(p % 64)) & np.uint64(1)
        carry = plane[:, p, None] ^ (np.uint64(0) - asked)
        for k in range(width):  # carry-save: add the difference bit to all 64 counters at once
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        if p % 16 == 15 and p + 1 < 64 * lanes:
            alive = (over != full).any(axis=1)
            if 2 * alive.sum() < len(alive):
                out[live] = ~over
                live, plane, queries, over = live[alive], plane[alive], queries[alive], over[alive]
                counter = [c[alive] for c in counter]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def least_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (least member) of 0..n-1 under links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == old).all():
            break
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _small(fps: np.ndarray, cell: np.ndarray, radius: int) -> np.ndarray:
    """Roots of members whose cells have at most 64: whole cells share blocks of 64."""
    n = len(cell)
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    size = np.diff(np.concatenate((head, [n])))
    slot, block, used = np.empty(len(head), np.int64), np.empty(len(head), np.int64), 64
    number = -1
    for i, s in enumerate(size.tolist()):
        if used + s > 64:
            number, used = number + 1, 0
        block[i], slot[i] = number, used
        used += s
    of = np.repeat(np.arange(len(head)), size)
    where_b, where_s = block[of], slot[of] + np.arange(n) - head[of]
    first, second = [], []
    for at in range(0, number + 1, 512):
        x = np.flatnonzero((where_b >= at) & (where_b < at + 512))
        m = min(512, number + 1 - at)
        box = np.zeros((m, 64, fps.shape[1]), np.uint64)
        member = np.full((m, 64), -1, np.int64)
        box[where_b[x] - at, where_s[x]] = fps[x]
        member[where_b[x] - at, where_s[x]] = x
        near = within(planes(box), box, radius)
        bits = np.unpackbits(near.view(np.uint8).reshape(m, 64, 8), axis=2, bitorder="little")
        blk, q, j = np.nonzero(bits)
        u, v = member[blk, q], member[blk, j]
        keep = (u >= 0) & (v > u)
        u, v = u[keep], v[keep]
        same = cell[u] == cell[v]
        first.append(u[same]), second.append(v[same])
    return least_roots(n, np.concatenate(first), np.concatenate(second)) if first else np.arange(n)


def _large(fps: np.ndarray, radius: int) -> np.ndarray:
    """Roots of one cell: members that have been reached are compared with those that haven't, only."""
    n = len(fps)
    root, rest, front = np.arange(n), np.arange(1, n), np.array([0])
    seed = 0
    while len(rest):
        if not len(front):
            seed, rest = rest[0], rest[1:]
            front = np.array([seed])
            continue
        pad = -len(rest) % 64
        box = np.concatenate((fps[rest], np.zeros((pad, fps.shape[1]), np.uint64))).reshape(-1, 64, fps.shape[1])
        step = max(1, (1 << 18) // len(box)) if len(front) > 1 else 1
        ask, front = front[:step], front[step:]
        near = within(planes(box), np.broadcast_to(fps[ask], (len(box), *fps[ask].shape)), radius)
        hit = np.bitwise_or.reduce(near, axis=1)
        reached = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").ravel()[: len(rest)].astype(bool)
        root[rest[reached]] = seed
        front, rest = np.concatenate((front, rest[reached])), rest[~reached]
    return root


def link_cells(fps: np.ndarray, cell: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, roots) that connect, per cell, all members within the radius; at most one link per member.

    fps: (n, lanes); cell: a key per member."""
    order = np.argsort(cell, kind="stable")
    c = cell[order]
    head = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((head, [len(c)])))
    many = np.repeat(size, size)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    x = order[(many > 1) & (many <= 64)]
    if len(x):
        root = _small(fps[x], cell[x], radius)
        hit = np.flatnonzero(root != np.arange(len(x)))
        a.append(x[hit]), b.append(x[root[hit]])
    for h, s in zip(head[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        x = order[h : h + s]
        root = _large(fps[x], radius)
        hit = np.flatnonzero(root != np.arange(s))
        a.append(x[hit]), b.append(x[root[hit]])
    return np.concatenate(a), np.concatenate(b)


# ---- exact links of 64-bit fingerprints at radius 2 ------------------------------------------------------------


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b) links between distinct 64-bit fingerprints (fp) that connect all at 2 or fewer differing bits."""
    n = C.parts(distinct.sparkSession)
    band = lambda i: 0xFFFF << (16 * i)
    masks = [band(i) | band(j) for i, j in BANDS]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)])
    spread = distinct.select("fp", F.explode(keys).alias("key"))
    size = spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    cells = spread.join(size, "key")
    radius = 2

    def run(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64).reshape(-1, 1)
        a, b = link_cells(fps, group.column("key").to_numpy(), radius)
        flat = fps[:, 0].view(np.int64)
        return pa.table({"a": flat[a], "b": flat[b]})

    near = cells.where(F.col("size") <= cell).select("fp", "key", F.pmod("key", F.lit(n)).alias("part")).groupBy("part").applyInArrow(run, "a long, b long")
    hot = cells.where(F.col("size") > cell).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    middle = hot.select("fp", F.explode(flips).alias("mid")).groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    far = middle.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return near.unionByName(far).where("a != b")


def groups(docs: DataFrame, words: int = 3, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    fp = settle(fingerprints(docs, words))
    n = fp.count()
    first = settle(fp.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_n")))
    roots = components(links(first.select("fp"), cell))
    named = settle(first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"), "_n"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_roots"))
    of = hub_join(named, least, "root", n, "_roots").select("fp", "component_id", "_n")
    return hub_join(fp, of, "fp", n).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- wide fingerprints and sets of shingles for a similarity threshold -----------------------------------------

LANES = 4
#: Least hashes of a table's key, and tables: texts at 0.8 share a key with probability 1 - (1 - 0.8**3)**10 = 0.9992.
LEAST, TABLES = 3, 10
#: Members of a cell whose open pairs are sent one by one; larger cells are linked in one task, from their sets.
FEW = 6
_ODD = np.random.RandomState(77).randint(0, 1 << 62, LEAST * TABLES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, owners, shingle hashes) of successive texts: each text's distinct word shingles in ascending
    order; a text too short for one has all its words as one, a wordless text has none."""
    for a, z in C.chunks(texts, 1 << 18):
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[a:z]])[:-1]))
        starts, _, h = C.words_of(np.frombuffer(b"\n".join(texts[a:z]), np.uint8), lower=True)
        doc = np.searchsorted(begin, starts, "right") - 1
        n = len(h) - words + 1
        ok = doc[:n] == doc[words - 1 :] if n > 0 else np.zeros(0, bool)
        shingle, owner = [C.window_hash(h, words)[ok] if n > 0 else np.zeros(0, np.uint64)], [doc[:n][ok] if n > 0 else np.zeros(0, np.int64)]
        first = np.searchsorted(doc, np.arange(z - a + 1))
        count = np.diff(first)
        for i in np.flatnonzero((count > 0) & (count < words)).tolist():
            shingle.append(C.window_hash(h[first[i] : first[i + 1]], int(count[i])))
            owner.append(np.array([i]))
        s, o = np.concatenate(shingle), np.concatenate(owner)
        order = np.lexsort((s, o))
        s, o = s[order], o[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1]))) if len(s) else np.zeros(0, bool)
        yield a, o[new], s[new]


def _nodes(head: np.ndarray, total: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    with np.errstate(over="ignore"):
        return C.mix(np.add.reduceat(C.mix(shingle, 5), head) + total.astype(np.uint64), 6)


def _heads(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return head, np.diff(np.concatenate((head, [len(owner)])))


def wide_fingerprints(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: hash of its shingle set, the set's size, SimHash (LANES words) and table keys (TABLES) of the set."""
    n = len(texts)
    node, size, out, keys = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros((n, LANES), np.uint64), np.zeros((n, TABLES), np.uint64)
    for a, owner, shingle in shingle_sets(texts, words):
        if not len(owner):
            continue
        head, total = _heads(owner)
        at = a + owner[head]
        node[at], size[at] = _nodes(head, total, shingle), total
        for lane in range(LANES):
            bits = np.unpackbits(C.mix(shingle, 17 + lane).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, head, axis=0, dtype=np.int32)
            out[at, lane] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
        with np.errstate(over="ignore"):
            for t in range(TABLES):
                key = np.full(len(head), t, np.uint64)
                for j in range(LEAST):
                    key = C.mix(key ^ np.minimum.reduceat(shingle * _ODD[t * LEAST + j], head), j)
                keys[at, t] = key
    return node, size, out, keys


def differing_share(similarity: float) -> float:
    """Share of bits in which SimHashes of sets of this Jaccard similarity differ, at most (equal sizes)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_for(similarity: float) -> int:
    """Five standard deviations above the mean, which small sets need as well; unrelated sets are near half the bits."""
    share, width = differing_share(similarity), 64 * LANES
    return math.ceil(width * share + 5 * math.sqrt(width * share * (1 - share)))


def open_pairs(f: np.ndarray, key: np.ndarray, label: np.ndarray, size: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Members of one cell within the radius whose labels differ and whose set sizes allow the similarity."""
    order = np.argsort(key, kind="stable")
    head, total = _heads(key[order])
    mixed = np.minimum.reduceat(label[order], head) != np.maximum.reduceat(label[order], head)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h, n in zip(head[mixed].tolist(), total[mixed].tolist(), strict=True):
        x = order[h : h + n]
        step = max(1, (1 << 20) // n)
        for i in range(0, n, step):
            u = x[i : i + step]
            low, high = np.minimum(size[u][:, None], size[x]), np.maximum(size[u][:, None], size[x])
            near = (u[:, None] < x) & (label[u][:, None] != label[x]) & (low >= similarity * high - 1e-9)
            p, q = np.nonzero(near)
            ok = np.bitwise_count(f[u[p]] ^ f[x[q]]).sum(axis=1, dtype=np.int64) <= radius
            a.append(u[p[ok]]), b.append(x[q[ok]])
    return np.concatenate(a), np.concatenate(b)


def linked_sets(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(members, parents) that connect all sets of at least this Jaccard similarity; at most one link per member.

    Common shingles are counted by postings, for one reached set against all at once."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    by = np.argsort(term, kind="stable")
    doc, first = np.repeat(np.arange(n), size)[by], np.searchsorted(term[by], np.arange(term.max() + 2))
    end = np.cumsum(size)
    parent, free = np.arange(n), np.ones(n, bool)
    for seed in range(n):
        front = [seed] if free[seed] else []
        free[seed] = False
        while front:
            q = front.pop()
            common = np.bincount(np.concatenate([doc[first[t] : first[t + 1]] for t in term[end[q] - size[q] : end[q]].tolist()]), minlength=n)
            hit = np.flatnonzero(free & (common >= similarity * (size + size[q] - common) - 1e-9))
            parent[hit], free[hit] = q, False
            front += hit.tolist()
    own = np.flatnonzero(parent != np.arange(n))
    return own, parent[own]


def rooted(docs: DataFrame, row: Column, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, row (a long that the caller names rows by), root of every row: rows whose sets of distinct word shingles
    are linked by Jaccard similarities of at least ``similarity`` have the same root.

    Candidates share a table's key (least hashes of the set; recall per pair see TABLES, higher above 0.8) and lie within
    a wide SimHash radius; every link is verified on the sets.  First each candidate is verified against one of its
    cell, which joins most copies; then all candidates that still have different roots are: pair by pair in cells with
    up to FEW of them, in larger ones by one task that gets the sets, so that no pairs are sent for a large group."""
    n = C.parts(docs.sparkSession)
    ddl = "doc_id long, row long, place long, node long, size long, f binary, keys binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("place", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("f", pa.binary()), ("keys", pa.binary())])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.xxhash64(text).alias("place"), text.alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            node, size, f, keys = wide_fingerprints(C.as_bytes(b.column("text")), words)
            yield pa.record_batch([b.column("doc_id"), b.column("row"), b.column("place"), pa.array(node.view(np.int64)), pa.array(size), pa.array([x.tobytes() for x in f], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())], schema=arrow)

    fp = settle(source.mapInArrow(prints, ddl))
    distinct = fp.where("size > 0").groupBy("node").agg(F.first("size").alias("size"), F.first("f").alias("f"), F.first("keys").alias("keys"), F.min("place").alias("place"))
    radius = radius_for(similarity)
    packet = pa.schema([("part", pa.int32()), ("data", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            own = lambda c: np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(len(b), -1)  # noqa: B023, E731
            f, key = own("f"), own("keys").T.ravel()
            node, label, size = (b.column(c).to_numpy() for c in ("node", "label", "size"))
            part, who = C.part_of(key, n), np.tile(np.arange(len(b)), TABLES)
            order = np.argsort(part, kind="stable")
            sent = [(p, C.pack(key[order[x]], *[c[who[order[x]]] for c in (node, label, size)], f[who[order[x]]].ravel())) for p, x in C.deal(part[order], n)]
            yield from C.rows(packet, [p for p, _ in sent], [z for _, z in sent]).to_batches()

    def link(all_pairs: bool) -> Callable[[pa.Table], pa.Table]:
        def run(group: pa.Table) -> pa.Table:
            data = [C.unpack(x) for x in group.column("data").to_pylist()]
            key, node, label, size, f = (np.concatenate([d[i] for d in data]) for i in range(5))
            order = np.argsort(node, kind="stable")  # a cell's least node is compared first, in every table
            key, node, label, size, f = key[order], node[order], label[order], size[order], f.reshape(-1, LANES)[order]
            if not all_pairs:
                a, b = link_cells(f, key, radius)
                return pa.table({"cell": np.zeros(len(a), np.int64), "a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})
            a, b = open_pairs(f, key, label, size, radius, similarity)
            cell, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            order = np.argsort(key[a], kind="stable")
            few = np.ones(len(a), bool)
            for x in np.split(order, np.flatnonzero(np.diff(key[a][order].view(np.int64))) + 1):
                own = np.unique(np.concatenate((node[a[x]], node[b[x]])))
                if len(own) > FEW:
                    few[x] = False
                    name = xxhash.xxh64_intdigest(own.tobytes()) >> 1 | 1  # cells of equal members are one
                    cell.append(np.full(len(own), name, np.int64)), many.append(own)
            a, b, own = node[a[few]], node[b[few]], np.concatenate(many)
            return pa.table({"cell": np.concatenate((np.zeros(len(a), np.int64), *cell)), "a": np.concatenate((a, own)), "b": np.concatenate((b, own))})

        return run

    def candidates(nodes: DataFrame, all_pairs: bool) -> DataFrame:
        return settle(nodes.select("node", "label", "size", "f", "keys").mapInArrow(send, "part int, data binary").groupBy("part").applyInArrow(link(all_pairs), "cell long, a long, b long").distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches):
            for _, owner, shingle in shingle_sets(C.as_bytes(b.column("text")), words):
                if len(owner):
                    head, total = _heads(owner)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(owner)), pa.int32()), pa.array(shingle.view(np.int64)))
                    yield pa.record_batch([pa.array(_nodes(head, total, shingle).view(np.int64)), lists], names=["node", "shingles"])

    first = candidates(distinct.withColumn("label", F.col("node")), False)
    touched = first.select(F.col("a").alias("node")).unionByName(first.select(F.col("b").alias("node"))).distinct()
    near = settle(distinct.join(touched, "node"))
    wanted = source.select("place", "text").join(near.select("place").distinct(), "place", "left_semi").dropDuplicates(["place"])
    of = settle(wanted.select("text").mapInArrow(sets, "node long, shingles array<long>").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(of.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b")

    sure = settle(verified(first))
    roots = components(sure)
    labelled = near.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
    rest = candidates(labelled, True)

    def within_cell(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        order = np.argsort(node)
        lists = group.column("shingles").to_pylist()
        a, b = linked_sets([np.array(lists[i], np.int64) for i in order.tolist()], similarity)
        return pa.table({"a": node[order[a]], "b": node[order[b]]})

    pairs = rest.where("cell = 0").select("a", "b").join(first.select("a", "b"), ["a", "b"], "left_anti")
    crowd = rest.where("cell != 0").select("cell", F.col("a").alias("node")).join(of, "node").groupBy("cell").applyInArrow(within_cell, "a long, b long")
    roots = components(sure.unionByName(verified(pairs)).unionByName(crowd))
    sized = fp.groupBy("node").agg(F.count("*").alias("_n")).join(roots, "node", "left")
    joined = hub_join(fp.select("doc_id", "row", "node"), sized, "node", fp.count(), how="left")
    return joined.select("doc_id", "row", F.coalesce("root", "node").alias("root"))


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id: documents grouped by links of at least this Jaccard similarity of their sets of distinct word
    shingles (see ``rooted``); the group's smallest doc_id names it.  Wordless texts are equal."""
    rows = settle(rooted(docs, F.lit(0).cast("long"), words, similarity))
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_n"))
    return hub_join(rows, least, "root", rows.count()).select("doc_id", "component_id")
