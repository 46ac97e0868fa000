"""What the corpus operators share: table access, byte-level tokenising in numpy, packed shuffles.

Texts are handled as UTF-8 bytes in batches of bounded size.  Words are runs of bytes other than
ASCII white space (0x20, 0x09-0x0D), so nothing depends on the locale or on Unicode tables.

*Packed shuffle*: instead of one row per token, a map task sends one binary value per (source bucket,
target part) holding a sorted array of 64-bit keys.  This keeps a corpus-wide exchange at a few bytes a
token, and equal keys of one bucket travel once, so that a hot key costs a part one entry per bucket.  Values never
outnumber the keys they hold, so at worst the exchange is one of single keys.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbols (bytes or words) that are worked on at once.
CHUNK = 1 << 21
#: Bytes of text in a bucket, at most (but for a single longer text).
BUCKET = 64 << 20

_RNG = np.random.RandomState(20240229)
#: A random 64-bit value per byte and the odd base of the polynomial hash, fixed for all time.
BYTE_CODE = np.frombuffer(_RNG.bytes(256 * 8), np.uint64).copy()
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """How many parts an exchange is dealt into: the session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done < size:  # out[done:2*done] = out[:done] * base**done
                m = min(done, size - done)
                out[done : done + m] = out[:m] * np.uint64(step)
                done, step = done + m, (step * step) & ((1 << 64) - 1)
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different salts give unrelated values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The part of each mixed key: its high 32 bits scaled to 0..n-1."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def window_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` 64-bit values (len - width + 1 of them)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(n, BASE), out=total[1:])
        return mix((total[width:] - total[: n - width + 1]) * powers(n - width + 1, BASE_INV))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every run of ``width`` values."""
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return m


def words_of(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes) of the words in a byte array."""
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    code = BYTE_CODE[LOWER] if lower else BYTE_CODE
    with np.errstate(over="ignore"):
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(code[buf] * powers(len(buf), BASE), out=total[1:])
        h = (total[ends] - total[starts]) * powers(len(buf) + 1, BASE_INV)[starts]
        return starts, ends, mix(h + (ends - starts).astype(np.uint64))


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of texts that together hold about ``limit`` bytes; a longer text stands alone."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a slice's texts hold about ``limit`` bytes: copies of a batch's texts cost memory."""
    for b in batches:
        texts = b.column(column).cast(pa.large_binary())
        size = np.concatenate(([0], np.cumsum(np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))))
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed value."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        if raw.dtype == np.uint64 and len(raw) > 8:
            raw = raw.view(np.uint8).reshape(-1, 8).T  # bytes of equal weight together compress better
        data = raw.tobytes()
        z = pa.compress(data, codec="zstd", asbytes=True)
        out.append(struct.pack("<2sIII", a.dtype.str[1:].encode(), len(a), len(data), len(z)) + z)
    return b"".join(out)


def unpack(value: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(value):
        kind, n, size, z = struct.unpack_from("<2sIII", value, at)
        at += 14
        data = pa.decompress(value[at : at + z], decompressed_size=size, codec="zstd", asbytes=True)
        at += z
        dtype = np.dtype("<" + kind.decode())
        if dtype == np.uint64 and n > 8:
            out.append(np.frombuffer(data, np.uint8).reshape(8, n).T.copy().view(np.uint64).ravel())
        else:
            out.append(np.frombuffer(data, dtype))
    return out


def deal(target: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """(part, slice) for targets in ascending order."""
    at = np.searchsorted(target, np.arange(n + 1))
    for p in range(n):
        if at[p] < at[p + 1]:
            yield p, slice(int(at[p]), int(at[p + 1]))


def deal_some(target: np.ndarray) -> Iterator[tuple[int, slice]]:
    """As ``deal`` for few targets of many."""
    if not len(target):
        return
    head = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
    for a, z in zip(head.tolist(), [*head[1:].tolist(), len(target)], strict=True):
        yield int(target[a]), slice(a, z)


def rows(schema: pa.Schema, *columns: Iterable) -> pa.Table:
    return pa.table([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def buckets(docs: DataFrame) -> int:
    """How many buckets texts are dealt into: at least the shuffle partitions, and more where a bucket would hold more than
    ``BUCKET`` bytes, so that the memory of a task doesn't grow with the input (one extra scan sums the lengths)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")), F.lit(0)).alias("n")).first()["n"]
    return max(parts(docs.sparkSession), -(-int(total) // BUCKET))


def bucketed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text and a bucket by the hash of both, so that rows of a repeated (or null) id are spread."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(n)).cast("int").alias("bucket"))


def in_order(group: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts of a bucket in an order that doesn't depend on how its rows arrived."""
    ids, texts = group.column("doc_id").to_pylist(), as_bytes(group.column("text"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order]
