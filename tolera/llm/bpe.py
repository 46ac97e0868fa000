"""Byte-level BPE: a global distinct-word shuffle, and decoding by the token-byte table.

Texts are cut into pre-tokens with their positions; each *distinct* pre-token of the corpus is encoded once, in
the part that its hash names; ids are joined back and texts reassembled by position.  A chunk of documents
sends its distinct words once (packed), keeps positions as numbers into that list, and gets ids in the same
order, so a very common word costs one entry per chunk.

Texts are cut once: one exchange carries the words of chunks to parts and the texts to their chunks' numbers, so both
sides of the reassembly come from the same evaluation, however partitions are coalesced.  Rows are sorted within
their partition before they are cut into chunks, so a retried task makes the same ones again.

Defined results: a null text is empty and has no tokens; null and repeated ids are carried through, one result
row per input row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tolera.llm import common as C
from tolera.llm.graph import settle

#: Bytes of text in a chunk.
TEXT = 24 << 20


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; a path is taken as it is."""
    import os

    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a rank file or from a tokenizer description with a byte-level vocabulary."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model.get("added_tokens", ())}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        return {bytes(letter[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[bytes], list[int]]:
    """Ids of one pre-token."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("given", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})._encode_single_piece


@functools.lru_cache(maxsize=1)
def splitter() -> Callable[[str], list[str]]:
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


@functools.lru_cache(maxsize=4)
def added(path: str) -> tuple[re.Pattern[str] | None, dict[str, int]]:
    """A pattern of the description's added tokens, the longest first, and their ids."""
    if not path.endswith(".json"):
        return None, {}
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", ())
    if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take white space or whole words only are not supported")
    ids = {t["content"]: t["id"] for t in tokens}
    return (re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True)))) if ids else None), ids


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: t for t, i in ranks(path).items()}


def decode(ids: np.ndarray, path: str) -> bytes:
    table = token_bytes(path)
    return b"".join([table[i] for i in ids.tolist()])


class _Chunk:
    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, i: int | None, text: str) -> None:
        number, pieces = self.number, splitter()(text)
        self.tokens.append(np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.uint32, len(pieces)))
        self.ids.append(i)
        self.size += len(text)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Chunk]]:
    """(number, chunk): 2**20 chunks to a partition."""
    at = TaskContext.get().partitionId() << 20
    now = _Chunk()
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if now.ids and now.size >= TEXT:
                yield at, now
                at, now = at + 1, _Chunk()
            now.add(i, t or "")
    if now.ids:
        yield at, now


def _dealt(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of words by part and hash, and the parts in that order."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    order = np.argsort(h, kind="stable")
    return order, C.part_of(h[order], n)


#: key: what a packet is dealt by: -1 - part for the words of a chunk, the chunk's number for its texts and its ids.
PACKET = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])
PACKET_DDL = "key long, chunk long, part int, data binary"


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of 32-bit numbers, those of equal weight together."""
    return x.view(np.uint8).reshape(-1, 4).T.ravel() if len(x) else np.zeros(0, np.uint8)


def _numbers(planes: np.ndarray) -> np.ndarray:
    return planes.reshape(4, -1).T.copy().view(np.uint32).ravel() if len(planes) else np.zeros(0, np.uint32)


def _send(n: int) -> Callable:
    """One pass over the texts sends both: each chunk's distinct words by part, and its texts as numbers of words, common
    words first, with the place of each number in the words as they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, c in _chunked(batches):
            words = [w.encode() for w in c.number]
            order, part = _dealt(words, n)
            for p, x in C.deal(part, n):
                own = [words[i] for i in order[x]]
                data = C.pack(np.fromiter(map(len, own), np.uint32, len(own)), np.frombuffer(b"".join(own), np.uint8))
                yield from C.rows(PACKET, [-1 - p], [chunk], [p], [data]).to_batches()
            flat = np.concatenate(c.tokens) if c.tokens else np.zeros(0, np.uint32)
            common = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
            number, place = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
            number[common] = np.arange(len(words), dtype=np.uint32)
            place[number[order]] = np.arange(len(words), dtype=np.uint32)
            ids = np.array([i or 0 for i in c.ids], np.int64)
            data = C.pack(ids, np.array([i is None for i in c.ids], np.uint8), np.fromiter(map(len, c.tokens), np.int64, len(c.tokens)), _planes(number[flat]), _planes(place))
            yield from C.rows(PACKET, [chunk], [chunk], [-1], [data]).to_batches()

    return run


def _encode_part(path: str) -> Callable[[pa.Table], pa.Table]:
    """Ids of a part's words, each distinct one encoded once, to the chunks that hold them."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("key")[0].as_py() >= 0:  # the texts of a chunk: the last step's
            return PACKET.empty_table()
        encode, known, out = encoder(path), {}, []
        for data in group.column("data").to_pylist():
            size, text = C.unpack(data)
            raw, end = text.tobytes(), np.cumsum(size).tolist()
            found = []
            for a, z in zip([0, *end[:-1]], end, strict=True):
                w = raw[a:z]
                got = known.get(w)
                if got is None:
                    known[w] = got = encode(w)
                found.append(got)
            flat = np.fromiter((i for f in found for i in f), np.uint32)
            out.append(C.pack(np.fromiter(map(len, found), np.uint32, len(found)), flat))
        return pa.table({"key": group.column("chunk"), "chunk": group.column("chunk"), "part": group.column("part"), "data": pa.array(out, pa.binary())})

    return run


FULL = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _reassemble(path: str, full: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(sent: pa.Table, coded: pa.Table) -> pa.Table:
        if not len(sent) or sent.column("key")[0].as_py() < 0:
            return (FULL if full else CODED).empty_table()
        doc, null, count, planes, place = C.unpack(sent.column("data")[0].as_py())
        number = _numbers(place)[_numbers(planes)]
        by = dict(zip(coded.column("part").to_pylist(), coded.column("data").to_pylist(), strict=True))
        table, ids, plain = token_bytes(path), [], []
        for p in sorted(by):
            size, flat = C.unpack(by[p])
            end = np.cumsum(size).tolist()
            raw, listed = flat.tobytes(), flat.tolist()
            for a, z in zip([0, *end[:-1]], end, strict=True):
                ids.append(raw[4 * a : 4 * z])
                plain.append(table[listed[a]] if z == a + 1 else b"".join([table[t] for t in listed[a:z]]))
        at, out = 0, []
        for d, missing, c in zip(doc.tolist(), null.tolist(), count.tolist(), strict=True):
            own = number[at : at + c].tolist()
            at += c
            raw, text = b"".join([ids[i] for i in own]), b"".join([plain[i] for i in own])
            first = None if missing else d
            if full:
                out.append((first, np.frombuffer(raw, np.int32), text.decode()))
            else:
                out.append((first, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text).hexdigest()))
        if full:
            return C.rows(FULL, *zip(*out, strict=True))
        return C.rows(CODED, *zip(*out, strict=True))

    return run


def _coded(docs: DataFrame, vocab: str, full: bool) -> DataFrame:
    n, path = C.parts(docs.sparkSession), vocabulary(vocab)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # In this order a repeated task cuts a partition into the same chunks, whatever order its rows arrive in.
    sent = docs.sortWithinPartitions(F.xxhash64("text", "doc_id"), "doc_id", "text").mapInArrow(_send(n), PACKET_DDL)
    encoded = sent.groupBy("key").applyInArrow(_encode_part(path), PACKET_DDL)
    ddl = "doc_id long, ids array<int>, decoded string" if full else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return sent.groupBy("key").cogroup(encoded.groupBy("key")).applyInArrow(_reassemble(path, full), ddl)


def decode_table(coded: DataFrame, vocab: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, decoded (bytes) of rows of (doc_id, ids), by a join with the token-byte table.

    The table has a row per token of the vocabulary, so broadcasting it is bounded by the vocabulary.  Rows are decoded
    one by one, by position; null and repeated ids of documents are carried through, an empty list has no bytes, and an
    id outside the vocabulary is an error."""
    table = coded.sparkSession.createDataFrame(sorted((i, t) for i, t in token_bytes(vocabulary(vocab)).items()), "token int, bytes binary")
    named = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"), F.expr("uuid()").alias("row"))
    named = settle(named)
    spread = named.select("row", F.posexplode("ids").alias("at", "token")).join(F.broadcast(table), "token", "left")
    known = F.when(F.col("bytes").isNull(), F.raise_error(F.lit("an id is outside the vocabulary")).cast("binary")).otherwise(F.col("bytes"))
    pieces = spread.select("row", F.struct("at", F.hex(known).alias("bytes")).alias("piece")).groupBy("row").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    text = F.unhex(F.array_join(F.col("pieces.bytes"), ""))
    return named.join(pieces, "row", "left").select("doc_id", F.coalesce(text, F.lit(b"")).alias("decoded"))


def encode(docs: DataFrame, vocab: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ids, decoded (the text that the ids decode to)."""
    return _coded(docs, vocab, True)


def digest(docs: DataFrame, vocab: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return _coded(docs, vocab, False)
