"""The meta-codec: arrays through a lossy codec and back, with a correction beside the payload that restores the guards.

A value is framed as ULEB128(bytes of the correction), the inner codec's payload, the packed correction; an array that the
inner codec keeps within its guards costs one byte more.  ``encode`` and ``decode`` work on single arrays,
``encode_arrays`` and ``decode_arrays`` on tables that hold many: one task per array, or per chunk of an array.

Codecs are named in a registry (``register``, ``get``), so a configuration can be read back.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tolera.api import Guards
from tolera.functions import kinds
from tolera.operators import tiles
from tolera.operators.correct import added, difference, numbers
from tolera.operators.guards import GuardError
from tolera.sources.bindings import from_json, to_json


class Codec(Protocol):
    name: str

    def encode(self, x: np.ndarray) -> bytes: ...

    def decode(self, data: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray: ...

    def config(self) -> dict: ...


_CODECS: dict[str, Callable[..., Any]] = {}


def register(cls: type) -> type:
    """Makes a codec known by its ``name``; use as a decorator."""
    _CODECS[cls.name] = cls
    return cls


def get(config: Mapping[str, Any]) -> Any:
    """A codec from its configuration: its name as ``id``, and parameters."""
    given = dict(from_json(dict(config)))
    name = given.pop("id", None)
    if name not in _CODECS:
        raise GuardError(f"id: unknown codec {name!r}")
    cls = _CODECS[name]
    return cls.from_config(given) if hasattr(cls, "from_config") else cls(**given)


@register
class Zero:
    """Predicts zero: the correction alone is the compressed array."""

    name = "zero"

    def encode(self, x: np.ndarray) -> bytes:
        return b""

    def decode(self, data: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
        return np.zeros(shape, kind)

    def config(self) -> dict:
        return {"id": self.name}


@register
class Rounded:
    """Keeps multiples of ``step``, as varint-free 64-bit integers under the lossless stage."""

    name = "rounded"

    def __init__(self, step: float):
        if not step > 0:
            raise GuardError("rounded.step: must be positive")
        self.step = step

    def encode(self, x: np.ndarray) -> bytes:
        with np.errstate(all="ignore"):
            n = np.rint(np.nan_to_num(kinds.wide(x).astype(np.float64) / self.step, nan=0, posinf=2.0**62, neginf=-(2.0**62)))
        return pack(np.clip(n, -(2.0**62), 2.0**62).astype(np.int64))

    def decode(self, data: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
        return kinds.from_wide(unpack(data, "int64").astype(np.float64) * self.step, kind).reshape(shape)

    def config(self) -> dict:
        return {"id": self.name, "step": self.step}


@register
class Narrow:
    """Keeps the values as floats of a smaller type."""

    name = "narrow"

    def __init__(self, dtype: str = "float32"):
        self.dtype = dtype

    def encode(self, x: np.ndarray) -> bytes:
        with np.errstate(all="ignore"):
            return pack(kinds.as_bits(np.ascontiguousarray(x).astype(self.dtype)).ravel())

    def decode(self, data: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
        bits = unpack(data, f"int{8 * np.dtype(self.dtype).itemsize}")
        with np.errstate(all="ignore"):
            back = bits.view(self.dtype)
            return (back.astype(kind) if np.dtype(kind).kind == "f" else kinds.from_wide(back.astype(np.float64), kind)).reshape(shape)

    def config(self) -> dict:
        return {"id": self.name, "dtype": self.dtype}


# ---- lossless stage -------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Integers without loss: the smaller of the values and their differences, bytes of equal weight together, under zstd."""
    x = np.ascontiguousarray(x).ravel()
    with np.errstate(over="ignore"):
        forms = [x, np.diff(x, prepend=x.dtype.type(0))]
    planes = [np.ascontiguousarray(f.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for f in forms]
    out = [bytes([i]) + struct.pack("<Q", len(x)) + pa.compress(p, codec="zstd", asbytes=True) for i, p in enumerate(planes)]
    return min(out, key=len)


def unpack(data: bytes, kind: str) -> np.ndarray:
    how, (n,) = data[0], struct.unpack("<Q", data[1:9])
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data[9:], decompressed_size=n * size, codec="zstd", asbytes=True) if n else b""
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()
    with np.errstate(over="ignore"):
        return np.cumsum(x, dtype=x.dtype) if how else x


def uleb128(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | (128 if n else 0))
        if not n:
            return bytes(out)


def read_uleb128(data: bytes) -> tuple[int, int]:
    """(number, bytes read)."""
    n = 0
    for i, b in enumerate(data):
        n |= (b & 127) << (7 * i)
        if b < 128:
            return n, i + 1
    raise ValueError("the frame is cut off")


# ---- the meta-codec ---------------------------------------------------------------------------------------------


@register
class Guarded:
    """A codec under guards; ``constants`` binds late-bound names to numbers or arrays of the data's shape."""

    name = "guarded"

    def __init__(self, codec: Any, guards: Guards, constants: Mapping[str, Any] | None = None):
        if isinstance(codec, Guarded):
            raise GuardError("codec: a guarded codec can't be guarded again; give it more guards")
        self.codec, self.guards, self.constants = codec, guards, dict(constants or {})
        if unknown := set(self.constants) - guards.late_bound():
            raise GuardError(f"constants: not asked for {sorted(unknown)}")

    def update_constants(self, **constants: Any) -> Guarded:
        """The same codec with other values of some constants."""
        return Guarded(self.codec, self.guards, {**self.constants, **constants})

    def map(self, change: Callable[[Any], Any]) -> Guarded:
        """The same guards around another codec."""
        return Guarded(change(self.codec), self.guards, self.constants)

    def config(self) -> dict:
        return to_json({"id": self.name, "codec": self.codec.config(), "guards": self.guards.get_config(), "constants": self.constants})

    @classmethod
    def from_config(cls, c: Mapping[str, Any]) -> Guarded:
        return cls(get(c["codec"]), Guards.from_config(c["guards"]), c.get("constants"))

    def encode(self, x: np.ndarray) -> bytes:
        payload = self.codec.encode(x)
        p = self.codec.decode(payload, x.dtype.name, x.shape)
        correction = self.guards.correct_array(x, p, self.constants)
        packed = pack(correction) if correction.any() else b""
        return uleb128(len(packed)) + payload + packed

    def encode_chunk(self, area: tiles.Area) -> bytes:
        """A chunk with its halo (``x``, and the array's range if asked for).  Others' predictions aren't known here, so each
        element takes a safe value: then all windows pass, those that cross chunks too."""
        area.values |= {k: area.cut(np.broadcast_to(np.asarray(v, np.float64), area.shape)) for k, v in self.constants.items()}
        if missing := self.guards.late_bound() - set(area.values):
            raise GuardError(f"late_bound: missing {sorted(missing)}")
        x = np.ascontiguousarray(area.values["x"][area.inner()])
        payload = self.codec.encode(x)
        p = np.ascontiguousarray(self.codec.decode(payload, x.dtype.name, x.shape))
        area.values["p"] = np.zeros(area.size, x.dtype)
        area.values["p"][area.inner()] = p
        correction = difference(np.ascontiguousarray(area.corrected(self.guards.root)), p)
        packed = pack(correction) if correction.any() else b""
        return uleb128(len(packed)) + payload + packed

    def decode(self, data: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
        size, at = read_uleb128(data)
        end = len(data) - size
        if end < at:
            raise ValueError("the frame is cut off")
        p = np.ascontiguousarray(self.codec.decode(data[at:end], kind, shape))
        return added(p, unpack(data[end:], f"int{8 * p.itemsize}").reshape(shape)) if size else p


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def encode_arrays(df: DataFrame, codec: Guarded, by: Sequence[str], index: Sequence[str], x: str = "x", sides: Sequence[int] | None = None) -> DataFrame:
    """by, shape, kind, data: one row per array, each encoded by one task, which it has to fit.

    sides: lengths of chunks along each axis.  Then there is a row per chunk, with its ``first`` place on each axis, and a task
    holds a chunk and its halo, whatever the array's size; windows that cross chunks keep their guards as well."""
    kind, config = kinds.kind_of(df.schema[x]), codec.config()
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([*df.select(*by).schema.fields, *([T.StructField("first", longs)] if sides else []), T.StructField("shape", longs), T.StructField("kind", T.StringType()), T.StructField("data", T.BinaryType())])

    def row(table: pa.Table, **more: Any) -> pa.Table:
        out = table.select(list(by)).slice(0, 1)
        types = {"first": pa.list_(pa.int64()), "shape": pa.list_(pa.int64()), "kind": pa.string(), "data": pa.binary()}
        for name, value in more.items():
            out = out.append_column(name, pa.array([value], types[name]))
        return out

    def run(table: pa.Table) -> pa.Table:
        at = [table.column(c).to_numpy() for c in index]
        shape = tuple(int(a.max()) + 1 for a in at)
        if int(np.prod(shape)) != len(table):
            raise ValueError("elements are missing or repeated")
        data = np.empty(shape, kind)
        data[tuple(at)] = numbers(table.column(x), kind, x)
        return row(table, shape=list(shape), kind=kind, data=get(config).encode(data))

    if not sides:
        return df.select(*by, *index, x).groupBy(*by).applyInArrow(run, schema)
    root = codec.guards.root
    if places := sorted(n for n in codec.guards.builtin_late_bound() if n.startswith("$d_")):
        raise GuardError(f"late_bound: arrays have no coordinates ({places})")
    side = tiles.sides_for(len(index), tiles.reaches(root, len(index)), sides, tiles.TILE)
    rows, read = df.select(*by, *index, x), {"x": x}
    if codec.guards.builtin_late_bound() & {"$x_min", "$x_max"}:
        plain = F.when(~F.isnan(x), F.col(x)) if np.dtype(kind).kind == "f" else F.col(x)
        ends = {"$x_min": F.min(plain), "$x_max": F.max(plain)}
        found = rows.groupBy(*by).agg(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{k[1:]}") for k, c in ends.items()])
        rows, read = rows.join(F.broadcast(found), list(by)) if by else rows.crossJoin(F.broadcast(found)), read | {k: f"_{k[1:]}" for k in ends}

    def chunk(table: pa.Table) -> pa.Table:
        area, _ = tiles.area_of(table, root, side, read, kind)
        return row(table, first=list(area.first), shape=list(area.core), kind=kind, data=get(config).encode_chunk(area))

    return tiles.deal(tiles.with_shape(rows, index, None, by), root, index, side).groupBy(*by, "_tile").applyInArrow(chunk, schema)


def decode_arrays(df: DataFrame, codec: Guarded, by: Sequence[str], kind: str, index: Sequence[str], x: str = "x_hat") -> DataFrame:
    """by, index, x of the arrays (or their chunks) of ``encode_arrays`` (all of one kind)."""
    from pyspark.sql import types as T

    from tolera.operators.correct import as_arrow

    config = codec.config()
    first = ["first"] if "first" in df.columns and "first" not in by else []
    schema = T.StructType([*df.select(*by).schema.fields, *[T.StructField(c, T.LongType()) for c in index], T.StructField(x, kinds.STORAGE[kind])])

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for i in range(len(b)):
                shape, own = tuple(b.column("shape")[i].as_py()), b.column("kind")[i].as_py()
                if own != kind:
                    raise kinds.KindError(f"an array of {own}, not {kind}")
                data = get(config).decode(b.column("data")[i].as_py(), kind, shape)
                places = np.indices(shape).reshape(len(shape), -1).astype(np.int64)
                if first:
                    places += np.array(b.column("first")[i].as_py(), np.int64)[:, None]
                rows = pa.array(np.full(data.size, i, np.int64))
                yield pa.record_batch([*[b.column(c).take(rows) for c in by], *[pa.array(p) for p in places], as_arrow(data.ravel(), kind)], names=[*by, *index, x])

    return df.select(*by, *first, "shape", "kind", "data").mapInArrow(run, schema).withMetadata(x, kinds.field_for(x, kind).metadata)
