"""NetCDF classic files (CDF-1 and CDF-2): a reader as a Spark data source, and a small writer.

``spark.read.format("netcdf3").option("variable", name).load(paths)`` gives one
row per value: the coordinates of its dimensions and the value, with attributes
as column metadata. A partition is a run of a variable's first dimension, read
with one seek. Files lie on a path that executors can open.
"""

from __future__ import annotations

import glob
import math
import os
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Type numbers of the format, with their layout and size.
TYPES = {1: (">i1", 1), 2: ("S1", 1), 3: (">i2", 2), 4: (">i4", 4), 5: (">f4", 4), 6: (">f8", 8)}
_NUMBER = {np.dtype("i1"): 1, np.dtype("S1"): 2, np.dtype("i2"): 3, np.dtype("i4"): 4, np.dtype("f4"): 5, np.dtype("f8"): 6}
_UNITS = {"s": 1, "sec": 1, "second": 1, "seconds": 1, "minutes": 60, "minute": 60, "min": 60, "hours": 3600, "hour": 3600, "h": 3600, "days": 86_400, "day": 86_400, "d": 86_400}
ROWS = 1_000_000


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    attrs: dict
    kind: int
    begin: int
    record: bool


@dataclass(frozen=True)
class Header:
    sizes: dict[str, int]
    attrs: dict
    variables: dict[str, Variable]
    record_size: int


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def int(self) -> int:
        return struct.unpack(">i", self.take(4))[0]

    def name(self) -> str:
        n = self.int()
        text = self.take(n).decode()
        self.take(-n % 4)
        return text

    def attrs(self) -> dict:
        tag, n = self.int(), self.int()
        out = {}
        for _ in range(n if tag else 0):
            name, kind, count = self.name(), self.int(), self.int()
            layout, size = TYPES[kind]
            raw = self.take(count * size)
            self.take(-(count * size) % 4)
            if kind == 2:
                out[name] = raw.decode(errors="replace").rstrip("\0")
            else:
                v = np.frombuffer(raw, layout)
                out[name] = v[0].item() if count == 1 else v.tolist()
        return out


def header(path: str) -> Header:
    """The header of a file, from as much of its beginning as it takes."""
    size, n = os.path.getsize(path), 1 << 16
    while True:
        with open(path, "rb") as f:
            data = f.read(n)
        try:
            return _header(_Cursor(data), path, size)
        except EOFError:
            if n >= size:
                raise ValueError(f"{path} is cut off") from None
            n *= 4


def _header(c: _Cursor, path: str, file_size: int) -> Header:
    magic = c.take(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError(f"{path} is no NetCDF classic file")
    records = c.int()
    tag, n = c.int(), c.int()
    dims = [(c.name(), c.int()) for _ in range(n if tag else 0)]
    attrs = c.attrs()
    tag, n = c.int(), c.int()
    found, record_size = [], 0
    for _ in range(n if tag else 0):
        name = c.name()
        ids = [c.int() for _ in range(c.int())]
        own = c.attrs()
        kind, vsize = c.int(), c.int()
        begin = c.int() if magic[3] == 1 else struct.unpack(">q", c.take(8))[0]
        record = bool(ids) and dims[ids[0]][1] == 0
        record_size += vsize if record else 0
        found.append(Variable(name, tuple(dims[i][0] for i in ids), own, kind, begin, record))
    of_record = [v for v in found if v.record]
    if len(of_record) == 1:  # a single record variable isn't padded
        v = of_record[0]
        record_size = TYPES[v.kind][1] * math.prod(dict(dims)[d] for d in v.dims[1:])
    if records < 0 and of_record:
        records = (file_size - min(v.begin for v in of_record)) // record_size
    return Header({d: (s or max(records, 0)) for d, s in dims}, attrs, {v.name: v for v in found}, record_size)


def values(path: str, h: Header, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
    """A run of a variable's first dimension."""
    v = h.variables[name]
    layout, size = TYPES[v.kind]
    shape = [h.sizes[d] for d in v.dims]
    if not shape:
        last, inner = 1, 1
    else:
        last, inner = shape[0] if last is None else last, math.prod(shape[1:])
    with open(path, "rb") as f:
        if v.record:
            out = np.empty((last - first, inner), layout)
            for k in range(first, last):
                f.seek(v.begin + k * h.record_size)
                out[k - first] = np.frombuffer(f.read(inner * size), layout)
        else:
            f.seek(v.begin + first * inner * size)
            out = np.frombuffer(f.read((last - first) * inner * size), layout)
    return out.reshape([last - first, *shape[1:]] if shape else [])


def unpack(raw: np.ndarray, attrs: Mapping) -> np.ndarray:
    """Values as double, missing ones as NaN, by the attributes for fill values, scale and offset."""
    x = raw.astype(float)
    for key in ("_FillValue", "missing_value"):
        if key in attrs:
            x[raw == np.asarray(attrs[key]).astype(raw.dtype)] = np.nan
    return x * attrs.get("scale_factor", 1.0) + attrs.get("add_offset", 0.0)


def times(raw: np.ndarray, units: str) -> np.ndarray:
    """Timestamps of numbers ``<unit> since <time>``."""
    unit, _, since = units.partition(" since ")
    start = np.datetime64(since.strip().replace(" ", "T").removesuffix("Z").rstrip(), "us")
    return start + np.round(raw.astype(float) * _UNITS[unit.strip().lower()] * 1e6).astype("timedelta64[us]")


@dataclass
class _Part(InputPartition):
    path: str
    first: int
    last: int


def _paths(options: Mapping[str, str]) -> list[str]:
    import json

    given = json.loads(options["paths"]) if "paths" in options else [options["path"]]
    out = []
    for p in given:
        p = p.removeprefix("file://")
        out += sorted(glob.glob(os.path.join(p, "*.nc") if os.path.isdir(p) else p)) or [p]
    return out


class NetCDF3(DataSource):
    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> T.StructType:
        path = _paths(self.options)[0]
        h = header(path)
        v = h.variables[self.options.get("variable") or _main(h)]
        fields = []
        for d in v.dims:
            own = h.variables.get(d)
            time = own is not None and " since " in str(own.attrs.get("units", ""))
            kind = T.TimestampNTZType() if time else T.DoubleType() if own is not None else T.LongType()
            fields.append(T.StructField(d, kind, True, {k: x for k, x in own.attrs.items() if isinstance(x, str)} if own else {}))
        meta = {k: x for k, x in v.attrs.items() if isinstance(x, str | int | float)}
        return T.StructType([*fields, T.StructField(v.name, T.DoubleType(), True, meta)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def _main(h: Header) -> str:
    """The variable of most dimensions that isn't a coordinate."""
    named = [v for v in h.variables.values() if v.name not in h.sizes]
    if not named:
        raise ValueError("no variable but coordinates")
    return max(named, key=lambda v: len(v.dims)).name


class _Reader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: T.StructType):
        self.options, self.fields = dict(options), schema.fieldNames()

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _paths(self.options):
            h = header(path)
            v = h.variables[self.fields[-1]]
            n = h.sizes[v.dims[0]] if v.dims else 1
            step = max(1, ROWS // max(1, math.prod(h.sizes[d] for d in v.dims[1:])))
            out += [_Part(path, k, min(k + step, n)) for k in range(0, n, step)]
        return out

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        h = header(part.path)
        v = h.variables[self.fields[-1]]
        x = unpack(values(part.path, h, v.name, part.first, part.last), v.attrs)
        cols = []
        for k, d in enumerate(v.dims):
            own = h.variables.get(d)
            lo, hi = (part.first, part.last) if k == 0 else (0, h.sizes[d])
            if own is None:
                c = np.arange(lo, hi)
            else:
                raw = values(part.path, h, d, lo, hi)
                units = str(own.attrs.get("units", ""))
                c = times(raw, units) if " since " in units else raw.astype(float)
            shape = [1] * len(v.dims)
            shape[k] = len(c)
            cols.append(pa.array(np.broadcast_to(c.reshape(shape), x.shape).ravel()))
        flat = x.ravel()
        yield pa.RecordBatch.from_arrays([*cols, pa.array(flat, mask=np.isnan(flat))], names=self.fields)


def scan(spark: SparkSession, paths: str | list[str], variable: str | None = None):
    """All files as one frame; files of one variable follow each other along its first dimension."""
    import json

    spark.dataSource.register(NetCDF3)
    reader = spark.read.format("netcdf3").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    return (reader.option("variable", variable) if variable else reader).load()


def _attrs(attrs: Mapping) -> bytes:
    if not attrs:
        return struct.pack(">ii", 0, 0)
    out = struct.pack(">ii", 12, len(attrs))
    for k, v in attrs.items():
        out += _name(k)
        if isinstance(v, str):
            raw, kind, n = v.encode(), 2, len(v.encode())
        else:
            x = np.atleast_1d(np.asarray(v))
            x = x.astype("f8") if x.dtype.kind == "f" and x.dtype != np.dtype("f4") else x.astype("i4") if x.dtype.kind in "iu" else x
            kind, n = _NUMBER[x.dtype], len(x)
            raw = x.astype(x.dtype.newbyteorder(">")).tobytes()
        out += struct.pack(">ii", kind, n) + raw + bytes(-len(raw) % 4)
    return out


def _name(s: str) -> bytes:
    b = s.encode()
    return struct.pack(">i", len(b)) + b + bytes(-len(b) % 4)


def write(path: str, sizes: Mapping[str, int], variables: Mapping[str, tuple], attrs: Mapping | None = None) -> None:
    """A classic file of ``name: (dims, array, attributes)``, written whole under another name first."""
    ids = {d: k for k, d in enumerate(sizes)}
    head = b"CDF\x02" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(sizes)) + b"".join(_name(d) + struct.pack(">i", n) for d, n in sizes.items()) + _attrs(attrs or {})
    raws, entries = [], []
    for name, (dims, data, own) in variables.items():
        x = np.asarray(data)
        x = x.astype("i4") if x.dtype.kind in "iub" and x.dtype.itemsize > 2 else x.astype("f8") if x.dtype not in _NUMBER else x
        raw = x.astype(x.dtype.newbyteorder(">")).tobytes()
        raw += bytes(-len(raw) % 4)
        raws.append(raw)
        entries.append(_name(name) + struct.pack(">i", len(dims)) + b"".join(struct.pack(">i", ids[d]) for d in dims) + _attrs(own) + struct.pack(">ii", _NUMBER[x.dtype], min(len(raw), (1 << 31) - 4)))
    at = len(head) + 8 + sum(len(e) + 8 for e in entries)
    body = struct.pack(">ii", 11, len(entries)) if entries else struct.pack(">ii", 0, 0)
    for e, raw in zip(entries, raws, strict=True):
        body += e + struct.pack(">q", at)
        at += len(raw)
    with open(f"{path}.part", "wb") as f:
        f.write(head + body + b"".join(raws))
    os.replace(f"{path}.part", path)


_EPOCH = "seconds since 1970-01-01 00:00:00"


def write_series(df, path: str, dims: Sequence[str], value: str, groupby: str, time: str | None = None, fill: float = 1e20) -> list:
    """One file per group, written by the executors; (group, path, n_values) of each.

    ``groupby`` is a column or a part of a time such as ``time.year``; ``path`` is a
    template of {start}, {end} (times, if there is one) and {group}, on a folder
    that executors and driver share. A task holds one group's array. Missing
    values, and cells without a row, are written as ``fill`` and named so by
    ``_FillValue``; of several rows in one place the last counts.
    """
    from .tables import _group

    _, group = _group(df, groupby)
    names = list(dims)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        axes = [np.unique(rows[d].to_numpy()) for d in names]
        data = np.full([len(a) for a in axes], fill)
        at = tuple(np.searchsorted(a, rows[d].to_numpy()) for a, d in zip(axes, names, strict=True))
        x = rows[value].to_numpy(float, na_value=np.nan)
        data[at] = np.where(np.isnan(x), fill, x)
        variables = {}
        for d, a in zip(names, axes, strict=True):
            when = a.dtype.kind == "M"
            variables[d] = ((d,), a.astype("datetime64[s]").astype(float) if when else a.astype(float), {"units": _EPOCH} if when else {})
        variables[value] = (tuple(names), data, {"_FillValue": float(fill)})
        span = {"start": pd.Timestamp(rows[time].min()), "end": pd.Timestamp(rows[time].max())} if time else {}
        to = path.format(group=key[0], **span)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        write(to, {d: len(a) for d, a in zip(names, axes, strict=True)}, variables)
        return pd.DataFrame({"group": [str(key[0])], "path": [to], "n_values": [int(data.size)]})

    kept = list(dict.fromkeys([*names, value, *([time] if time else [])]))
    rows = df.select(group.alias("__group"), *kept)
    return rows.groupBy("__group").applyInPandas(run, "group string, path string, n_values bigint").collect()  # one row per file
