"""Fields files: headers, single fields, and the grid that a land mask gives.

A file is a row of words: a fixed header of 256, whose words 151 to 153 say
where the lookup is and how large, the lookup with 64 words for each field, and
the fields. Words are of 64 or 32 bits and of either order of bytes, which is
found by the length of a lookup entry. Only what is asked for is read, through
the store's own file system, so a mask in a large dump costs its headers and one
field. Fields packed to a half of a word are read; other packings are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

from ..operators.grids import LonLatGrid, um_grid

# Fixed values of the format; places count from 0.
HEADER, ENTRY = 256, 64
LOOKUP_AT, ENTRY_AT, ENTRIES_AT, DATA_AT = 149, 150, 151, 159
LENGTH, ROWS, COLUMNS, PACKING, BEGIN, ON_DISK, KIND, STASH = 14, 17, 18, 20, 28, 29, 38, 41
Y0, DY, X0, DX, MISSING = 58, 59, 60, 61, 62
UNUSED = -99
LAND_MASK = 30
REAL, LOGICAL = 1, 3


@dataclass(frozen=True)
class Field:
    """A field's lookup entry; ``at`` and ``size`` are its bytes in the file, ``kind`` the type of its values."""

    stash: int
    rows: int
    columns: int
    y0: float
    dy: float
    x0: float
    dx: float
    missing: float
    packing: int
    at: int
    size: int
    kind: str
    logical: bool


class _File:
    """Reads ranges of a file in any store that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.path, self.stream = path, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        self.stream.close()

    def take(self, at: int, size: int, short: bool = False) -> bytes:
        self.stream.seek(at)
        got = bytes(self.stream.readNBytes(size))
        if len(got) < size and not short:
            raise ValueError(f"{self.path} ends within the {size} bytes from {at}")
        return got


def _lookup(f: _File) -> list[Field]:
    start = f.take(0, 8 * HEADER, short=True)
    for order in (">i8", "<i8", ">i4", "<i4"):
        width = np.dtype(order).itemsize
        words = np.frombuffer(start[: len(start) // width * width], order)[:HEADER]
        if len(words) == HEADER and words[ENTRY_AT] == ENTRY:
            break
    else:
        raise ValueError(f"{f.path} is no fields file")
    n = int(words[ENTRIES_AT])
    raw = np.frombuffer(f.take(width * (int(words[LOOKUP_AT]) - 1), width * ENTRY * n), order).reshape(n, ENTRY)
    reals = raw.view(order.replace("i", "f"))
    out, follows = [], width * (int(words[DATA_AT]) - 1)
    for i, r in zip(raw, reals, strict=True):
        if i[0] == UNUSED:
            continue
        packing = int(i[PACKING])
        half = width == 8 and packing % 10 == 2
        if i[ON_DISK]:
            at, room = width * int(i[BEGIN]), width * int(i[ON_DISK])
        else:  # fields follow each other
            at = follows
            room = width * (-(-int(i[LENGTH]) // 2) if half else int(i[LENGTH]))
            follows += room
        letter = "f" if int(i[KIND]) == REAL else "i"
        kind = f"{order[0]}{letter}{4 if half else width}"
        logical = int(i[KIND]) == LOGICAL
        out.append(Field(int(i[STASH]), int(i[ROWS]), int(i[COLUMNS]), *(float(r[k]) for k in (Y0, DY, X0, DX, MISSING)), packing, at, room, kind, logical))
    return out


def _values(f: _File, field: Field) -> np.ndarray:
    if field.packing % 100 not in (0, 2):
        raise NotImplementedError(f"packing {field.packing} of a field")
    n = field.rows * field.columns
    need = n * np.dtype(field.kind).itemsize
    if need > field.size:
        raise ValueError(f"a field of {n} values in {field.size} bytes")
    raw = np.frombuffer(f.take(field.at, need), field.kind).reshape(field.rows, field.columns)
    if field.logical:
        return raw != 0
    if raw.dtype.kind == "i":
        return raw.astype(np.int64)
    return np.where(raw == np.asarray(field.missing, raw.dtype), np.nan, raw.astype(float))


def fields(spark: SparkSession, path: str) -> list[Field]:
    """The fields of a file, in its order, by their headers alone."""
    with _File(spark, path) as f:
        return _lookup(f)


def values(spark: SparkSession, path: str, field: Field) -> np.ndarray:
    """A field's values, rows x columns; missing reals are NaN, logicals are booleans."""
    with _File(spark, path) as f:
        return _values(f, field)


def mask_grid(spark: SparkSession, path: str, stash: int = LAND_MASK) -> LonLatGrid:
    """The grid of a file's first field with this code (the land mask), whose nonzero cells are closed."""
    with _File(spark, path) as f:
        field = next((x for x in _lookup(f) if x.stash == stash), None)
        if field is None:
            raise ValueError(f"{path} has no field with code {stash}")
        mask = _values(f, field)
    return um_grid(spark, field.columns, field.rows, field.x0, field.dx, field.y0, field.dy, np.nan_to_num(mask.astype(float), nan=1.0))
