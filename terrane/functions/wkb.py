"""Shapes as well-known binary, and as nested arrays that SQL can work on.

A shape is a struct: kind (1 point, 2 line, 3 polygon, 4 to 6 several of these, 7 a collection), z and m (whether points have
these values), parts (of each single shape its rings; a line or a point is one ring) and members (of a collection: its
shapes, in well-known binary again). Points are structs x, y, z, m. Binary of either byte order is read, with the flags for Z and M of both
usual kinds, and a reference number, which is left out; what is written is of the standard kind.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import geometry

#: Fixed values of the format: kinds, and the flags that one dialect puts into the type number.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)
HAS_Z, HAS_M, HAS_REFERENCE = 0x80000000, 0x40000000, 0x20000000
_POINT = "struct<x:double,y:double,z:double,m:double>"
SCHEMA = f"struct<kind:int,z:boolean,m:boolean,parts:array<array<array<{_POINT}>>>,members:array<binary>>"
_ARROW_POINT = pa.struct([(n, pa.float64()) for n in "xyzm"])
_ARROW = pa.struct(
    [("kind", pa.int32()), ("z", pa.bool_()), ("m", pa.bool_()), ("parts", pa.list_(pa.list_(pa.list_(_ARROW_POINT)))), ("members", pa.list_(pa.binary()))]
)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 0, "<"

    def head(self) -> tuple[int, bool, bool]:
        self.order = {0: ">", 1: "<"}[self.data[self.at]]
        self.at += 1
        number = self.count()
        if number & HAS_REFERENCE:
            self.at += 4
        plain = number & 0x0FFFFFFF
        return plain % 1000, bool(number & HAS_Z) or plain // 1000 in (1, 3), bool(number & HAS_M) or plain // 1000 in (2, 3)

    def count(self) -> int:
        (n,) = struct.unpack_from(self.order + "I", self.data, self.at)
        self.at += 4
        return n

    def points(self, n: int, z: bool, m: bool) -> list[dict]:
        width = 2 + z + m
        if n * width * 8 > len(self.data) - self.at:
            raise struct.error("too short")
        values = np.frombuffer(self.data, self.order + "f8", n * width, self.at).reshape(n, width).tolist()
        self.at += 8 * n * width
        names = ["x", "y", *["z"] * z, *["m"] * m]
        return [{"z": None, "m": None} | dict(zip(names, v, strict=True)) for v in values]

    def rings(self, kind: int, z: bool, m: bool) -> list[list[dict]]:
        if kind == POINT:
            (point,) = self.points(1, z, m)
            return [] if point["x"] != point["x"] and point["y"] != point["y"] else [[point]]  # NaN: an empty point
        if kind == LINE:
            return [line] if (line := self.points(self.count(), z, m)) else []
        return [self.points(self.count(), z, m) for _ in range(self.count())]

    def shape(self) -> dict:
        kind, z, m = self.head()
        out = {"kind": kind, "z": z, "m": m, "parts": [], "members": []}
        if kind in (POINT, LINE, POLYGON):
            rings = self.rings(kind, z, m)
            out["parts"] = [rings] if rings else []
        elif kind in (MULTI_POINT, MULTI_LINE, MULTI_POLYGON):
            for _ in range(self.count()):
                inner, inner_z, inner_m = self.head()
                if inner != kind - 3:
                    raise ValueError("a part of another kind")
                out["parts"].append(self.rings(inner, inner_z, inner_m))
        elif kind == COLLECTION:
            for _ in range(self.count()):
                first = self.at
                self.shape()
                out["members"].append(self.data[first : self.at])
        else:
            raise ValueError("no such kind")
        return out


def parse(data: bytes | None) -> dict | None:
    """The shape of well-known binary; null if it is none, is cut off or has bytes left over."""
    if data is None:
        return None
    reader = _Reader(bytes(data))
    try:
        out = reader.shape()
    except (struct.error, ValueError, KeyError, IndexError):
        return None
    return out if reader.at == len(data) else None


def write(shape: dict | None, little: bool = True) -> bytes | None:
    """Well-known binary of a shape."""
    if shape is None:
        return None
    order, z, m = "<" if little else ">", bool(shape["z"]), bool(shape["m"])
    names = ["x", "y", *["z"] * z, *["m"] * m]

    def head(kind: int) -> bytes:
        return struct.pack(order + "BI", little, kind + 1000 * z + 2000 * m)

    def points(ring: list) -> bytes:
        return np.array([[p[n] for n in names] for p in ring], order + "f8").tobytes()

    def body(kind: int, rings: list) -> bytes:
        if kind == POINT:
            return points(rings[0]) if rings else struct.pack(f"{order}{len(names)}d", *[float("nan")] * len(names))
        if kind == LINE:
            line = rings[0] if rings else []
            return struct.pack(order + "I", len(line)) + points(line)
        return struct.pack(order + "I", len(rings)) + b"".join(struct.pack(order + "I", len(r)) + points(r) for r in rings)

    kind, parts = shape["kind"], shape["parts"] or []
    if kind in (POINT, LINE, POLYGON):
        return head(kind) + body(kind, parts[0] if parts else [])
    if kind == COLLECTION:
        return head(kind) + struct.pack(order + "I", len(shape["members"] or [])) + b"".join(shape["members"] or [])
    return head(kind) + struct.pack(order + "I", len(parts)) + b"".join(head(kind - 3) + body(kind - 3, p) for p in parts)


def decode(binary: Column) -> Column:
    """The shape of well-known binary, null if it is none."""

    @F.arrow_udf(SCHEMA)
    def of(column: pa.Array) -> pa.Array:
        return pa.array([parse(x) for x in column.to_pylist()], _ARROW)

    return of(binary)


def encode(shape: Column, little: bool = True) -> Column:
    """Well-known binary of a shape."""

    @F.arrow_udf("binary")
    def of(column: pa.Array) -> pa.Array:
        return pa.array([write(x, little) for x in column.to_pylist()], pa.binary())

    return of(shape)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def area(shape: Column) -> Column:
    """Area of polygons: of each its outer ring less its holes, in square units; 0 for other kinds, and for collections."""
    one = lambda rings: geometry.area(F.get(rings, F.lit(0))) - _sum(F.transform(F.slice(rings, 2, F.size(rings)), geometry.area))
    parts = F.filter(shape["parts"], lambda rings: F.size(rings) > 0)
    return F.when(shape["kind"].isin(POLYGON, MULTI_POLYGON), _sum(F.transform(parts, one))).when(shape["kind"].isNotNull(), F.lit(0.0))


def length(shape: Column) -> Column:
    """Length of lines, and of all rings of polygons, in units of their coordinates; 0 for points and collections."""
    return F.when(shape["kind"].isNotNull(), _sum(F.transform(F.flatten(shape["parts"]), geometry.length)))


def n_points(shape: Column) -> Column:
    return F.when(shape["kind"].isNotNull(), F.aggregate(F.flatten(shape["parts"]), F.lit(0), lambda total, ring: total + F.size(ring)))
