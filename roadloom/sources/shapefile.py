"""Polygon shapefiles as a Spark data source: attributes of the .dbf and rings of the .shp, read by ranges of records.

    spark.dataSource.register(Shapefile)
    spark.read.format("shapefile").option("recordsPerPartition", 500).load("borders.shp")

The driver reads the headers alone; a task reads its part of the index (.shx) and just the bytes of its
records. Rows have the attributes' columns and ``rings``, all rings of the record: a place is in the
polygon if it is in an odd number of them, so holes need no mark of their own. Null shapes have no rings;
deleted records are left out; blank attributes are null; Z and M values are passed over. Paths may be
local or URIs of a file system that pyarrow knows.
"""

from __future__ import annotations

import datetime
import math
import struct
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DoubleType, LongType, StringType, StructField, StructType

RECORDS = 1000
#: Fixed values of the format: size of the file header and of an index entry, file code, shape types.
HEADER, ENTRY, CODE = 100, 8, 9994
NULL, POLYGONS = 0, (5, 15, 25)
RINGS = ArrayType(ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))


class Files:
    """The three files of one name, and the bytes of ranges of them."""

    def __init__(self, path: str):
        self.stem = path[:-4] if path.lower().endswith(".shp") else path

    def _open(self, ending: str):
        at = f"{self.stem}.{ending}"
        store, name = fs.FileSystem.from_uri(at) if ":" in at else (fs.LocalFileSystem(), at)
        return store.open_input_file(name)

    def bytes_of(self, ending: str, start: int, size: int) -> bytes:
        with self._open(ending) as f:
            f.seek(start)
            out = f.read(size)
        if len(out) < size:
            raise ValueError(f"{self.stem}.{ending} ends before byte {start + size}")
        return out

    def size_of(self, ending: str) -> int:
        with self._open(ending) as f:
            return f.size()

    def encoding(self) -> str:
        try:
            with self._open("cpg") as f:
                return f.read().decode("ascii").strip() or "utf-8"
        except FileNotFoundError:
            return "utf-8"


class Table:
    """Layout of a .dbf: fields by name, kind, place and width in a record."""

    def __init__(self, files: Files):
        self.count, self.begin, self.width = struct.unpack("<IHH", files.bytes_of("dbf", 4, 8))
        raw, at = files.bytes_of("dbf", 32, self.begin - 32), 1
        self.fields: list[tuple[str, str, int, int, int]] = []
        for k in range(0, len(raw) - 31, 32):
            if raw[k] == 0x0D:
                break
            name = raw[k : k + 11].split(b"\0")[0].decode("latin-1").strip()
            kind, size, decimals = chr(raw[k + 11]), raw[k + 16], raw[k + 17]
            self.fields.append((name, kind, at, size, decimals))
            at += size

    def kind_of(self, kind: str, decimals: int, size: int) -> DataType:
        if kind == "N" and not decimals and size < 19:
            return LongType()
        return {"N": DoubleType(), "F": DoubleType(), "L": BooleanType(), "D": DateType()}.get(kind, StringType())

    def schema(self) -> StructType:
        return StructType([*(StructField(n, self.kind_of(k, d, s)) for n, k, _, s, d in self.fields), StructField("rings", RINGS)])

    def values(self, record: bytes, encoding: str) -> list:
        out = []
        for _, kind, at, size, decimals in self.fields:
            text = record[at : at + size].decode(encoding, "replace").strip(" \0")
            whole = isinstance(self.kind_of(kind, decimals, size), LongType)
            out.append(_value(text, kind, whole))
        return out


def _value(text: str, kind: str, whole: bool):
    if not text or text.strip("*") == "":
        return None
    try:
        if kind in "NF":
            return int(text) if whole else float(text)
        if kind == "D":
            return datetime.datetime.strptime(text, "%Y%m%d").date()
    except ValueError:
        return None
    if kind == "L":
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
    return text


def rings_of(shape: bytes) -> list[list[tuple[float, float]]] | None:
    """Rings of a polygon record's content."""
    (kind,) = struct.unpack_from("<i", shape)
    if kind == NULL:
        return None
    if kind not in POLYGONS:
        raise ValueError(f"shape type {kind} is no polygon")
    parts, points = struct.unpack_from("<2i", shape, 36)
    first = np.frombuffer(shape, "<i4", parts, 44).tolist() + [points]
    xy = np.frombuffer(shape, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
    return [[(x, y) for x, y in xy[a:b]] for a, b in zip(first, first[1:], strict=False)]


class Records(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class ShapefileReader(DataSourceReader):
    def __init__(self, path: str, per_partition: int):
        self.path, self.per = path, per_partition

    def partitions(self) -> list[Records]:
        files = Files(self.path)
        n = (files.size_of("shx") - HEADER) // ENTRY
        if n != Table(files).count:
            raise ValueError(f"{self.path}: shapes and attributes differ in number")
        return [Records(k, min(k + self.per, n)) for k in range(0, n, self.per)] or [Records(0, 0)]

    def read(self, partition: Records) -> Iterator[tuple]:
        n = partition.stop - partition.start
        if not n:
            return
        files = Files(self.path)
        table, encoding = Table(files), files.encoding()
        index = np.frombuffer(files.bytes_of("shx", HEADER + ENTRY * partition.start, ENTRY * n), ">i4").reshape(-1, 2).astype(np.int64) * 2
        rows = files.bytes_of("dbf", table.begin + table.width * partition.start, table.width * n)
        for k, (at, size) in enumerate(index.tolist()):
            record = rows[k * table.width : (k + 1) * table.width]
            if record[:1] != b"*":
                yield (*table.values(record, encoding), rings_of(files.bytes_of("shp", at + 8, size)))


class Shapefile(DataSource):
    """Options: path, recordsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> StructType:
        return Table(Files(self.options["path"])).schema()

    def reader(self, schema: StructType) -> ShapefileReader:
        return ShapefileReader(self.options["path"], int(self.options.get("recordsPerPartition", RECORDS)))


def write_polygons(path: str, rows: list[tuple], fields: list[tuple[str, str, int, int]]) -> None:
    """A shapefile of a bounded list of rows (attributes, rings); fields: (name, C, N, L or D, width, decimals). Local paths."""
    stem, shapes, index, at = path.removesuffix(".shp"), [], [], HEADER // 2
    xy = [p for *_, rings in rows for r in rings or [] for p in r] or [(0.0, 0.0)]
    box = [f(p[k] for p in xy) for f in (min, max) for k in (0, 1)]
    for number, (*_, rings) in enumerate(rows, 1):
        body = struct.pack("<i", NULL)
        if rings is not None:
            points = [p for r in rings for p in r]
            own = [f((p[k] for p in points), default=math.nan) for f in (min, max) for k in (0, 1)]
            first = np.cumsum([0, *(len(r) for r in rings[:-1])])[: len(rings)]
            body = struct.pack("<i4d2i", POLYGONS[0], *own, len(rings), len(points)) + first.astype("<i4").tobytes() + np.array(points, "<f8").tobytes()
        shapes.append(struct.pack(">2i", number, len(body) // 2) + body)
        index.append(struct.pack(">2i", at, len(body) // 2))
        at += 4 + len(body) // 2
    for ending, parts in (("shp", shapes), ("shx", index)):
        size = (HEADER + sum(map(len, parts))) // 2
        with open(f"{stem}.{ending}", "wb") as f:
            f.write(struct.pack(">7i", CODE, 0, 0, 0, 0, 0, size) + struct.pack("<2i8d", 1000, POLYGONS[0], *box, 0, 0, 0, 0) + b"".join(parts))
    width = 1 + sum(f[2] for f in fields)
    with open(f"{stem}.dbf", "wb") as f:
        f.write(struct.pack("<4BIHH20x", 3, 124, 1, 8, len(rows), 33 + 32 * len(fields), width))
        for name, kind, size, decimals in fields:
            f.write(name.encode("latin-1")[:10].ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([size, decimals]) + bytes(14))
        f.write(b"\r")
        for *values, _ in rows:
            f.write(b" ")
            for v, (_, kind, size, decimals) in zip(values, fields, strict=True):
                text = "" if v is None else f"{v:.{decimals}f}" if kind == "N" else ("T" if v else "F") if kind == "L" else str(v).replace("-", "") if kind == "D" else str(v)
                raw = text.encode()[:size]
                f.write(raw.rjust(size) if kind == "N" else raw.ljust(size))
        f.write(b"\x1a")
