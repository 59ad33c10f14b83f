"""LAS files as a Spark data source: points and headers in, points out.

``spark.read.format("las").load(path)`` takes a file, a folder or a pattern (options: pattern,
recursive, chunk = points of a partition, record = true for each point's whole record as bytes);
``las_headers`` gives a row a file without reading points; ``df.write.format("las").mode("append").save(folder)``
writes a file for each partition. With the option template, a LAS file, and the column record, files keep the
template's point format, scales, offsets, variable-length records and all dimensions of each point; only the
class is set, and counts and bounds are made anew.
Compressed LAZ needs a decoder that isn't bundled and raises a clear error.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the LAS specification: what each point format holds after the common fields.
_GPS, _RGB, _NIR = frozenset((1, 3, 4, 5, 6, 7, 8, 9, 10)), frozenset((2, 3, 5, 7, 8, 10)), frozenset((8, 10))
_LENGTHS = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
_HEADER_SIZES = {2: 227, 3: 235, 4: 375}
SCHEMA = "point_id long, src_file string, x double, y double, z double, intensity int, return_number int, classification int, red int, green int, blue int, nir int"
HEADER_SCHEMA = "src_file string, version string, point_format int, n_points long, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double"


@dataclass(frozen=True)
class Header:
    minor: int
    size: int
    offset: int
    point_format: int
    record: int
    count: int
    scales: tuple[float, ...]
    offsets: tuple[float, ...]
    bounds: tuple[float, ...]  # xmax, xmin, ymax, ymin, zmax, zmin


def parse_header(raw: bytes, name: str) -> Header:
    if raw[:4] != b"LASF":
        raise ValueError(f"{name} is not a LAS file")
    minor, fmt = raw[25], raw[104]
    size, offset = struct.unpack_from("<HI", raw, 94)
    record, count = struct.unpack_from("<HI", raw, 105)
    numbers = struct.unpack_from("<12d", raw, 131)
    if minor >= 4 and len(raw) >= 255:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    if fmt & 0x80:
        raise ValueError(f"{name} is compressed; convert it to LAS first (no LAZ decoder is bundled)")
    return Header(minor, size, offset, fmt & 0x7F, record, count, numbers[:3], numbers[3:6], numbers[6:])


def point_type(fmt: int, record: int) -> np.dtype:
    """The record layout; bytes beyond the known fields are skipped."""
    if fmt not in _LENGTHS:
        raise ValueError(f"point format {fmt} is unknown")
    if fmt < 6:
        fields = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("classification", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
        gps = 20
    else:
        fields = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2")]
        gps = 22
    at = np.cumsum([0] + [np.dtype(k).itemsize for _, k in fields])[:-1].tolist()
    end = gps
    if fmt in _GPS:
        fields.append(("gps", "<f8"))
        at.append(end)
        end += 8
    if fmt in _RGB:
        for c in ("red", "green", "blue"):
            fields.append((c, "<u2"))
            at.append(end)
            end += 2
    if fmt in _NIR:
        fields.append(("nir", "<u2"))
        at.append(end)
    return np.dtype({"names": [n for n, _ in fields], "formats": [k for _, k in fields], "offsets": at, "itemsize": max(record, _LENGTHS[fmt])})


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def find(path: str, pattern: str = "*.la[sz]", recursive: bool = False) -> list[str]:
    """Files of a path in order: the file itself, or what a folder holds."""
    system, local = _filesystem(path)
    info = system.get_file_info(local)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(local)]
    inside = system.get_file_info(fs.FileSelector(local, recursive=recursive))
    return sorted(prefix + f.path for f in inside if f.type == fs.FileType.File and fnmatch(f.base_name.lower(), pattern))


def read_header(path: str) -> Header:
    system, local = _filesystem(path)
    with system.open_input_file(local) as f:
        return parse_header(f.read(375), path)


@dataclass
class _Points(InputPartition):
    path: str
    first: int
    count: int
    before: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = find(options["path"], options.get("pattern", "*.la[sz]"), options.get("recursive", "false") == "true")
        self.chunk, self.record = int(options.get("chunk", 2_000_000)), options.get("record", "false") == "true"

    def partitions(self):
        out, before = [], 0
        for path in self.files:
            n = read_header(path).count
            out += [_Points(path, at, min(self.chunk, n - at), before) for at in range(0, n, self.chunk)]
            before += n
        return out or [_Points("", 0, 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        header = read_header(partition.path)
        kind = point_type(header.point_format, header.record)
        system, local = _filesystem(partition.path)
        with system.open_input_file(local) as f:
            for at in range(0, partition.count, 200_000):
                n = min(200_000, partition.count - at)
                f.seek(header.offset + (partition.first + at) * kind.itemsize)
                raw = f.read(n * kind.itemsize)
                p = np.frombuffer(raw, kind)
                columns, names = self._columns(p, header, partition, at), [c.split()[0] for c in SCHEMA.split(", ")]
                if self.record:
                    borders = pa.py_buffer((np.arange(n + 1) * kind.itemsize).astype(np.int32))
                    columns, names = [*columns, pa.Array.from_buffers(pa.binary(), n, [None, borders, pa.py_buffer(raw)])], [*names, "record"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    @staticmethod
    def _columns(p, header, partition, at):
        n = len(p)
        ids = partition.before + partition.first + at + 1 + np.arange(n)
        xyz = [p[v] * header.scales[k] + header.offsets[k] for k, v in enumerate("XYZ")]
        returns = p["returns"] & (7 if header.point_format < 6 else 15)
        label = p["classification"] & (31 if header.point_format < 6 else 255)
        bands = [pa.array(p[c].astype(np.int32)) if c in p.dtype.names else pa.nulls(n, pa.int32()) for c in ("red", "green", "blue", "nir")]
        return [
            pa.array(ids), pa.array([partition.path] * n), *(pa.array(v) for v in xyz), pa.array(p["intensity"].astype(np.int32)),
            pa.array(returns.astype(np.int32)), pa.array(label.astype(np.int32)), *bands,
        ]


class _HeaderReader(DataSourceReader):
    def __init__(self, options):
        self.files = find(options["path"], options.get("pattern", "*.la[sz]"), options.get("recursive", "false") == "true")

    def partitions(self):
        return [InputPartition(f) for f in self.files] or [InputPartition("")]

    def read(self, partition):
        if partition.value:
            h = read_header(partition.value)
            xmax, xmin, ymax, ymin, zmax, zmin = h.bounds
            yield (partition.value, f"1.{h.minor}", h.point_format, h.count, xmin, xmax, ymin, ymax, zmin, zmax)


@dataclass
class _Written(WriterCommitMessage):
    path: str
    count: int


def header_bytes(minor: int, fmt: int, count: int, scales, offsets, bounds, returns) -> bytes:
    size = _HEADER_SIZES[minor]
    out = bytearray(size)
    out[:4], out[24], out[25] = b"LASF", 1, minor
    out[58:68] = b"strataspar"
    struct.pack_into("<HIIBHI", out, 94, size, size, 0, fmt, _LENGTHS[fmt], count if fmt < 6 and count < 2**32 else 0)
    if fmt < 6:
        struct.pack_into("<5I", out, 111, *returns[:5])
    struct.pack_into("<12d", out, 131, *scales, *offsets, *bounds)
    if minor >= 4:
        struct.pack_into("<Q", out, 247, count)
        struct.pack_into("<15Q", out, 255, *returns[:15])
    return bytes(out)


def template_bytes(raw: bytes, header: Header, count: int, bounds, returns) -> bytes:
    """The template's bytes before its points, with counts and bounds of the new ones."""
    out, fmt = bytearray(raw), header.point_format
    struct.pack_into("<I", out, 107, count if fmt < 6 and count < 2**32 else 0)
    struct.pack_into("<5I", out, 111, *(returns[:5] if fmt < 6 else [0] * 5))
    struct.pack_into("<6d", out, 179, *bounds)
    if header.minor >= 4 and header.size >= 375:
        struct.pack_into("<QI", out, 235, 0, 0)  # extended records stand after the points, which aren't copied
        struct.pack_into("<Q", out, 247, count)
        struct.pack_into("<15Q", out, 255, *returns[:15])
    return bytes(out)


class _Writer(DataSourceArrowWriter):
    """Options: point_format (default 8), version (1.2 to 1.4), scale (0.001), label (column of the class), template."""

    def __init__(self, options, schema):
        self.folder, self.template = options["path"], options.get("template")
        self.label = options.get("label", "class" if "class" in schema.names else "classification")
        if self.template:
            if "record" not in schema.names:
                raise ValueError("a template needs the column record; read with the option record = true")
            header = read_header(self.template)
            self.fmt, self.minor, self.length = header.point_format, header.minor, header.record
            self.scales, self.offsets = np.array(header.scales), np.array(header.offsets)
            return
        self.fmt, self.minor = int(options.get("point_format", 8)), int(options.get("version", "1.4").split(".")[1])
        self.length, self.scales, self.offsets = _LENGTHS[self.fmt], np.full(3, float(options.get("scale", 0.001))), None
        if self.fmt >= 6 and self.minor < 4:
            raise ValueError("point formats from 6 on need version 1.4")

    def _packed(self, batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
        """The records of a batch."""
        n = batch.num_rows
        column = lambda c, default=0: batch.column(c).fill_null(default).to_numpy(zero_copy_only=False) if c in batch.schema.names else np.full(n, default)
        if self.template:
            p = np.frombuffer(bytearray(b"".join(batch.column("record").to_pylist())), kind)  # a copy would lose extra bytes
            known = batch.column(self.label).is_valid().to_numpy(zero_copy_only=False) if self.label in batch.schema.names else np.zeros(n, bool)
            flags = p["classification"] & (0xE0 if self.fmt < 6 else 0)
            p["classification"] = np.where(known, flags | column(self.label).astype(np.uint8), p["classification"])
            return p
        xyz = np.stack([column(v, 0.0) for v in "xyz"], 1).astype(float)
        if self.offsets is None:
            self.offsets = np.floor(xyz.min(0))
        p = np.zeros(n, kind)
        for k, v in enumerate("XYZ"):
            p[v] = np.rint((xyz[:, k] - self.offsets[k]) / self.scales[k])
        for c in ("intensity", "red", "green", "blue", "nir"):
            if c in p.dtype.names:
                p[c] = column(c)
        p["classification"] = column(self.label, 1)
        p["returns"] = np.clip(column("return_number", 1), 1, 15 if self.fmt >= 6 else 7)
        return p

    def write(self, batches):
        kind = point_type(self.fmt, self.length)
        system, local = _filesystem(self.folder)
        system.create_dir(local, recursive=True)
        path = f"{local}/part-{uuid.uuid4().hex}.las"
        count, returns, lo, hi = 0, np.zeros(15, np.int64), np.full(3, np.inf), np.full(3, -np.inf)
        with system.open_output_stream(path + ".points") as body:
            for batch in batches:
                if not batch.num_rows:
                    continue
                p = self._packed(batch, kind)
                number = p["returns"] & (15 if self.fmt >= 6 else 7)
                returns += np.bincount(np.clip(number, 1, 15) - 1, minlength=15)
                xyz = np.stack([p[v] for v in "XYZ"], 1) * self.scales + self.offsets
                lo, hi, count = np.minimum(lo, xyz.min(0)), np.maximum(hi, xyz.max(0)), count + len(p)
                body.write(p.tobytes() if p.base is None else p.base)
        if count:
            bounds = [v for k in range(3) for v in (hi[k], lo[k])]
            if self.template:
                header = read_header(self.template)
                own, at = _filesystem(self.template)
                with own.open_input_file(at) as f:
                    head = template_bytes(f.read(header.offset), header, count, bounds, returns.tolist())
            else:
                head = header_bytes(self.minor, self.fmt, count, self.scales, self.offsets, bounds, returns.tolist())
            with system.open_output_stream(path) as out, system.open_input_stream(path + ".points") as body:
                out.write(head)
                while chunk := body.read(1 << 22):
                    out.write(chunk)
        system.delete_file(path + ".points")
        return _Written(path if count else "", count)

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path:
                _filesystem(self.folder)[0].delete_file(m.path)


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return f"{SCHEMA}, record binary" if self.options.get("record", "false") == "true" else SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, schema)


class LasHeaderSource(DataSource):
    @classmethod
    def name(cls):
        return "las_headers"

    def schema(self):
        return HEADER_SCHEMA

    def reader(self, schema):
        return _HeaderReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LasSource)
    spark.dataSource.register(LasHeaderSource)
    return spark


def supported(path: str) -> bool:
    """Whether a path's suffix is that of a point cloud this package reads."""
    return os.path.splitext(path)[1].lower() in (".las", ".parquet", ".csv", ".txt")
