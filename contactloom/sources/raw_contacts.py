"""Raw binary contact files with a block index, as a Spark data source.

A file begins with the magic "HIC" and a version (8 or 9), then genome name, attributes,
chromosomes and bin widths.  Its master index names a record for each chromosome pair, the record
lists the pair's blocks for each bin width, and a block is a deflated list of cells.

`spark.read.format("contact_file").load(path)` gives (resolution, chr1, bin1, chr2, bin2, cnt).  The driver reads the header, the master index
and the records of the asked pairs; tasks read blocks by their offsets.  Equalities and IN on
resolution, chr1 and chr2 are pushed down, so neither records nor blocks of other pairs or widths are touched.
A partition is a stretch of one pair's blocks of at most `PARTITION_BYTES`, so one large pair is split.

Paths are opened by pyarrow's file systems (local folders, hdfs, s3, gs), and may be a file, a folder of files, or
several of either, comma separated.  Pairs that a file does not hold give no rows, as does an empty folder.  Chromosome numbers are the file's own: with
`option("pseudo", "true")` the whole-genome chromosome, number 0, is kept; by default it is left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..runtime import prepare
from ..schemas import CHROMS, CONTACTS

NAME = "contact_file"
MAGIC = b"HIC\0"
VERSIONS = (8, 9)
#: Compressed bytes of a partition's blocks; a larger block is a partition of its own.
PARTITION_BYTES = 16 << 20
#: Bytes that are read at once of the header and the index.
STEP = 1 << 16
ARROW = pa.schema([("resolution", pa.int32()), ("chr1", pa.int32()), ("bin1", pa.int32()), ("chr2", pa.int32()), ("bin2", pa.int32()), ("cnt", pa.float32())])


class Cursor:
    """Little-endian values read in order from a place of an open file."""

    def __init__(self, handle: pa.NativeFile, at: int):
        self.handle, self.at, self.data, self.begin = handle, at, b"", at

    def take(self, n: int) -> bytes:
        left = self.at - self.begin
        if left + n > len(self.data):
            self.handle.seek(self.at)
            self.data, self.begin, left = self.handle.read(max(n, STEP)), self.at, 0
            if len(self.data) < n:
                raise ValueError("the contact file ends within a record")
        self.at += n
        return self.data[left : left + n]

    def one(self, kind: str) -> int | float:
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def table(self, kind: np.dtype, n: int) -> np.ndarray:
        return np.frombuffer(self.take(kind.itemsize * n), kind)

    def text(self) -> str:
        out = bytearray()
        while (c := self.take(1)) != b"\0":
            out += c
        return out.decode()


@dataclass
class Header:
    version: int
    chromosomes: list[tuple[str, int]]
    resolutions: list[int]
    pairs: dict[tuple[int, int], int]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(paths: str) -> list[str]:
    """The files behind comma separated paths, folders by name order; hidden and bookkeeping files are passed over."""
    out = []
    for path in filter(None, (p.strip() for p in paths.split(","))):
        system, inner = opened(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            out.append(path)
            continue
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        out += sorted(prefix + f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return out


def is_raw(path: str) -> bool:
    """Whether the path's first file begins as a raw contact file does."""
    files = files_of(path)
    if not files:
        return False
    system, inner = opened(files[0])
    with system.open_input_file(inner) as handle:
        return handle.read(len(MAGIC)) == MAGIC


def header(handle: pa.NativeFile) -> Header:
    c = Cursor(handle, 0)
    if c.take(4) != MAGIC:
        raise ValueError("not a contact file")
    version = c.one("i")
    if version not in VERSIONS:
        raise ValueError(f"contact files of version {version} are not read")
    master = c.one("q")
    c.text()
    if version > 8:
        c.take(16)  # place and length of the index of normalisation vectors
    for _ in range(c.one("i")):
        c.text(), c.text()
    long = "q" if version > 8 else "i"
    chromosomes = [(c.text(), c.one(long)) for _ in range(c.one("i"))]
    resolutions = [c.one("i") for _ in range(c.one("i"))]
    c = Cursor(handle, master)
    c.one(long)  # bytes of the index
    pairs = {}
    for _ in range(c.one("i")):
        key, at, _size = c.text(), c.one("q"), c.one("i")
        a, b = map(int, key.split("_"))
        pairs[a, b] = at
    return Header(version, chromosomes, resolutions, pairs)


BLOCK = np.dtype([("number", "<i4"), ("at", "<i8"), ("size", "<i4")])


def index(handle: pa.NativeFile, at: int) -> dict[int, np.ndarray]:
    """The blocks of a pair by bin width (base pair units only)."""
    c = Cursor(handle, at)
    c.take(8)
    out = {}
    for _ in range(c.one("i")):
        unit = c.text()
        c.take(4 + 4 * 4)  # number of the width; sum of counts, occupied cells and two percentiles
        width, _bins, _columns, n = c.one("i"), c.one("i"), c.one("i"), c.one("i")
        blocks = c.table(BLOCK, n)
        if unit == "BP":
            out[width] = blocks[blocks["size"] > 0]
    return out


def cells(data: bytes, version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin1, bin2 and count of the cells of a deflated block."""
    raw = zlib.decompress(data)
    _n, x0, y0 = struct.unpack_from("<iii", raw)
    short = raw[12] == 0
    at = 13
    wide_x = wide_y = False
    if version > 8:
        wide_x, wide_y = raw[13] != 0, raw[14] != 0
        at = 15
    kind = raw[at]
    at += 1
    value = np.dtype("<i2" if short else "<f4")
    column, row = np.dtype("<i4" if wide_x else "<i2"), np.dtype("<i4" if wide_y else "<i2")
    if kind == 1:
        rows = int(np.frombuffer(raw, row, 1, at)[0])
        at += row.itemsize
        cell = np.dtype([("x", column), ("v", value)])
        xs, ys, vs = [], [], []
        for _ in range(rows):
            y = int(np.frombuffer(raw, row, 1, at)[0])
            m = int(np.frombuffer(raw, column, 1, at + row.itemsize)[0])
            at += row.itemsize + column.itemsize
            part = np.frombuffer(raw, cell, m, at)
            at += m * cell.itemsize
            xs.append(part["x"])
            vs.append(part["v"])
            ys.append(np.full(m, y))
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        x, y, v = np.concatenate(xs), np.concatenate(ys), np.concatenate(vs)
    elif kind == 2:
        m, w = struct.unpack_from("<ih", raw, at)
        v = np.frombuffer(raw, value, m, at + 6)
        place = np.flatnonzero(v != -32768 if short else ~np.isnan(v))
        x, y, v = place % w, place // w, v[place]
    else:
        raise ValueError(f"blocks of kind {kind} are not known")
    return x.astype(np.int64) + x0, y.astype(np.int64) + y0, v.astype(np.float32)


@dataclass
class Stretch(InputPartition):
    path: str
    version: int
    resolution: int
    chr1: int
    chr2: int
    blocks: list[tuple[int, int]]


class ContactReader(DataSourceReader):
    def __init__(self, paths: str, pseudo: bool):
        self.paths, self.pseudo = paths, pseudo
        self.wanted: dict[str, set[int]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities and IN on resolution, chr1 and chr2 are done here; all other filters are Spark's."""
        for f in filters:
            values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in ("resolution", "chr1", "chr2"):
                yield f
            else:
                known = {v for v in values if v is not None}
                self.wanted[f.attribute[0]] = self.wanted.get(f.attribute[0], known) & known

    def asked(self, name: str, value: int) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def partitions(self) -> list[Stretch]:
        out = []
        for path in files_of(self.paths):
            system, inner = opened(path)
            with system.open_input_file(inner) as handle:
                head = header(handle)
                for (a, b), at in sorted(head.pairs.items()):
                    if not (self.asked("chr1", a) and self.asked("chr2", b)) or not (self.pseudo or a and b):
                        continue
                    for width, blocks in sorted(index(handle, at).items()):
                        if self.asked("resolution", width):
                            out += self.split(Stretch(path, head.version, width, a, b, []), blocks)
        return out or [Stretch("", 0, 0, 0, 0, [])]

    def split(self, empty: Stretch, blocks: np.ndarray) -> Iterator[Stretch]:
        """Neighbouring blocks together, up to PARTITION_BYTES."""
        blocks = np.sort(blocks, order="at")
        part = (np.cumsum(blocks["size"].astype(np.int64)) - blocks["size"]) // PARTITION_BYTES
        for k in np.unique(part):
            own = blocks[part == k]
            yield Stretch(empty.path, empty.version, empty.resolution, empty.chr1, empty.chr2, list(zip(own["at"].tolist(), own["size"].tolist(), strict=True)))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        system, inner = opened(partition.path)
        with system.open_input_file(inner) as handle:
            for at, size in partition.blocks:
                x, y, v = cells(handle.read_at(size, at), partition.version)
                n = len(x)
                fixed = [np.full(n, k, np.int32) for k in (partition.resolution, partition.chr1, partition.chr2)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (fixed[0], fixed[1], x.astype(np.int32), fixed[2], y.astype(np.int32), v)], schema=ARROW)


class ContactFile(DataSource):
    """Options: path, pseudo."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CONTACTS

    def reader(self, schema) -> ContactReader:
        return ContactReader(self.options.get("path", ""), str(self.options.get("pseudo", "false")).lower() == "true")


def contacts(spark: SparkSession, path: str, pseudo: bool = False) -> DataFrame:
    """The contacts of raw files; filters on resolution, chr1 and chr2 reach the index."""
    prepare(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContactFile)
    return spark.read.format(NAME).option("pseudo", pseudo).load(path)


def chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """(chr_idx, name, length) from a file's header, without the whole-genome chromosome."""
    system, inner = opened(files_of(path)[0])
    with system.open_input_file(inner) as handle:
        rows = [(i, name, length) for i, (name, length) in enumerate(header(handle).chromosomes) if i]
    return spark.createDataFrame(rows, CHROMS)


def resolutions(spark: SparkSession, path: str) -> DataFrame:
    """The bin widths that a file offers."""
    system, inner = opened(files_of(path)[0])
    with system.open_input_file(inner) as handle:
        return spark.createDataFrame([(r,) for r in header(handle).resolutions], "resolution int")


# -- export ----------------------------------------------------------------------------------------------------
#: Bins on a side of a block that the export writes; cells of one block are one deflated list.
BLOCK_BINS = 1000


def encoded(x: np.ndarray, y: np.ndarray, v: np.ndarray, version: int) -> bytes:
    """A deflated block of cells, as a list of rows."""
    x0, y0 = int(x.min()), int(y.min())
    wide = version > 8
    parts = [struct.pack("<iiib", len(x), x0, y0, 1)] + ([b"\1\1"] if wide else []) + [b"\1"]
    short = np.dtype("<i4" if wide else "<i2")
    order = np.lexsort((x, y))
    x, y, v = x[order] - x0, y[order] - y0, v[order]
    edge = [*np.flatnonzero(np.diff(y, prepend=-1)).tolist(), len(y)]
    parts.append(np.array(len(edge) - 1, short).tobytes())
    cell = np.dtype([("x", short), ("v", "<f4")])
    for s, e in zip(edge[:-1], edge[1:], strict=True):
        row = np.empty(e - s, cell)
        row["x"], row["v"] = x[s:e], v[s:e]
        parts += [np.array([y[s], e - s], short).tobytes(), row.tobytes()]
    return zlib.compress(b"".join(parts))


def text(value: str) -> bytes:
    return value.encode() + b"\0"


def file_of(chr1: int, chr2: int, by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], chroms: list[tuple[str, int]], version: int = 9) -> bytes:
    """A whole contact file of one chromosome pair: cells (bin1, bin2, count) by bin width; chroms begin with number 1."""
    long = "<q" if version > 8 else "<i"
    table = [("All", sum(n for _, n in chroms) // 1000), *chroms]
    head = text("genome") + (struct.pack("<qq", 0, 0) if version > 8 else b"") + struct.pack("<i", 0) + struct.pack("<i", len(table))
    head += b"".join(text(name) + struct.pack(long, n) for name, n in table) + struct.pack("<i", len(by_width)) + b"".join(struct.pack("<i", w) for w in by_width) + struct.pack("<i", 0)
    at, body, zooms = 16 + len(head), [], []
    for i, (width, (x, y, v)) in enumerate(by_width.items()):
        columns = int(max(x.max(initial=0), y.max(initial=0))) // BLOCK_BINS + 1
        number = (y // BLOCK_BINS) * columns + x // BLOCK_BINS
        entries = []
        for k in np.unique(number).tolist():
            own = number == k
            block = encoded(x[own], y[own], v[own], version)
            entries.append(struct.pack("<iqi", k, at, len(block)))
            body.append(block)
            at += len(block)
        zooms.append(text("BP") + struct.pack("<ififf", i, float(v.sum()), len(v), 0.0, 0.0) + struct.pack("<iiii", width, BLOCK_BINS, columns, len(entries)) + b"".join(entries))
    record = struct.pack("<iii", chr1, chr2, len(zooms)) + b"".join(zooms)
    entry = struct.pack("<i", 1) + text(f"{chr1}_{chr2}") + struct.pack("<qi", at, len(record))
    return MAGIC + struct.pack("<iq", version, at + len(record)) + head + b"".join(body) + record + struct.pack(long, len(entry)) + entry


def export(table: DataFrame, chroms: DataFrame, folder: str, version: int = 9) -> int:
    """Write contacts as one raw file for each chromosome pair, and return their number.

    A pair is encoded by one task, which writes a hidden file and renames it, so a repeated task leaves the same file.
    The chromosome table (a row each) comes to the driver."""
    names = [(r.name, int(r.length)) for r in chroms.orderBy("chr_idx").select("name", "length").collect()]
    system, inner = opened(folder)
    system.create_dir(inner, recursive=True)

    def write(key: tuple, group: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        chr1, chr2 = (k.as_py() for k in key)
        columns = {c: group.column(c).to_numpy() for c in ("resolution", "bin1", "bin2", "cnt")}
        by_width = {}
        for width in np.unique(columns["resolution"]).tolist():
            own = columns["resolution"] == width
            by_width[width] = tuple(columns[c][own].astype(kind) for c, kind in (("bin1", np.int64), ("bin2", np.int64), ("cnt", np.float32)))
        there, root = opened(folder)
        hidden, final = f"{root}/.{chr1}_{chr2}.{TaskContext.get().taskAttemptId()}", f"{root}/{chr1}_{chr2}.contacts"
        with there.open_output_stream(hidden) as out:
            out.write(file_of(chr1, chr2, by_width, names, version))
        there.move(hidden, final)
        return pa.table({"chr1": pa.array([chr1], pa.int32()), "chr2": pa.array([chr2], pa.int32())})

    prepare(table.sparkSession)
    rows = table.selectExpr("cast(resolution as int) as resolution", "cast(chr1 as int) as chr1", "cast(bin1 as int) as bin1", "cast(chr2 as int) as chr2", "cast(bin2 as int) as bin2", "cast(cnt as float) as cnt")
    return len(rows.groupBy("chr1", "chr2").applyInArrow(write, "chr1 int, chr2 int").collect())  # a row for each pair
