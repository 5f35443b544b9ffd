"""ASCII grids as a data source of Spark: format `asciigrid`, columns r, c and value.

A file has a header (ncols, nrows, xllcorner or xllcenter, yllcorner or yllcenter, cellsize, perhaps
NODATA_value) and a line for each row of cells. A folder is a grid in blocks: a file for each block of
rows, with a list of them, as the writer makes it.

Reading a folder takes a partition for each block; reading a file takes one for each range of its
index, which `index_rows` makes by a Spark job and stores beside it, or one for a file without. The
option rows (first, and one after the last) asks for some rows: blocks and ranges without any of them
aren't opened. It is an option and no pushed filter, since the filters that Spark 4.1 pushes to a Python
source stay with later queries on the same frame, which then lack rows. NODATA cells are null.
Folders and files can be in any store that pyarrow knows, by its URI.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .grid import Profile

NODATA = -9999.0
#: Name of the list of a folder's files, and the ending of a file's index.
LIST, INDEX = "_grid.json", ".rows"
HEADER_BYTES = 4096
#: Rows of one batch of cells.
BATCH_CELLS = 1 << 16


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    found, at = fs.FileSystem.from_uri(path)
    return found, at.rstrip("/")


@dataclass(frozen=True)
class Header:
    columns: int
    rows: int
    x: float
    y: float
    size: float
    nodata: float
    lines: int

    @staticmethod
    def parse(text: str) -> Header:
        facts: dict[str, float] = {}
        for line in text.splitlines():
            words = line.split()
            if len(words) != 2 or not words[0][:1].isalpha():
                break
            facts[words[0].lower()] = float(words[1])
        if missing := [k for k in ("ncols", "nrows", "cellsize") if k not in facts]:
            raise ValueError(f"an ASCII grid without {', '.join(missing)}")
        size = facts["cellsize"]
        x, y = (facts.get(f"{a}llcorner", facts.get(f"{a}llcenter", 0.0) - (size / 2 if f"{a}llcenter" in facts else 0.0)) for a in "xy")
        return Header(int(facts["ncols"]), int(facts["nrows"]), x, y, size, facts.get("nodata_value", NODATA), len(facts))

    def text(self) -> str:
        number = lambda v: repr(int(v)) if v == int(v) else repr(v)
        return "".join(f"{k} {number(v)}\n" for k, v in (("ncols", self.columns), ("nrows", self.rows), ("xllcorner", self.x), ("yllcorner", self.y), ("cellsize", self.size), ("NODATA_value", self.nodata)))

    def profile(self, crs: str = "") -> Profile:
        return Profile(self.columns, self.rows, crs, (self.size, 0.0, self.x, 0.0, -self.size, self.y + self.rows * self.size), self.nodata)


def read_header(path: str) -> Header:
    """The header of a file or of a folder's whole grid; no cells are read."""
    at, name = store(path)
    info = at.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.Directory:
        with at.open_input_file(f"{name}/{LIST}") as f:
            return Header(**json.loads(f.read())["header"])
    with at.open_input_file(name) as f:
        return Header.parse(f.read(HEADER_BYTES).decode("ascii", "replace"))


@dataclass
class Rows(InputPartition):
    """Rows first to before last of the grid, in the lines from a byte of a file on."""

    name: str
    byte: int
    skip: int
    first: int
    last: int


class Reader(DataSourceReader):
    """Cells of the rows from low to high."""

    def __init__(self, path: str, header: Header, rows: str | None):
        self.path, self.header, self.low, self.high = path, header, 0, header.rows - 1
        if rows:
            first, last = map(int, rows.split(","))
            self.low, self.high = max(0, first), min(self.high, last - 1)

    def partitions(self) -> Sequence[InputPartition]:
        at, name = store(self.path)
        if at.get_file_info(name).type == fs.FileType.Directory:
            with at.open_input_file(f"{name}/{LIST}") as f:
                parts = [Rows(f"{name}/{x['name']}", 0, self.header.lines, x["first"], x["first"] + x["rows"]) for x in json.loads(f.read())["files"]]
        elif at.get_file_info(name + INDEX).type == fs.FileType.File:
            with at.open_input_file(name + INDEX) as f:
                marks = json.loads(f.read())
            lasts = [m[1] for m in marks[1:]] + [self.header.rows]
            parts = [Rows(name, byte, self.header.lines if not byte else 0, row, last) for (byte, row), last in zip(marks, lasts) if row < last]
        else:
            parts = [Rows(name, 0, self.header.lines, 0, self.header.rows)]
        return [p for p in parts if p.first <= self.high and p.last > self.low] or [Rows(name, 0, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.first >= partition.last:
            return
        at, wide = store(self.path)[0], self.header.columns
        with at.open_input_file(partition.name) as f:
            f.seek(partition.byte)
            lines = _lines(f)
            for _ in range(partition.skip):
                next(lines)
            held, r = [], partition.first
            for r in range(partition.first, partition.last):
                line = next(lines, None)
                if line is None:
                    raise ValueError(f"{partition.name} ends before row {r}")
                values = np.array(line.split(), np.float64)
                if len(values) != wide:
                    raise ValueError(f"row {r} of {partition.name} has {len(values)} cells, not {wide}")
                if self.low <= r <= self.high:
                    held.append((r, values))
                if len(held) * wide >= BATCH_CELLS:
                    yield self._batch(held)
                    held = []
            if held:
                yield self._batch(held)

    def _batch(self, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        values = np.concatenate([v for _, v in held])
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat([r for r, _ in held], self.header.columns), pa.int64()), pa.array(np.tile(np.arange(self.header.columns), len(held)), pa.int64()),
            pa.array(values, mask=(values == self.header.nodata) | np.isnan(values))], ["r", "c", "value"])


def _lines(f: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while data := f.read(chunk):
        *lines, rest = (rest + data).split(b"\n")
        yield from lines
    if rest.strip():
        yield rest


@dataclass
class Written(WriterCommitMessage):
    """Files as (temporary name, first row, rows)."""

    files: list[tuple[str, int, int]]


class Writer(DataSourceWriter):
    """Blocks under temporary names, which get theirs in the commit with the list of all of them."""

    def __init__(self, path: str, options: dict[str, str], overwrite: bool):
        self.path, self.block, self.overwrite, self.run = path, int(options.get("block_rows", 512)), overwrite, uuid.uuid4().hex
        self.header = Header(**json.loads(options["header"]))
        at, name = store(path)
        if not overwrite and at.get_file_info(name).type != fs.FileType.NotFound:
            raise ValueError(f"{path} already exists")
        at.create_dir(name, recursive=True)

    def write(self, iterator: Iterator) -> Written:
        at, name = store(self.path)
        files: list[tuple[str, int, int]] = []
        block, lines, out, own, head = None, 0, None, None, self.header
        none = f"{head.nodata:g}"
        row, at_row = None, -1

        def finish_row() -> None:
            nonlocal lines
            out.write((" ".join(row) + "\n").encode())
            lines += 1

        def finish() -> None:
            nonlocal row
            if out is None:
                return
            finish_row()
            first = block * self.block
            for _ in range(lines, min(self.block, head.rows - first)):
                row = [none] * head.columns
                finish_row()
            out.close()
            files.append((own, first, min(self.block, head.rows - first)))

        for cell in iterator:
            r, c, value = cell[0], cell[1], cell[2]
            if not (0 <= r < head.rows and 0 <= c < head.columns):
                raise ValueError(f"cell ({r}, {c}) lies outside of the grid")
            if r // self.block != block:
                finish()
                block, lines, at_row = r // self.block, 0, (r // self.block) * self.block
                own = f"_{self.run}-{uuid.uuid4().hex}"
                out = at.open_output_stream(f"{name}/{own}")
                high = min(self.block, head.rows - block * self.block)
                out.write(Header(head.columns, high, head.x, head.y + (head.rows - block * self.block - high) * head.size, head.size, head.nodata, 6).text().encode())
                row = [none] * head.columns
            while at_row < r:
                finish_row()
                row, at_row = [none] * head.columns, at_row + 1
            row[c] = none if value is None or math.isnan(value) else repr(int(value)) if value == int(value) else repr(float(value))
        finish()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        at, name = store(self.path)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        if len({f[1] for f in files}) != len(files):
            raise ValueError("a block of rows was written by two tasks: repartition by block first")
        listed = []
        for own, first, rows in files:
            at.move(f"{name}/{own}", f"{name}/rows-{first:09d}.asc")
            listed.append({"name": f"rows-{first:09d}.asc", "first": first, "rows": rows})
        with at.open_output_stream(f"{name}/_{self.run}") as f:
            f.write(json.dumps({"header": {**self.header.__dict__, "lines": 6}, "files": listed}).encode())
        at.move(f"{name}/_{self.run}", f"{name}/{LIST}")
        kept = {x["name"] for x in listed}
        for x in at.get_file_info(fs.FileSelector(name)):  # of the grid that was overwritten
            if x.base_name.startswith("rows-") and x.base_name not in kept:
                at.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        at, name = store(self.path)
        for x in at.get_file_info(fs.FileSelector(name)):
            if x.base_name.startswith(f"_{self.run}"):
                at.delete_file(x.path)


class AsciiGrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "asciigrid"

    def schema(self) -> str:
        return "r long, c long, value double"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], read_header(self.options["path"]), self.options.get("rows"))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options, overwrite)


def read_ascii(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """A grid, or the rows from rows[0] to before rows[1] of it."""
    spark.dataSource.register(AsciiGrid)
    reader = spark.read.format("asciigrid")
    return (reader.option("rows", f"{rows[0]},{rows[1]}") if rows else reader).load(path)


def write_ascii(cells: DataFrame, column: str, profile: Profile, path: str, block_rows: int = 512, overwrite: bool = False) -> None:
    """A column of a grid as a folder of ASCII grids, one for each block of rows."""
    cells.sparkSession.dataSource.register(AsciiGrid)
    a, _, x, _, _, y = profile.transform
    head = Header(profile.width, profile.height, x, y - profile.height * a, a, NODATA if profile.nodata is None else float(profile.nodata), 6)
    rows = cells.select("r", "c", F.col(column).cast("double").alias("value")).repartition(F.floor(F.col("r") / block_rows)).sortWithinPartitions("r", "c")
    rows.write.format("asciigrid").mode("overwrite" if overwrite else "append").options(path=path, block_rows=block_rows, header=json.dumps(head.__dict__)).save()


def unzipped(path: str, cache: str) -> str:
    """The path of a .gz file's content in a cache folder, where it is put once; other files are used as they are."""
    if not path.endswith(".gz"):
        return path
    at, name = store(path)
    to, folder = store(cache)
    target = f"{folder}/{name.rsplit('/', 1)[-1][:-3]}"
    if to.get_file_info(target).type != fs.FileType.File:
        to.create_dir(folder, recursive=True)
        own = f"{folder}/_{uuid.uuid4().hex}"
        with at.open_input_stream(name, compression="gzip") as f, to.open_output_stream(own) as out:
            while data := f.read(1 << 20):
                out.write(data)
        to.move(own, target)
    return f"{cache.rstrip('/')}/{target.rsplit('/', 1)[-1]}"


def index_rows(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> list[list[int]]:
    """The index of a file: for each range of bytes, where its first whole line starts and which row that is.

    A Spark job counts the lines of each range; the driver adds up one number a range.
    """
    at, name = store(path)
    size, head = at.get_file_info(name).size, read_header(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = store(path)[0]
        for b in batches:
            found = []
            for k in b.column(0).to_pylist():
                with own.open_input_file(name) as f:
                    begin = k * range_bytes
                    f.seek(begin)
                    ends, first, upto = 0, -1, begin
                    while upto < min(size, begin + range_bytes) and (data := f.read(min(1 << 20, min(size, begin + range_bytes) - upto))):
                        at_ = data.find(b"\n") if first < 0 else -1
                        first = upto + at_ + 1 if at_ >= 0 else first
                        ends += data.count(b"\n")
                        upto += len(data)
                found.append((k, ends, first))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["k", "ends", "first"])

    n = -(-size // range_bytes)
    ranges = sorted(map(tuple, spark.range(0, n, 1, min(n, 10_000)).mapInArrow(count, "k long, ends long, first long").collect()))
    marks, before = [[0, 0]], 0
    for k, ends, first in ranges:
        if k and first >= 0 and before + 1 - head.lines > 0 and before + 1 - head.lines < head.rows and first < size:
            marks.append([first, before + 1 - head.lines])
        before += ends
    with at.open_output_stream(name + INDEX) as f:
        f.write(json.dumps(marks).encode())
    return marks
