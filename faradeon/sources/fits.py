"""FITS as Spark data sources, read and written in parallel.

``fits_cube``: Q and U cubes (and I, a mask) as one row a pixel with arrays by channel: x, y, q, u [, i, m]. Each
partition is a strip of rows of the sky, or a part of one row that is too wide for a task, so spectra need no shuffle. Ranges and strides of the sky and of channels
are options, so that what lies outside is never read. (Filters aren't taken over from queries: Spark 4.1 keeps what a
Python reader took for later queries on the same DataFrame.) ``fits_image``: x, y, val of a plane. ``fits_table``: columns of a binary table.
``fits_output`` writes one product or several of one pass over the rows. Paths must be open to the driver and all
executors (a shared file system), as FITS is read and written by byte ranges.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from .fits_format import BLOCK, KINDS, Box, FitsError, header_bytes, headers, primary_cards, read_box, read_header, read_table, table_columns

#: Bytes of a partition's data.
STRIP_BYTES = 64 << 20
#: Bytes of rows that a writing task gathers, so that neighbours are written together.
FLUSH_BYTES = 32 << 20
#: End of the names of files that no commit has named yet.
STAGED = ".staged"


@dataclass
class Strip(InputPartition):
    """Rows of the sky; of a row that is too wide for a task, a part of its pixels (x1 = 0: all)."""

    y0: int
    y1: int
    x0: int = 1
    x1: int = 0


def strips(y0: int, y1: int, row_bytes: int, target: int = STRIP_BYTES, nx: int = 0) -> list[Strip]:
    """Strips of rows [y0, y1] of about ``target`` bytes. A row of more than that is split, if its ``nx`` pixels are given."""
    if nx and row_bytes > target:
        wide = max(1, nx * target // row_bytes)
        return [Strip(y, y, a, min(a + wide - 1, nx)) for y in range(y0, y1 + 1) for a in range(1, nx + 1, wide)]
    high = max(1, target // max(1, row_bytes))
    return [Strip(a, min(a + high - 1, y1)) for a in range(y0, y1 + 1, high)]


def row_bytes(nx: int, n_chan: int, cubes: int) -> int:
    """Bytes of a row of the sky in memory, of all cubes."""
    return nx * n_chan * 8 * max(1, cubes)


def _range(options: dict, name: str, size: int) -> tuple[int, int, int]:
    """[first, last] and step of an axis; last 0 (also by default) is its end."""
    first, last, step = (int(options.get(f"{name}_{k}", d)) for k, d in (("first", 1), ("last", 0), ("step", 1)))
    last = last or size
    if step < 1 or first < 1 or last < first or last > size:
        raise FitsError(f"{name}: {first}..{last} step {step} isn't within 1..{size}")
    return first, last, step


class CubeReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.paths = {"q": options.get("q"), "u": options.get("u"), "i": options.get("i"), "m": options.get("mask")}
        self.names = [f.name for f in schema if f.name not in ("x", "y")]
        some = next(p for p in self.paths.values() if p)
        with open(some, "rb") as f:
            self.header = read_header(f)
        self.axis = self.header.freq_axis()

    def _box(self) -> dict[str, tuple[int, int, int]]:
        naxes = self.header.naxes
        return {"x": _range(self.options, "x", naxes[0]), "y": _range(self.options, "y", naxes[1]), "chan": _range(self.options, "chan", naxes[self.axis - 1])}

    def partitions(self) -> list[Strip]:
        box = self._box()
        x0, x1, sx = box["x"]
        y0, y1, sy = box["y"]
        n = (y1 - y0) // sy + 1
        c0, c1, sc = box["chan"]
        nx = (x1 - x0) // sx + 1
        return strips(1, n, row_bytes(nx, (c1 - c0) // sc + 1, len(self.names)), int(self.options.get("strip_bytes", STRIP_BYTES)), nx)

    def read(self, part: Strip) -> Iterator[pa.RecordBatch]:
        box, naxes = self._box(), self.header.naxes
        (x0, x1, sx), (y0, _, sy), chan = box["x"], box["y"], box["chan"]
        first, last = part.x0, part.x1 or (x1 - x0) // sx + 1
        n = last - first + 1
        ranges = [(x0 + (first - 1) * sx, x0 + (last - 1) * sx, sx), (y0 + (part.y0 - 1) * sy, y0 + (part.y1 - 1) * sy, sy), *[(1, 1, 1)] * (len(naxes) - 2)]
        ranges[self.axis - 1] = chan
        columns = {}
        for name in self.names:
            with open(self.paths[name], "rb") as f:
                h = read_header(f)
                if h.naxes != naxes or h.freq_axis() != self.axis:
                    raise FitsError(f"{self.paths[name]} has another shape")
                data = read_box(f, h, Box(ranges))
            # slowest axis first: drop pinned axes, put channels last
            data = np.moveaxis(data, len(naxes) - self.axis, -1).reshape(part.y1 - part.y0 + 1, n, -1)
            columns[name] = data
        for k in range(part.y1 - part.y0 + 1):
            x, y = np.arange(first, last + 1, dtype=np.int32), np.full(n, part.y0 + k, np.int32)
            out = {"x": pa.array(x), "y": pa.array(y)}
            for name, data in columns.items():
                m = np.ascontiguousarray(data[k])
                out[name] = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel(), from_pandas=False))
            yield pa.RecordBatch.from_pydict({f.name: out[f.name] for f in self.schema})


class FitsCube(DataSource):
    """Options: q, u [, i, mask] paths; x_, y_, chan_ first, last, step; strip_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fits_cube"

    def schema(self) -> StructType:
        names = [n for n, key in (("q", "q"), ("u", "u"), ("i", "i"), ("m", "mask")) if self.options.get(key)]
        if not names:
            raise FitsError("give the path of a cube: q, u, i or mask")
        return StructType([StructField("x", IntegerType()), StructField("y", IntegerType()), *(StructField(n, ArrayType(DoubleType())) for n in names)])

    def reader(self, schema: StructType) -> CubeReader:
        return CubeReader(schema, dict(self.options))


class ImageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        with open(options["path"], "rb") as f:
            self.header = read_header(f)

    def partitions(self) -> list[Strip]:
        y0, y1, step = _range(self.options, "y", self.header.naxes[1])
        x0, x1, sx = _range(self.options, "x", self.header.naxes[0])
        nx = (x1 - x0) // sx + 1
        return strips(1, (y1 - y0) // step + 1, nx * 8, int(self.options.get("strip_bytes", STRIP_BYTES)), nx)

    def read(self, part: Strip) -> Iterator[pa.RecordBatch]:
        naxes = self.header.naxes
        (x0, x1, sx), (y0, _, sy) = _range(self.options, "x", naxes[0]), _range(self.options, "y", naxes[1])
        first, last = part.x0, part.x1 or (x1 - x0) // sx + 1
        ranges = [(x0 + (first - 1) * sx, x0 + (last - 1) * sx, sx), (y0 + (part.y0 - 1) * sy, y0 + (part.y1 - 1) * sy, sy), *[(1, 1, 1)] * (len(naxes) - 2)]
        if len(naxes) > 2:
            plane = int(self.options.get("plane", 1))
            ranges[2] = (plane, plane, 1)
        with open(self.options["path"], "rb") as f:
            data = read_box(f, self.header, Box(ranges)).reshape(part.y1 - part.y0 + 1, -1)
        for k, row in enumerate(data):
            yield pa.RecordBatch.from_pydict({"x": pa.array(np.arange(first, last + 1, dtype=np.int32)), "y": pa.array(np.full(len(row), part.y0 + k, np.int32)), "val": pa.array(row)})


class FitsImage(DataSource):
    """Options: path, plane (of a third axis), x_, y_ first, last, step."""

    @classmethod
    def name(cls) -> str:
        return "fits_image"

    def schema(self) -> str:
        return "x int, y int, val double"

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(dict(self.options))


class TableReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.header = schema, options, _table_header(options)

    def partitions(self) -> list[Strip]:
        n = int(self.header["NAXIS2"])
        return strips(0, n - 1, int(self.header["NAXIS1"])) if n else []

    def read(self, part: Strip) -> Iterator[tuple]:
        names = [f.name for f in self.schema]
        with open(self.options["path"], "rb") as f:
            columns = read_table(f, self.header, names, part.y0, part.y1 + 1)
        yield from zip(*(columns[n] for n in names), strict=True)


def _table_header(options: dict):
    with open(options["path"], "rb") as f:
        want = int(options.get("hdu", 0))
        for k, h in enumerate(headers(f)):
            if h.get("XTENSION") == "BINTABLE" and want in (0, k):
                return h
    raise FitsError("no binary table")


class FitsTable(DataSource):
    """Options: path, hdu (0: the first table), columns (comma-separated; all by default)."""

    @classmethod
    def name(cls) -> str:
        return "fits_table"

    def schema(self) -> StructType:
        kinds = {"L": BooleanType(), "B": ShortType(), "I": ShortType(), "J": IntegerType(), "K": LongType(), "E": DoubleType(), "D": DoubleType(), "A": StringType()}
        want = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([StructField(n, kinds[t] if t == "A" or k == 1 else ArrayType(kinds[t])) for n, t, k, _ in table_columns(_table_header(dict(self.options))) if not want or n in want])

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(schema, dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: pixels by row of the sky (count, sum of x, sum of x * x), and each product's data sum."""

    rows: dict[int, tuple[int, int, int]]
    sums: list[int]


@dataclass
class Product:
    """A file of known size: rows x, y (from 1) of ``column``, an array by plane or a number, land at their own bytes.

    The file is staged beside ``path`` under a name of its job's own, and gets its own name by the commit alone.
    """

    path: str
    column: str
    naxes: list[int]
    bitpix: int = -32
    cards: dict | None = None

    def __post_init__(self):
        self.kind = np.dtype(KINDS[self.bitpix])
        self.planes = int(np.prod(self.naxes[2:]))

    def head(self, datasum: int = 0) -> bytes:
        return header_bytes(primary_cards(self.bitpix, self.naxes, (self.cards or {}) | {"DATASUM": f"{datasum:<10d}"}))

    def staged(self, job: str) -> str:
        folder, name = os.path.split(self.path)
        return os.path.join(folder, f".{name}.{job}{STAGED}")

    def create(self, job: str) -> None:
        size = int(np.prod(self.naxes)) * self.kind.itemsize
        with open(self.staged(job), "xb") as f:
            f.write(self.head())
            f.truncate(f.tell() + -(-size // BLOCK) * BLOCK)

    def put(self, f, at: np.ndarray, data: np.ndarray) -> int:
        """Write planes of pixels at rising places within a plane; the sum of what was written. Neighbours go together."""
        if data.shape[1] != self.planes:
            raise FitsError(f"{self.column} has {data.shape[1]} planes, and {self.path} has {self.planes}")
        plane, base, total, size = self.naxes[0] * self.naxes[1], len(self.head()), 0, self.kind.itemsize
        cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
        with np.errstate(invalid="ignore"):
            block = np.ascontiguousarray(data.T).astype(self.kind)
        for a, z in zip(cuts, cuts[1:], strict=False):
            for k in range(self.planes):
                place = (int(at[a]) + k * plane) * size
                values = block[k, a:z].tobytes()
                f.seek(base + place)
                f.write(values)
                total += data_sum(values, place)
        return total

    def finish(self, job: str, datasum: int, overwrite: bool) -> None:
        """The data sum goes into the header, and the file gets its name; a file that has it by now is an error."""
        staged = self.staged(job)
        with open(staged, "r+b") as f:
            f.write(self.head(datasum))
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(staged, self.path)
            return
        try:
            os.link(staged, self.path)  # never over another file
        except FileExistsError:
            raise FitsError(f"{self.path} exists") from None
        except OSError:  # a file system without links
            if os.path.exists(self.path):
                raise FitsError(f"{self.path} exists") from None
            os.rename(staged, self.path)
        else:
            os.remove(staged)

    def discard(self, job: str | None = None) -> None:
        """Remove what a job has staged, or what all jobs have."""
        folder, name = os.path.split(self.path)
        names = [self.staged(job)] if job else [os.path.join(folder, n) for n in os.listdir(folder or ".") if n.startswith(f".{name}.") and n.endswith(STAGED)]
        for n in names:
            with suppress(FileNotFoundError):
                os.remove(n)


def data_sum(values: bytes, place: int) -> int:
    """The FITS data sum of bytes at ``place`` of the data; sums of parts add up (see ``folded``)."""
    before = place % 4
    padded = b"\0" * before + values + b"\0" * (-(before + len(values)) % 4)
    return int(np.frombuffer(padded, ">u4").sum(dtype=np.uint64))


def folded(total: int) -> int:
    """A sum in ones' complement of 32 bits."""
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    return total


class CubeWriter(DataSourceArrowWriter):
    """Writes all products from one pass over the rows, and commits them in two phases.

    Tasks write into staged files and tell what they wrote, by row of the sky; attempts that fail or run twice write the
    same bytes to the same places. The commit checks that every pixel was written once, puts the merged data sums into
    the headers and gives the files their names. A job that fails, or whose driver is lost, leaves no file of that name;
    what lost jobs have staged goes with the next commit of the same file.
    """

    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        if "products" in options:
            self.products = [Product(**p) for p in json.loads(options["products"])]
        else:
            cards = {k[5:].upper(): _number(v) for k, v in options.items() if k.startswith("card.")}
            column = options.get("column", next(f.name for f in schema if f.name not in ("x", "y")))
            self.products = [Product(options["path"], column, [int(n) for n in options["naxes"].split(",")], int(options.get("bitpix", -32)), cards)]
        self.overwrite, self.gaps, self.job = overwrite, str(options.get("gaps", "error")).lower() == "allow", uuid.uuid4().hex
        self.nx, self.ny = self.products[0].naxes[:2]
        for p in self.products:
            if p.naxes[:2] != [self.nx, self.ny]:
                raise FitsError(f"{p.path} has another sky than {self.products[0].path}")
            if os.path.exists(p.path) and not overwrite:
                raise FitsError(f"{p.path} exists")
        for p in self.products:
            p.create(self.job)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        rows: dict[int, np.ndarray] = {}
        sums, held, size = [0] * len(self.products), [], 0
        with ExitStack() as stack:
            files = [stack.enter_context(open(p.staged(self.job), "r+b")) for p in self.products]

            def flush() -> None:
                table = pa.Table.from_batches(held)
                x, y = (np.asarray(table[c], np.int64) for c in ("x", "y"))
                if len(x) and (x.min() < 1 or x.max() > self.nx or y.min() < 1 or y.max() > self.ny):
                    raise FitsError(f"a pixel lies outside of {self.nx} x {self.ny}")
                at = (y - 1) * self.nx + x - 1
                order = np.argsort(at, kind="stable")
                for k, (p, f) in enumerate(zip(self.products, files, strict=True)):
                    col = table[p.column].combine_chunks()
                    if pa.types.is_list(col.type):
                        flat = col.flatten().to_numpy(zero_copy_only=False)
                        if len(flat) != len(x) * p.planes:
                            raise FitsError(f"{p.column} hasn't {p.planes} planes in every row")
                        data = flat.reshape(len(x), p.planes)
                    else:
                        data = col.to_numpy(zero_copy_only=False).reshape(-1, 1)
                    sums[k] += p.put(f, at[order], data[order])
                for row in np.unique(y).tolist():
                    own = x[y == row]
                    rows[row] = rows.get(row, 0) + np.array([len(own), own.sum(), (own * own).sum()])

            for b in batches:
                held.append(b)
                size += b.nbytes
                if size >= FLUSH_BYTES:
                    flush()
                    held, size = [], 0
            if held:
                flush()
        return Written({y: tuple(map(int, v)) for y, v in rows.items()}, sums)

    def commit(self, messages: list) -> None:
        done = []
        try:
            self._whole(messages)
            for k, p in enumerate(self.products):
                p.finish(self.job, folded(sum(m.sums[k] for m in messages if m is not None)), self.overwrite)
                done.append(p)
        except BaseException:
            for p in done if not self.overwrite else ():  # of several products all are there or none
                os.remove(p.path)
            self.abort(messages)
            raise
        for p in self.products:
            p.discard()

    def _whole(self, messages: list) -> None:
        """Every pixel of every row was written, and none twice: counts and sums of x are those of 1 to nx."""
        n = self.nx
        want = np.array([n, n * (n + 1) // 2, n * (n + 1) * (2 * n + 1) // 6])
        seen = np.zeros((self.ny + 1, 3), np.int64)
        for m in messages:
            for y, v in (m.rows if m is not None else {}).items():
                seen[y] += v
        bad = np.flatnonzero((seen[1:] > want).any(1) if self.gaps else (seen[1:] != want).any(1)) + 1
        if len(bad):
            raise FitsError(f"pixels are missing or written twice in {len(bad)} of {self.ny} rows, the first of them {bad[0]}: {int(seen[bad[0]][0])} of {n}")

    def abort(self, messages) -> None:
        for p in self.products:
            p.discard(self.job)


def verified(spark, path: str, chunk: int = 4 << 20):
    """sum, stated, ok (one row): the data sum of a file, of chunks read by tasks, and what its header states."""
    from pyspark.sql import functions as F

    with open(path, "rb") as f:
        h = read_header(f)
    size = h.next_at - h.data_at

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                total = 0
                for k in b.column(0).to_pylist():
                    f.seek(h.data_at + k * chunk)
                    total += data_sum(f.read(min(chunk, size - k * chunk)), 0)
                yield pa.RecordBatch.from_arrays([pa.array([folded(total)], pa.int64())], names=["s"])

    # each part's sum is under 2^32, so 2^31 parts fit a long
    sums = spark.range(-(-size // chunk)).mapInArrow(part, "s long").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"))
    low = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftright(c, 32)
    stated = int(str(h.get("DATASUM", "-1")))
    return sums.select(low(low(F.col("s"))).alias("sum"), F.lit(stated).cast("long").alias("stated")).withColumn("ok", F.col("sum") == F.col("stated"))


def _number(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


class FitsOutput(DataSource):
    """Sink. Options: path, naxes ('nx,ny,n'), bitpix, column, card.KEY = value; or products, a JSON list of Product's fields.

    Every pixel must be given once; with gaps = allow, pixels may be missing, which are zeros.
    """

    @classmethod
    def name(cls) -> str:
        return "fits_output"

    def writer(self, schema: StructType, overwrite: bool) -> CubeWriter:
        return CubeWriter(schema, dict(self.options), overwrite)


def register(spark) -> None:
    """Make the sources known to a session."""
    for source in (FitsCube, FitsImage, FitsTable, FitsOutput):
        spark.dataSource.register(source)
