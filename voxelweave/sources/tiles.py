"""Pixels of image stacks: a data source whose partitions are tiles, and its writer.

`read_stack` scans a stack of tiles as rows (z, y, x, value).  The reader plans only tiles that the box
meets; the box comes from options and, where Spark hands filters down, from comparisons of z, y and x
with constants.  A partition is `batch` neighbouring tiles of one row of a section.  Executors open
tiles by their address: a file system path, a URI that pyarrow opens, or http(s).

A missing tile is empty, or an error where the stack must be whole (`required`).  A box without
area is an error, as is one that lies wholly outside the stack's bounds; one that lies partly outside is cut.

Tiles are grey images: PGM (P5, 8 or 16 bits) or NPY by this module, other formats by a decoder
"module:function" from bytes to an array of rows.  Integers are scaled to 0 to 1 by their largest value.
"""

from __future__ import annotations

import importlib
import io
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .stacks import NoImage, StackDescription, UsageError

SCHEMA = "z long, y long, x long, value double"
AXES = ("x", "y", "z")


def address(stack: StackDescription, z: int, row: int, col: int) -> str:
    """Of a tile, as sources.stacks.tile_url has it for columns."""
    b, e, k, (w, h) = stack.base, stack.extension, stack.scale, stack.tile
    if stack.source_type == 1:
        return f"{b}{z}/{row}_{col}_{k}.{e}"
    if stack.source_type == 4:
        return f"{b}{z}/{k}/{row}_{col}.{e}"
    if stack.source_type == 5:
        return f"{b}{k}/{z}/{row}/{col}.{e}"
    if stack.source_type == 6:  # addressed by pixels
        return f"{b}{w}_{h}/{col * w}_{row * h}_{z}/{e}"
    if stack.source_type == 8:
        return f"{b}xy/{k}/{col}_{row}_{z}"
    raise NotImplementedError(f"tile source type {stack.source_type}")


def _place(uri: str):
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def fetch(uri: str) -> bytes | None:
    """Contents, None where there is no such tile."""
    if uri.startswith(("http://", "https://")):
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(uri, timeout=60) as got:
                return got.read()
        except HTTPError as e:
            if e.code in (404, 410):
                return None
            raise
    system, path = _place(uri)
    try:
        with system.open_input_file(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def decode(data: bytes) -> np.ndarray:
    """Rows of an NPY or PGM (P5) image, integers scaled to 0 to 1."""
    if data[:6] == b"\x93NUMPY":
        image = np.load(io.BytesIO(data), allow_pickle=False)
    else:
        head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
        if not head:
            raise ValueError("neither an NPY nor a PGM (P5) image")
        w, h, most = map(int, head.groups())
        image = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h, head.end()).reshape(h, w)
        return image.astype(float) / most
    return image / np.iinfo(image.dtype).max if image.dtype.kind in "iu" else image.astype(float)


def encode(image: np.ndarray, most: int = 255) -> bytes:
    """A PGM (P5) image of values from 0 to 1, rounded to the nearest of 0 to `most`."""
    steps = np.rint(np.clip(image, 0, 1) * most).astype(">u2" if most > 255 else np.uint8)
    return f"P5\n{image.shape[1]} {image.shape[0]}\n{most}\n".encode() + steps.tobytes()


@dataclass
class Tiles(InputPartition):
    z: int
    row: int
    first: int
    last: int


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = lambda k, default: type(default)(options.get(k, default))
        self.stack = StackDescription(
            get("width", 0), get("height", 0), get("depth", 0), scale=get("scale", 0), base=options["base"], extension=get("extension", "pgm"),
            tile=(get("tilewidth", 256), get("tileheight", 256)), source_type=get("sourcetype", 1),
        )
        self.required = options.get("required", "false").lower() == "true"
        self.batch, self.decoder = get("batch", 1), options.get("decoder")
        size = (self.stack.width >> self.stack.scale, self.stack.height >> self.stack.scale, self.stack.depth)
        self.box = {a: [get(f"{a}0", 0), get(f"{a}1", n)] for a, n in zip(AXES, size)}
        if any(lo >= hi for lo, hi in self.box.values()):
            raise UsageError(f"the box {self.box} has no pixels")
        if any(hi <= 0 or lo >= n for (lo, hi), n in zip(self.box.values(), size)):
            raise NoImage(f"the box {self.box} lies outside the stack {size}")
        self.box = {a: [max(lo, 0), min(hi, n)] for (a, (lo, hi)), n in zip(self.box.items(), size)}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Narrows the box; what is compared with whole numbers needs no second look."""
        for f in filters:
            axis = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            values = list(value) if isinstance(f, In) and value else [value]
            if axis not in self.box or not all(isinstance(v, int) and not isinstance(v, bool) for v in values):
                yield f
                continue
            side = self.box[axis]
            if isinstance(f, (EqualTo, In)):
                low, high = min(values), max(values) + 1
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low, high = value + isinstance(f, GreaterThan), side[1]
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                low, high = side[0], value + isinstance(f, LessThanOrEqual)
            else:
                yield f
                continue
            self.box[axis] = [max(side[0], low), min(side[1], high)]
            if isinstance(f, In):
                yield f

    def partitions(self) -> list[Tiles]:
        (x0, x1), (y0, y1), (z0, z1) = (self.box[a] for a in AXES)
        if x0 >= x1 or y0 >= y1 or z0 >= z1:
            return []
        w, h = self.stack.tile
        cols = range(x0 // w, math.ceil(x1 / w))
        return [Tiles(z, row, c, min(c + self.batch, cols.stop)) for z in range(z0, z1) for row in range(y0 // h, math.ceil(y1 / h)) for c in range(cols.start, cols.stop, self.batch)]

    def read(self, part: Tiles | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks so where nothing is planned
            return
        (x0, x1), (y0, y1), _ = (self.box[a] for a in AXES)
        (w, h), read = self.stack.tile, decode
        if self.decoder:
            module, name = self.decoder.split(":")
            read = getattr(importlib.import_module(module), name)
        for col in range(part.first, part.last):
            uri = address(self.stack, part.z, part.row, col)
            data = fetch(uri)
            if data is None:
                if self.required:
                    raise NoImage(uri)
                continue
            image = np.asarray(read(data), float)
            left, top = col * w, part.row * h
            part_of = image[max(y0 - top, 0) : y1 - top, max(x0 - left, 0) : x1 - left]
            y, x = np.indices(part_of.shape)
            columns = [np.full(part_of.size, part.z), (y + max(y0, top)).ravel(), (x + max(x0, left)).ravel()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(part_of.ravel(), pa.float64())], names=["z", "y", "x", "value"])


class TileSource(DataSource):
    """spark.read.format("voxelweave_tiles")."""

    @classmethod
    def name(cls) -> str:
        return "voxelweave_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TileReader:
        return TileReader({k.lower(): v for k, v in self.options.items()})


def read_stack(spark: SparkSession, stack: StackDescription, box: tuple[int, int, int, int, int, int] | None = None, required: bool = False, batch: int = 1, decoder: str | None = None) -> DataFrame:
    """z, y, x, value of a stack's pixels in a box (x0, y0, z0, x1, y1, z1; upper ones exclusive)."""
    spark.dataSource.register(TileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {
        "base": stack.base, "extension": stack.extension, "scale": stack.scale, "tileWidth": stack.tile[0], "tileHeight": stack.tile[1], "sourceType": stack.source_type,
        "width": stack.width, "height": stack.height, "depth": stack.depth, "required": required, "batch": batch,
    }
    if decoder:
        options["decoder"] = decoder
    if box:
        options |= {f"{a}{k}": box[3 * k + n] for k in (0, 1) for n, a in enumerate(AXES)}
    return spark.read.format("voxelweave_tiles").options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load()


def write_stack(pixels: DataFrame, stack: StackDescription, most: int = 255) -> DataFrame:
    """Writes pixels (z, y, x, value) as PGM tiles, one a task's group, under a name of the attempt's own first; gives z, row, col and path.

    A tile without pixels isn't written; pixels that aren't given are 0.  The folder is one that all executors reach.
    """
    (w, h), wide = stack.tile, stack.width >> stack.scale
    high = stack.height >> stack.scale

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import uuid

        z, row, col = (int(pdf[c].iloc[0]) for c in ("z", "row", "col"))
        image = np.zeros((min(h, high - row * h), min(w, wide - col * w)))
        image[pdf["y"] - row * h, pdf["x"] - col * w] = pdf["value"]
        system, path = _place(address(stack, z, row, col))
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        tmp = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(tmp) as f:
            f.write(encode(image, most))
        system.move(tmp, path)
        return pd.DataFrame({"z": [z], "row": [row], "col": [col], "path": [path]})

    inside = pixels.where(F.col("x").between(0, wide - 1) & F.col("y").between(0, high - 1))
    placed = inside.select("z", "y", "x", "value", F.floor(F.col("y") / h).alias("row"), F.floor(F.col("x") / w).alias("col"))
    return placed.groupBy("z", "row", "col").applyInPandas(run, "z long, row long, col long, path string")
