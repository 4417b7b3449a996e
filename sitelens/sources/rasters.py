"""Raster layers: baseline TIFF to cell tables and back, and layer catalogues."""

from __future__ import annotations

import pickle
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..dims import SCALE10_BIOS
from ..operators.grid import Grid, resample
from ..shared import materialise, remove_table
from .files import binary, listing, read_range, write_chunks

#: What a raster file can address, and the most of it that is on the driver at a time.
MAX_BYTES = (1 << 32) - 1
PART_BYTES = 32 << 20
DEFAULT_BIOS = (1, 4, 12, 15)


class TooLarge(ValueError):
    """A surface that one raster file cannot hold."""


_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _tags(read: Callable[[int, int], bytes]) -> dict[int, tuple]:
    """The first directory of a TIFF file by ``read(start, size)``: nothing but the header is asked for."""
    start = read(0, 8)
    order = "<" if start[:2] == b"II" else ">"
    if struct.unpack_from(order + "H", start, 2)[0] != 42:
        raise ValueError("not a classic TIFF file")
    at = struct.unpack_from(order + "I", start, 4)[0]
    entries = struct.unpack(order + "H", read(at, 2))[0]
    data = read(at + 2, 12 * entries)
    tags: dict[int, tuple] = {0: (order,)}
    for i in range(entries):
        tag, kind, count = struct.unpack_from(order + "HHI", data, 12 * i)
        form = _SIZES.get(kind)
        if form is None:
            continue
        layout = order + form * count
        size = struct.calcsize(layout)
        value = data[12 * i + 8 : 12 * i + 8 + size] if size <= 4 else read(struct.unpack_from(order + "I", data, 12 * i + 8)[0], size)
        tags[tag] = (value[:count].split(b"\0")[0].decode("latin1"),) if kind == 2 else struct.unpack(layout, value)
    return tags


@dataclass(frozen=True)
class Layout:
    """What a header says: the grid, and where the blocks (strips or tiles) of the file are and how they are coded."""

    grid: Grid
    dtype: str
    samples: int
    packing: int
    predictor: int
    nodata: float | None
    tiled: bool
    rows: int
    cols: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    def blocks(self, window: tuple[int, int, int, int] | None = None) -> list[tuple[int, int, int]]:
        """(number, first row, first col) of the blocks that meet a window (row, col, rows, cols)."""
        g = self.grid
        r0, c0, rows, cols = window or (0, 0, g.height, g.width)
        across = -(-g.width // self.cols)
        down, right = range(r0 // self.rows, -(-(r0 + rows) // self.rows)), range(c0 // self.cols, -(-(c0 + cols) // self.cols))
        return [(i * across + j, i * self.rows, j * self.cols) for i in down for j in right]


def layout(read: Callable[[int, int], bytes]) -> Layout:
    """The layout of a stripped or tiled TIFF file."""
    t = _tags(read)
    width, height = t[256][0], t[257][0]
    bits, form = t.get(258, (1,))[0], t.get(339, (1,))[0]
    dtype = t[0][0] + {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}[(form, bits)]
    tiled = 322 in t
    cols, rows = (t[322][0], t[323][0]) if tiled else (width, min(t.get(278, (height,))[0], height))
    sx, sy = t.get(33550, (1.0, 1.0, 0.0))[:2]
    ti, tj, _, tx, ty = t.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))[:5]
    keys = t.get(34735, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    crs = f"EPSG:{codes[3072]}" if codes.get(3072, 32767) != 32767 else f"EPSG:{codes.get(2048, 4326)}"
    nodata = float(t[42113][0]) if 42113 in t else None
    offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    return Layout(Grid(sx, tx - ti * sx, -sy, ty + tj * sy, height, width, crs), dtype, t.get(277, (1,))[0], t.get(259, (1,))[0], t.get(317, (1,))[0], nodata, tiled, rows, cols, offsets, sizes)


def _unlzw(data: bytes) -> bytes:
    """Variable-width LZW with early change, most significant bit first."""
    out = bytearray()
    table: list[bytes] = []
    width, last, held, bits = 9, b"", 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decode_block(raw: bytes, how: Layout, row: int, col: int) -> np.ndarray:
    """The first band of one block as float64 with NaN, cut to the grid."""
    raw = raw if how.packing == 1 else zlib.decompress(raw) if how.packing in (8, 32946) else _unlzw(raw) if how.packing == 5 else None
    if raw is None:
        raise ValueError(f"compression {how.packing} is not supported")
    dtype = np.dtype(how.dtype)
    lines = how.rows if how.tiled else min(how.rows, how.grid.height - row)
    block = np.frombuffer(raw[: lines * how.cols * how.samples * dtype.itemsize], dtype).reshape(lines, how.cols, how.samples)
    if how.predictor == 2:
        block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
    elif how.predictor != 1:
        raise ValueError(f"predictor {how.predictor} is not supported")
    part = block[: how.grid.height - row, : how.grid.width - col, 0].astype(float)
    if how.nodata is not None:
        part[part == how.nodata] = np.nan
    return part


def read_tiff(data: bytes) -> tuple[np.ndarray, Grid, float | None]:
    """(first band as float64 with NaN, grid, stored no-data value) of a whole file in memory."""
    how = layout(lambda at, n: data[at : at + n])
    out = np.full((how.grid.height, how.grid.width), np.nan)
    for k, row, col in how.blocks():
        part = decode_block(data[how.offsets[k] : how.offsets[k] + how.sizes[k]], how, row, col)
        out[row : row + part.shape[0], col : col + part.shape[1]] = part
    return out, how.grid, how.nodata


_BLOCK = "path string, row int, col int, how binary, data binary"
_CELL = "path string, row int, col int, x double, y double, value double"


def coded_blocks(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, row, col, how, data): the blocks of raster files that meet a window (row, col, rows, cols), still coded.

    A task reads a file, takes its blocks by their offsets and decodes none.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, data = batch.column(0)[at].as_py(), memoryview(batch.column(1)[at].as_buffer())
                how = layout(lambda a, n, data=data: bytes(data[a : a + n]))
                own = pickle.dumps(replace(how, offsets=(), sizes=()))
                for k, row, col in how.blocks(window):
                    yield pa.RecordBatch.from_pydict({"path": [name], "row": pa.array([row], pa.int32()), "col": pa.array([col], pa.int32()), "how": [own], "data": [bytes(data[how.offsets[k] : how.offsets[k] + how.sizes[k]])]})

    return binary(spark, path).mapInArrow(cut, _BLOCK)


def _decoder(window: tuple[int, int, int, int] | None):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                how = pickle.loads(b["how"])
                g, part = how.grid, decode_block(b["data"], how, b["row"], b["col"])
                r0, c0, rows, cols = window or (0, 0, g.height, g.width)
                top, left = max(r0 - b["row"], 0), max(c0 - b["col"], 0)
                part = part[top : max(r0 + rows - b["row"], 0), left : max(c0 + cols - b["col"], 0)]
                for at in range(0, part.shape[0], 64):
                    v = part[at : at + 64]
                    r, c = (i.ravel() for i in np.indices(v.shape))
                    r, c, v = r + b["row"] + top + at, c + b["col"] + left, v.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([b["path"]] * len(v)), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(g.c + (c + 0.5) * g.a), pa.array(g.f + (r + 0.5) * g.e), pa.array(v, mask=np.isnan(v))], names=["path", "row", "col", "x", "y", "value"])

    return decode


def read_layer(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(path, row, col, x, y, value) of raster files, all or the cells of a window (row, col, rows, cols); no-data cells are null.

    Only blocks that meet the window leave the tasks that read files; they are
    dealt to all tasks and decoded one at a time, so neither a band nor a file is
    ever one array.
    """
    return coded_blocks(spark, path, window).repartition("path", "row", "col").mapInArrow(_decoder(window), _CELL)


def layer_grid(spark: SparkSession, path: str) -> Grid:
    """The grid of one raster file, from its header."""
    return layout(lambda at, n: read_range(spark, path, at, n)).grid


def _window_of(source: Grid, target: Grid, margin: int = 4) -> tuple[int, int, int, int] | None:
    """The window of a grid that resampling to another one needs, with a margin of its cells; none (all of it) for another system."""
    if source.crs != target.crs:
        return None
    wide, high = margin * source.a, margin * abs(source.e)
    box = (target.c - wide, target.f + target.height * target.e - high, target.c + target.width * target.a + wide, target.f + high)
    try:
        return source.window(box)
    except ValueError:  # no overlap
        return 0, 0, 1, 1


def read_stack(spark: SparkSession, layers: dict[str, str], bbox=None, reference: str | None = None, methods: dict[str, str] | None = None, divisors: dict[str, float] | None = None, grid_from: str | None = None) -> tuple[DataFrame, Grid]:
    """(cells, grid): several layers as bands of one cell table on the reference's grid (or that of the file ``grid_from``), windowed to ``bbox``.

    Layers on the same grid are joined as they are, others resampled (bilinear
    unless ``methods`` says otherwise); values are divided by ``divisors``.
    """
    first = reference or next(iter(layers))
    whole = layer_grid(spark, grid_from or layers[first])
    target = whole.crop(bbox) if bbox else whole
    out = None
    for name, path in layers.items():
        own, divisor = layer_grid(spark, path), (divisors or {}).get(name, 1.0)
        if own == whole:
            window = whole.window(bbox) if bbox else (0, 0, whole.height, whole.width)
            cells = read_layer(spark, path, window)
            part = cells.select((F.col("row") - window[0]).alias("row"), (F.col("col") - window[1]).alias("col"), (F.col("value") / divisor).alias(name))
        else:
            part = resample(read_layer(spark, path, _window_of(own, target)), own, target, "value", (methods or {}).get(name, "bilinear"), divisor).withColumnRenamed("value", name)
        out = part if out is None else out.join(part, ["row", "col"], "full")
    return out.withColumns({"x": target.x(F.col("col")), "y": target.y(F.col("row"))}), target


def lzw(data: bytes) -> bytes:
    """Variable-width LZW with early change, most significant bit first."""
    table = {bytes([i]): i for i in range(256)}
    out, held, bits, width, known = bytearray(), 256, 9, 9, 258
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        held, bits = held << width | table[word], bits + width
        table[longer] = known
        known += 1
        if known == 4095:  # the table is full: start anew
            held, bits = held << width | 256, bits + width
            table, known, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif known + 1 > 1 << width:
            width += 1
        word = data[i : i + 1]
        if bits >= 512:
            rest = bits % 8
            out += (held >> rest).to_bytes(bits // 8, "big")
            held, bits = held & ((1 << rest) - 1), rest
    if word:
        held, bits = held << width | table[word], bits + width
        known += 1
        if known + 1 > 1 << width and width < 12:
            width += 1
    held, bits = held << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (held << pad).to_bytes((bits + pad) // 8, "big")


#: Codings of a block by name: the number in the file, and the coder.
CODINGS = {"deflate": (8, zlib.compress), "lzw": (5, lzw), "none": (1, bytes)}


def tiff_header(grid: Grid, coding: str, tile: int, sizes: list[int], place: list[int]) -> bytes:
    """Header of a tiled float32 GeoTIFF with NaN as no-data: blocks of ``sizes`` follow it, tile k being block ``place[k]``."""
    code = int(grid.crs.split(":")[1])
    keys = [1, 1, 0, 2, 1024, 0, 1, 2 if grid.geographic else 1, 2048 if grid.geographic else 3072, 0, 1, code]
    starts = np.cumsum([0, *sizes])[:-1]

    def entries(first: int) -> list[tuple]:
        return [
            (256, 4, [grid.width]), (257, 4, [grid.height]), (258, 3, [32]), (259, 3, [CODINGS[coding][0]]), (262, 3, [1]), (277, 3, [1]), (322, 3, [tile]), (323, 3, [tile]),
            (324, 4, [first + int(starts[b]) for b in place]), (325, 4, [sizes[b] for b in place]), (339, 3, [3]),
            (33550, 12, [grid.a, -grid.e, 0.0]), (33922, 12, [0.0, 0.0, 0.0, grid.c, grid.f, 0.0]), (34735, 3, keys), (42113, 2, b"nan\0"),
        ]

    def packed(first: int) -> bytes:
        table, extra = entries(first), bytearray()
        body = 8 + 2 + 12 * len(table) + 4
        out = b"II*\0" + struct.pack("<IH", 8, len(table))
        for tag, kind, value in table:
            raw = value if isinstance(value, bytes) else struct.pack("<" + _SIZES[kind] * len(value), *value)
            here = raw.ljust(4, b"\0")
            if len(raw) > 4:
                here = struct.pack("<I", body + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
            out += struct.pack("<HHI", tag, kind, len(value)) + here
        return out + b"\0\0\0\0" + bytes(extra)

    size = len(packed(0))
    if size + sum(sizes) > MAX_BYTES:
        raise TooLarge(f"{size + sum(sizes)} bytes are too many for one raster file; use write_cells")
    return packed(size)


def tiff_bytes(values: np.ndarray, grid: Grid, coding: str = "deflate", tile: int = 256) -> bytes:
    """A whole GeoTIFF of an array in memory."""
    blocks = [CODINGS[coding][1](_tile(values[r : r + tile, c : c + tile], tile)) for r in range(0, grid.height, tile) for c in range(0, grid.width, tile)]
    return tiff_header(grid, coding, tile, [len(b) for b in blocks], list(range(len(blocks)))) + b"".join(blocks)


def _tile(values: np.ndarray, tile: int) -> bytes:
    whole = np.full((tile, tile), np.nan, "<f4")
    whole[: values.shape[0], : values.shape[1]] = values
    return whole.tobytes()


def coded_tiles(surface: DataFrame, grid: Grid, value: str = "value", coding: str = "lzw", tile: int = 256) -> DataFrame:
    """(tile, data): the coded tiles of a surface that have a cell, made where their cells meet; of a repeated cell the greatest value."""
    across = -(-grid.width // tile)

    @F.arrow_udf(BinaryType())
    def code(places: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for at, v in zip(places, values, strict=True):
            at, v = at.values.to_numpy(zero_copy_only=False), v.values.to_numpy(zero_copy_only=False)
            order = np.argsort(v, kind="stable")  # NaN last would win: it is no value, so there is none here
            cells = np.full(tile * tile, np.nan, "<f4")
            cells[at[order]] = v[order]
            out.append(CODINGS[coding][1](cells.tobytes()))
        return pa.array(out, pa.binary())

    inside = surface.filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    r, c = F.col("row"), F.col("col")
    placed = inside.select((F.floor(r / tile) * across + F.floor(c / tile)).alias("tile"), (r % tile * tile + c % tile).cast("int").alias("at"), F.col(value).cast("double").alias("v"))
    lists = placed.groupBy("tile").agg(F.collect_list(F.struct("at", "v")).alias("cells"))
    return lists.select("tile", code(F.col("cells.at"), F.col("cells.v")).alias("data"))


def write_layer(surface: DataFrame, grid: Grid, path: str, value: str = "value", coding: str = "lzw", tile: int = 256) -> None:
    """A surface as one tiled GeoTIFF file, of up to MAX_BYTES coded bytes (TooLarge beyond: ``write_cells``).

    Tiles are coded on executors and kept in the shared folder; their sizes give
    the header, and the file is put together from one part of PART_BYTES at a
    time.  Tiles without a cell share one blank block.
    """
    if grid.height * grid.width < tile * tile:
        tile = 16 * -(-max(grid.height, grid.width) // 16)
    coded = materialise(coded_tiles(surface, grid, value, coding, tile), "tiles")
    made = {r["tile"]: r["n"] for r in coded.select("tile", F.length("data").alias("n")).collect()}
    tiles = -(-grid.height // tile) * -(-grid.width // tile)
    blank = CODINGS[coding][1](_tile(np.empty((0, 0)), tile))
    order = sorted(made)
    number = {k: b for b, k in enumerate(order)}
    header = tiff_header(grid, coding, tile, [*(made[k] for k in order), len(blank)], [number.get(k, len(order)) for k in range(tiles)])
    parts = max(1, -(-sum(made.values()) // PART_BYTES))

    def chunks() -> Iterator[bytes]:
        yield header
        for r in coded.repartitionByRange(parts, "tile").sortWithinPartitions("tile").toLocalIterator():
            yield bytes(r["data"])
        yield blank

    write_chunks(surface.sparkSession, path, chunks())
    remove_table(coded)


def write_cells(surface: DataFrame, path: str, rows: int = 256) -> None:
    """A surface of any size as Parquet, partitioned by blocks of rows."""
    surface.withColumn("block", (F.col("row") / rows).cast("int")).write.mode("overwrite").partitionBy("block").parquet(path)


# -- catalogues ------------------------------------------------------------------------------


def _catalogue(spark: SparkSession, folder: str, bios, patterns: list[str]) -> dict[str, str]:
    names = {n.lower(): n for n in listing(spark, folder)}
    found = {}
    for n in bios:
        hit = next((names[p.format(n=n).lower()] for p in patterns if p.format(n=n).lower() in names), None)
        if hit is None:
            raise FileNotFoundError(f"no layer bio {n} in {folder}")
        found[f"bio{n}"] = f"{folder.rstrip('/')}/{hit}"
    return found


def worldclim_layers(spark: SparkSession, folder: str, bios=DEFAULT_BIOS, pattern: str = "wc2.1_10m_bio_{n}.tif") -> dict[str, str]:
    """Paths of current bioclimatic layers by band name."""
    return _catalogue(spark, folder, bios, [pattern])


def paleoclim_layers(spark: SparkSession, folder: str, bios=DEFAULT_BIOS, prefix: str = "bio_") -> dict[str, str]:
    """Paths of palaeoclimate layers, under any of three spellings."""
    return _catalogue(spark, folder, bios, [prefix + "{n}.tif", "bio{n}.tif", "bio_{n:02d}.tif"])


def worldclim_paleo_layers(spark: SparkSession, folder: str, bios=DEFAULT_BIOS, model: str = "cc", slice_key: str = "mid") -> dict[str, str]:
    """Paths of the 1.4 release's palaeo layers."""
    return _catalogue(spark, folder, bios, [f"{model}{slice_key}bi" + "{n}.tif"])


def worldclim14_divisors(bios) -> dict[str, float]:
    """What each band of the 1.4 release is divided by."""
    return {f"bio{n}": 10.0 if n in SCALE10_BIOS else 1.0 for n in bios}


def band_number(name: str) -> int:
    return int(re.sub(r"\D", "", name))
