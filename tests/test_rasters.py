"""Raster files by blocks: headers, windows, tiles coded in parts."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators.grid import Grid
from sitelens.sources import files, rasters


def test_lzw_round_trip():
    rng = random.Random(0)
    for n in (0, 1, 2, 250, 256, 510, 511, 512, 513, 3836, 3837, 3838, 3839, 9000, 70_000):
        for data in (bytes(rng.randrange(256) for _ in range(n)), bytes(n), bytes(i * i % 251 for i in range(n))):
            assert rasters._unlzw(rasters.lzw(data)) == data


@pytest.fixture(scope="module")
def surface(spark):
    """400 x 300 cells in nine tasks, some without a value, some absent, one repeated."""
    g = Grid(0.5, 100.0, -0.5, 50.0, 400, 300)
    cells = spark.range(400 * 300, numPartitions=9).select((F.col("id") / 300).cast("int").alias("row"), (F.col("id") % 300).cast("int").alias("col"), F.when(F.col("id") % 7 != 0, F.col("id") / 8).alias("value"))
    cells = cells.filter("not (row between 128 and 255 and col between 64 and 200)")
    return g, cells.unionByName(cells.filter("row = 3 and col = 4").withColumn("value", F.lit(-1.0)))


def _expected():
    n = np.arange(400 * 300)
    v = np.where(n % 7 != 0, n / 8, np.nan).reshape(400, 300)
    v[128:256, 64:201] = np.nan
    return v


@pytest.mark.parametrize("coding", ["lzw", "deflate", "none"])
def test_tiles_round_trip(spark, surface, tmp_path, coding, monkeypatch):
    g, cells = surface
    monkeypatch.setattr(rasters, "PART_BYTES", 10_000)  # put together from many parts
    path = str(tmp_path / "s.tif")
    for _ in range(2):  # a second time in its place
        rasters.write_layer(cells, g, path, coding=coding, tile=64)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["s.tif"]
    values, got, _ = rasters.read_tiff((tmp_path / "s.tif").read_bytes())
    assert got == g and np.array_equal(values, _expected().astype("f4"), equal_nan=True)
    back = rasters.read_layer(spark, path).filter("value is not null")
    assert back.count() == np.isfinite(_expected()).sum()
    how = rasters.layout(lambda at, n: files.read_range(spark, path, at, n))
    assert len(set(how.offsets)) < len(how.offsets) == 7 * 5  # tiles without a cell share a block


def test_a_window_takes_its_blocks_alone(spark, surface, tmp_path):
    g, cells = surface
    path = str(tmp_path / "s.tif")
    rasters.write_layer(cells, g, path, tile=64)
    for window in ((0, 0, 1, 1), (63, 60, 2, 8), (130, 0, 70, 300), (399, 299, 1, 1), (0, 0, 400, 300)):
        r0, c0, rows, cols = window
        found = rasters.coded_blocks(spark, path, window)
        assert found.count() == len({(r // 64, c // 64) for r in range(r0, r0 + rows) for c in range(c0, c0 + cols)})
        got = {(r["row"], r["col"]): r["value"] for r in rasters.read_layer(spark, path, window).collect()}
        assert set(got) == {(r, c) for r in range(r0, r0 + rows) for c in range(c0, c0 + cols)}
        assert all(v is None and np.isnan(_expected()[k]) or v == np.float32(_expected()[k]) for k, v in got.items())
    # on another grid: only blocks near the target are decoded, the values are those of the whole layer
    target = Grid(0.4, 110.1, -0.4, 20.0, 10, 12)
    own = rasters.layer_grid(spark, path)
    window = rasters._window_of(own, target)
    assert window[2] * window[3] < 600
    from sitelens.operators.grid import resample

    for method in ("nearest", "bilinear", "cubic", "average"):
        near, whole = (sorted(map(tuple, resample(rasters.read_layer(spark, path, w), own, target, "value", method).select("row", "col", F.round("value", 9)).collect()), key=str) for w in (window, None))
        assert near == whole


def test_header_is_read_alone():
    g = Grid(0.5, 100.0, -0.5, 50.0, 900, 700)
    data = rasters.tiff_bytes(np.random.default_rng(0).random((900, 700)), g, tile=128)
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    assert rasters.layout(read).grid == g and sum(asked) < len(data) / 500


def _stripped(values, order, rows):
    """A file of deflated strips with a predictor, as other programs write them."""
    height, width = values.shape
    strips = []
    for at in range(0, height, rows):
        part = values[at : at + rows]
        strips.append(zlib.compress(np.diff(part, axis=1, prepend=0).astype(order + "i2").tobytes()))
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [16]), (259, 3, [8]), (273, 4, None), (277, 3, [1]), (278, 4, [rows]), (279, 4, [len(s) for s in strips]), (317, 3, [2]), (339, 3, [2]), (33550, 12, [1.0, 1.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 10.0, 20.0, 0.0]), (42113, 2, b"-999\0")]
    body = 8 + 2 + 12 * len(entries) + 4
    for first in (0, None):
        out, extra = b"", b""
        start = 0 if first == 0 else body + size
        for tag, kind, value in entries:
            value = [start + sum(map(len, strips[:k])) for k in range(len(strips))] if value is None else value
            raw = value if isinstance(value, bytes) else struct.pack(order + {3: "H", 4: "I", 12: "d"}[kind] * len(value), *value)
            here = raw.ljust(4, b"\0")
            if len(raw) > 4:
                here = struct.pack(order + "I", body + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
            out += struct.pack(order + "HHI", tag, kind, len(value)) + here
        size = len(extra)
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "IH", 8, len(entries)) + out + b"\0\0\0\0" + extra + b"".join(strips)


@pytest.mark.parametrize("order", ["<", ">"])
def test_strips_with_a_predictor(spark, tmp_path, order):
    values = np.arange(50 * 8).reshape(50, 8) % 301
    values[7, 3] = -999
    (tmp_path / "a.tif").write_bytes(_stripped(values, order, 6))
    assert rasters.coded_blocks(spark, str(tmp_path / "a.tif"), (10, 2, 3, 2)).count() == 2  # rows 10 to 12 of strips of six
    got = {(r["row"], r["col"]): r["value"] for r in rasters.read_layer(spark, str(tmp_path / "a.tif")).collect()}
    assert len(got) == 400 and got[7, 3] is None and all(v == values[k] for k, v in got.items() if k != (7, 3))


def test_surfaces_without_cells_and_too_many_bytes(spark, tmp_path, monkeypatch):
    g = Grid(1.0, 0.0, -1.0, 20.0, 20, 30)
    empty = spark.createDataFrame([], "row int, col int, value double")
    rasters.write_layer(empty, g, str(tmp_path / "e.tif"))
    assert rasters.read_layer(spark, str(tmp_path / "e.tif")).filter("value is null").count() == 600
    off = spark.createDataFrame([(-1, 0, 1.0), (0, 30, 1.0), (0, 0, float("nan")), (0, 1, None), (19, 29, 2.0)], "row int, col int, value double")
    rasters.write_layer(off, g, str(tmp_path / "o.tif"))
    assert [tuple(r)[1:3] for r in rasters.read_layer(spark, str(tmp_path / "o.tif")).filter("value is not null").collect()] == [(19, 29)]
    monkeypatch.setattr(rasters, "MAX_BYTES", 300)
    with pytest.raises(rasters.TooLarge):
        rasters.write_layer(off, g, str(tmp_path / "o.tif"))
    assert len(list(tmp_path.glob("*.tif"))) == 2


def test_more_cells_than_a_driver_would_gather(spark, tmp_path):
    g = Grid(0.001, 0.0, -0.001, 6.0, 6000, 6000)  # 36 million cells
    cells = spark.range(200_000, numPartitions=8).select((F.col("id") * 7 % 6000).cast("int").alias("row"), (F.col("id") / 40).cast("int").alias("col"), (F.col("id") % 1000).cast("double").alias("value"))
    rasters.write_layer(cells, g, str(tmp_path / "l.tif"), coding="deflate")
    window = (3000, 2000, 600, 300)
    inside = cells.filter("row between 3000 and 3599 and col between 2000 and 2299").groupBy("row", "col").agg(F.max("value").alias("value"))
    got = rasters.read_layer(spark, str(tmp_path / "l.tif"), window).filter("value is not null").select("row", "col", "value")
    assert got.count() == inside.count() > 100 and got.exceptAll(inside).count() == 0
