"""Rasters as cell tables: one row for each cell (row, col, x, y, bands), row 0 in the north."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.projection import transform
from .enrich import first_by, small


@dataclass(frozen=True)
class Grid:
    """A north-up grid: x = c + (col + 0.5) a, y = f + (row + 0.5) e with e < 0."""

    a: float
    c: float
    e: float
    f: float
    height: int
    width: int
    crs: str = "EPSG:4326"

    @property
    def geographic(self) -> bool:
        return self.crs == "EPSG:4326"

    def column(self, x: Column) -> Column:
        return F.floor((x - self.c) / self.a).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((self.f - y) / abs(self.e)).cast("int")

    def x(self, col: Column) -> Column:
        return self.c + (col + 0.5) * self.a

    def y(self, row: Column) -> Column:
        return self.f + (row + 0.5) * self.e

    def window(self, bbox: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
        """(row_from, col_from, rows, cols) of a box: offsets and lengths are rounded, then cut to the grid."""
        x0, y0, x1, y1 = bbox
        col, row = round((x0 - self.c) / self.a), round((self.f - y1) / abs(self.e))
        cols, rows = round((x1 - x0) / self.a), round((y1 - y0) / abs(self.e))
        r0, c0 = max(row, 0), max(col, 0)
        r1, c1 = min(row + rows, self.height), min(col + cols, self.width)
        if r1 <= r0 or c1 <= c0:
            raise ValueError("the box lies outside the grid")
        return r0, c0, r1 - r0, c1 - c0

    def crop(self, bbox: tuple[float, float, float, float]) -> Grid:
        r0, c0, rows, cols = self.window(bbox)
        return Grid(self.a, self.c + c0 * self.a, self.e, self.f + r0 * self.e, rows, cols, self.crs)

    def cell_metres(self) -> tuple[float, float]:
        """Cell width and height in metres at the grid's centre."""
        if not self.geographic:
            return abs(self.a), abs(self.e)
        lat = self.f + self.height / 2 * self.e
        return abs(self.a) * 111320 * math.cos(math.radians(lat)), abs(self.e) * 110540


def crop(cells: DataFrame, grid: Grid, bbox: tuple[float, float, float, float]) -> tuple[DataFrame, Grid]:
    """Cells of a box, renumbered; the row and col ranges reach the scan as pushed filters."""
    r0, c0, rows, cols = grid.window(bbox)
    inside = cells.filter(F.col("row").between(r0, r0 + rows - 1) & F.col("col").between(c0, c0 + cols - 1))
    return inside.withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0}), grid.crop(bbox)


def to_crs(df: DataFrame, crs: str, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points from longitude and latitude to a grid's system, any with a closed form in ``functions.projection``."""
    if crs == "EPSG:4326":
        return df
    px, py = transform(F.col(x), F.col(y), "EPSG:4326", crs)
    return df.withColumns({x: px, y: py})


def geographic_bounds(spark, grid: Grid, points: int = 21) -> DataFrame:
    """One row (lon_min, lat_min, lon_max, lat_max): the box in degrees around a grid's edges."""
    at = spark.range(points).select((F.col("id") / (points - 1)).alias("t"))
    x0, x1, y0, y1 = grid.c, grid.c + grid.width * grid.a, grid.f + grid.height * grid.e, grid.f
    along = lambda a, b: F.lit(float(a)) + F.col("t") * (b - a)
    sides = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((along(x0, x1), F.lit(y0)), (along(x0, x1), F.lit(y1)), (F.lit(x0), along(y0, y1)), (F.lit(x1), along(y0, y1)))))
    lon, lat = transform(F.col("s.x"), F.col("s.y"), grid.crs, "EPSG:4326")
    edge = at.select(F.explode(sides).alias("s")).select(lon.alias("lon"), lat.alias("lat"))
    return edge.agg(F.min("lon").alias("lon_min"), F.min("lat").alias("lat_min"), F.max("lon").alias("lon_max"), F.max("lat").alias("lat_max"))


def valid_cells(cells: DataFrame, bands: list[str]) -> DataFrame:
    """Cells with a value in every band."""
    return cells.dropna("any", subset=bands)


def subset(cells: DataFrame, bands: list[str]) -> DataFrame:
    return cells.select("row", "col", "x", "y", *bands)


def add_band(cells: DataFrame, layer: DataFrame, name: str) -> DataFrame:
    """A (row, col, value) layer as a further band; cells that it lacks are null."""
    return cells.join(layer.select("row", "col", F.col("value").alias(name)), ["row", "col"], "left")


def point_cells(points: DataFrame, grid: Grid, x: str = "lon", y: str = "lat") -> DataFrame:
    """Points with the row and col of their cell."""
    return points.withColumns({"row": grid.row(F.col(y)), "col": grid.column(F.col(x))})


def extract(points: DataFrame, cells: DataFrame, grid: Grid, bands: list[str], x: str = "lon", y: str = "lat") -> DataFrame:
    """Points with the bands of their cell; points off the grid or with a missing band go."""
    return point_cells(points, grid, x, y).join(valid_cells(cells.select("row", "col", *bands), bands), ["row", "col"])


def thin_by_cell(points: DataFrame, order: str) -> DataFrame:
    """The first point of each cell."""
    return first_by(points, ["row", "col"], [F.col(order)])


def presence_matrix(points: DataFrame, cells: DataFrame, grid: Grid, bands: list[str], order: str = "site") -> DataFrame:
    """Band values at points, one point for each cell; x and y are the cell's centre."""
    thinned = thin_by_cell(extract(points, cells, grid, bands), order)
    return thinned.withColumns({"x": grid.x(F.col("col")), "y": grid.y(F.col("row"))})


def hash_rank(seed: int, *keys: str) -> Column:
    """A repeatable random order of cells."""
    return F.xxhash64(F.lit(seed), *keys)


def lcg_rank(seed: int) -> Column:
    """A repeatable order by integer arithmetic alone, alike in every engine."""
    mixed = (F.col("row").cast("long") * 73856093 + F.col("col").cast("long") * 19349663 + F.lit(seed)) % 2147483647
    return (mixed * 48271 + 11) % 2147483647


def sample_background(cells: DataFrame, n: int, bands: list[str], seed: int = 42, bias: Column | None = None, rank: Column | None = None) -> DataFrame:
    """``n`` random valid cells (or all, if fewer), where ``bias`` holds; a top-k by hash, so no full sort."""
    pool = valid_cells(cells, bands)
    if bias is not None:
        pool = pool.filter(bias)
    return pool.orderBy(hash_rank(seed, "row", "col") if rank is None else rank, "row", "col").limit(n)


def sampling_effort(points: DataFrame, grid: Grid, x: str = "lon", y: str = "lat") -> DataFrame:
    """(row, col, effort): records of the whole target group in each cell that has any; what was looked for where."""
    located = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    inside = point_cells(located, grid, x, y).filter(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))
    return inside.groupBy("row", "col").agg(F.count(F.lit(1)).alias("effort"))


def target_background(cells: DataFrame, effort: DataFrame, n: int, bands: list[str], seed: int = 42, rank: Column | None = None, ranks: int = 1 << 31) -> DataFrame:
    """``n`` valid cells drawn without replacement, with chances by their effort (cells without any are not drawn); with ``effort``.

    Background that is as uneven as the search for the species cancels the
    search.  Each cell gets an exponential key of rate ``effort``; the n smallest keys
    are such a draw: a top-k, no full sort.  ``rank`` is a repeatable random number
    from 0 to below ``ranks``.
    """
    place = F.pmod(hash_rank(seed, "row", "col"), F.lit(ranks)) if rank is None else rank
    pool = valid_cells(cells, bands).join(effort.filter("effort > 0"), ["row", "col"])
    key = -F.log((place + 0.5) / float(ranks)) / F.col("effort")
    return pool.orderBy(key, "row", "col").limit(n)


def resample(source: DataFrame, source_grid: Grid, target: Grid, band: str, method: str = "bilinear", divisor: float = 1.0) -> DataFrame:
    """(row, col, value) of a band on another grid, of the same system or another: nearest, bilinear, cubic or average."""
    spark = source.sparkSession
    if method == "average":
        x, y = transform(F.col("x"), F.col("y"), source_grid.crs, target.crs)
        placed = source.select(target.row(y).alias("row"), target.column(x).alias("col"), F.col(band).alias("v"))
        inside = placed.filter(F.col("row").between(0, target.height - 1) & F.col("col").between(0, target.width - 1))
        return inside.groupBy("row", "col").agg((F.avg("v") / divisor).alias("value"))
    cells = spark.range(target.height * target.width).select((F.col("id") / target.width).cast("int").alias("row"), (F.col("id") % target.width).cast("int").alias("col"))
    x, y = transform(target.x(F.col("col")), target.y(F.col("row")), target.crs, source_grid.crs)
    at = cells.withColumns({"_fr": (source_grid.f - y) / abs(source_grid.e), "_fc": (x - source_grid.c) / source_grid.a})
    known = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(band).alias("v"))
    if method == "nearest":
        near = at.withColumns({"_r": F.floor("_fr").cast("int"), "_c": F.floor("_fc").cast("int")})
        return near.join(known, ["_r", "_c"], "left").select("row", "col", (F.col("v") / divisor).alias("value"))
    if method not in ("bilinear", "cubic"):
        raise ValueError(f"method must be nearest, bilinear, cubic or average, not {method!r}")
    reach = (0, 1) if method == "bilinear" else (-1, 0, 1, 2)
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach)))
    spread = at.withColumns({"_r0": F.floor(F.col("_fr") - 0.5).cast("int"), "_c0": F.floor(F.col("_fc") - 0.5).cast("int")}).withColumn("_k", corner)
    kernel = _linear if method == "bilinear" else _cubic
    away = lambda f, c0, k: F.abs(F.col(f) - 0.5 - F.col(c0) - F.col(k))
    weight = kernel(away("_fr", "_r0", "_k.i")) * kernel(away("_fc", "_c0", "_k.j"))
    near = spread.select("row", "col", (F.col("_r0") + F.col("_k.i")).alias("_r"), (F.col("_c0") + F.col("_k.j")).alias("_c"), weight.alias("w"))
    found = near.join(known, ["_r", "_c"], "left").withColumn("w", F.when(F.col("v").isNotNull(), F.col("w")))
    return found.groupBy("row", "col").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0)) / divisor).alias("value"))


def _linear(d: Column) -> Column:
    return F.greatest(1 - d, F.lit(0.0))


def _cubic(d: Column) -> Column:
    """Cubic convolution with a = -1/2."""
    return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(0.0)


def stack_slices(slices: dict[str, DataFrame]) -> DataFrame:
    """Cell tables of several times as one, with the column ``slice``."""
    return reduce(lambda a, b: a.unionByName(b), (cells.withColumn("slice", F.lit(name)) for name, cells in slices.items()))


def compare_window(whole: DataFrame, part: DataFrame, row_from: int, col_from: int) -> DataFrame:
    """(row, col, whole, part) where a regional surface overlaps its window of a larger one."""
    shifted = whole.select((F.col("row") - row_from).alias("row"), (F.col("col") - col_from).alias("col"), F.col("value").alias("whole"))
    return shifted.join(part.select("row", "col", F.col("value").alias("part")), ["row", "col"])


def cell_area_km2(grid: Grid, y: Column) -> Column:
    """Area of a cell: by its latitude on a geographic grid, else constant."""
    if grid.geographic:
        return F.lit(abs(grid.a)) * 111.32 * F.cos(F.radians(y)) * abs(grid.e) * 110.57
    return F.lit(abs(grid.a * grid.e) / 1e6)


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return df.join(small(table), key, "left")
