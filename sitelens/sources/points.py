"""Point sources: shapefiles, GeoPackages, GeoJSON, delimited text and workbooks."""

from __future__ import annotations

import csv
import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import HUMAN_TAXON
from ..functions.text import guess_column, to_number
from ..operators.enrich import build_gazetteer, join_extra
from ..schema import finalise
from . import workbook
from .files import binary

# Column names that hold coordinates.
LON_NAMES = ["lon", "long", "longitude", "x", "경도", "위경도_x", "동경"]
LAT_NAMES = ["lat", "latitude", "y", "위도", "위경도_y", "북위"]

# Fixed value: the field of a point file that has the site's name.
SITE_FIELD = "유적명"

ENCODINGS = ("utf-8-sig", "cp949", "euc-kr", "utf-8")

_FIELDS = "path string, record int, x double, y double, attributes map<string,string>"


def sniff_encoding(data: bytes) -> str:
    """The first encoding that all the bytes decode in."""
    for name in ENCODINGS:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


def _file_encodings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(encoding, header) of whole files: the rank of the encoding, and the first line in it."""
    for batch in batches:
        for data in batch.column(1).to_pylist():
            encoding = sniff_encoding(data)
            first = (data.decode(encoding, "replace").splitlines() or [""])[0]
            yield pa.RecordBatch.from_arrays([pa.array([ENCODINGS.index(encoding)]), pa.array([first])], names=["encoding", "header"])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited text table of strings in whatever of the known encodings it is.

    Each file is tried whole, on the executors: its first bytes need not show its
    encoding.  UTF-8 goes to Spark's reader.  It knows no Korean encodings, so if a file of
    the path is in one, all are decoded whole, a task for each, and their lines parsed by Spark.
    """
    found = binary(spark, path).mapInArrow(_file_encodings, "encoding long, header string")
    worst = found.agg(F.max_by(F.struct("encoding", "header"), "encoding").alias("f")).first()["f"]
    if worst is None or ENCODINGS[worst["encoding"]].startswith("utf-8"):
        return spark.read.csv(path, header=True)
    names = next(csv.reader([worst["header"]]))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                rows = data.decode(sniff_encoding(data), "replace").splitlines()[1:]
                yield pa.RecordBatch.from_arrays([pa.array([r for r in rows if r.strip()], pa.string())], names=["value"])

    schema = ", ".join(f"`{n}` string" for n in names)
    return binary(spark, path).mapInArrow(lines, "value string").select(F.from_csv("value", schema).alias("r")).select("r.*")


# -- shapefiles -----------------------------------------------------------------------------


def ring_centre(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Centroid of a ring, or the mean of its points where it has no area."""
    area = cx = cy = 0.0
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        cross = x0 * y1 - x1 * y0
        area, cx, cy = area + cross, cx + (x0 + x1) * cross, cy + (y0 + y1) * cross
    if area == 0:
        return sum(p[0] for p in points) / len(points), sum(p[1] for p in points) / len(points)
    return cx / (3 * area), cy / (3 * area)


def shape_points(data: bytes) -> list[tuple[float, float] | None]:
    """A representative point of each record of a .shp file."""
    out: list[tuple[float, float] | None] = []
    at = 100
    while at + 12 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body = at + 8
        (kind,) = struct.unpack_from("<i", data, body)
        if kind in (1, 11, 21):
            out.append(struct.unpack_from("<2d", data, body + 4))
        elif kind in (8, 18, 28):
            (n,) = struct.unpack_from("<i", data, body + 36)
            own = [struct.unpack_from("<2d", data, body + 40 + 16 * i) for i in range(n)]
            out.append((sum(p[0] for p in own) / n, sum(p[1] for p in own) / n) if n else None)
        elif kind in (3, 5, 13, 15, 23, 25):
            parts, n = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), n]
            base = body + 44 + 4 * parts
            ring = [struct.unpack_from("<2d", data, base + 16 * i) for i in range(starts[0], starts[1])] if parts else []
            out.append(ring_centre(ring) if ring else None)
        else:
            out.append(None)
        at = body + 2 * words
    return out


def dbf_rows(data: bytes) -> list[dict[str, str]]:
    """Records of a .dbf file as text by field name."""
    count, start, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < start - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0], data[at + 16]))
        at += 32
    body = data[start : start + count * width]
    encoding = sniff_encoding(b"".join(n for n, _ in fields) + body)  # either may be all ASCII
    rows = []
    for k in range(count):
        record, place, row = body[k * width : (k + 1) * width], 1, {}
        for name, size in fields:
            value = record[place : place + size].decode(encoding, "replace").strip("\0 ")
            place += size
            if value:
                row[name.decode(encoding, "replace")] = value
        rows.append(row)
    return rows


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    path, record, x, y, attributes = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    kind = pa.map_(pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(record, pa.int32()), pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array([list(a.items()) for a in attributes], kind)], names=["path", "record", "x", "y", "attributes"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shp, data, table in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            points = shape_points(data)
            rows = dbf_rows(table) if table else [{}] * len(points)
            yield _emit([(shp, i, *(p or (None, None)), a) for i, (p, a) in enumerate(zip(points, rows, strict=False))])


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, x, y, attributes) of .shp files with the .dbf beside each."""
    stem = F.regexp_replace("path", r"(?i)\.[a-z]{3}$", "")
    shapes = binary(spark, path).withColumn("stem", stem)
    tables = binary(spark, path[:-4] + ".dbf").select(stem.alias("stem"), F.col("content").alias("dbf"))
    return shapes.join(tables, "stem", "left").select("path", "content", "dbf").mapInArrow(_shapes, _FIELDS)


# -- GeoPackage and GeoJSON --------------------------------------------------------------------


def geopackage_point(blob: bytes) -> tuple[float, float] | None:
    """Point of a GeoPackage geometry; the first point of other kinds."""
    size = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
    return _wkb_point(blob[8 + size :])


def _wkb_point(wkb: bytes) -> tuple[float, float] | None:
    order = "<" if wkb[0] == 1 else ">"
    kind = struct.unpack_from(order + "I", wkb, 1)[0] % 1000
    if kind == 1:
        return struct.unpack_from(order + "2d", wkb, 5)
    if kind in (4, 5, 6, 7):
        return _wkb_point(wkb[9:]) if struct.unpack_from(order + "I", wkb, 5)[0] else None
    if kind == 2:
        return struct.unpack_from(order + "2d", wkb, 9)
    if kind == 3:
        n = struct.unpack_from(order + "I", wkb, 9)[0]
        return ring_centre([struct.unpack_from(order + "2d", wkb, 13 + 16 * i) for i in range(n)]) if n else None
    return None


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with sqlite3.connect(":memory:") as db:
                db.deserialize(data)
                for table, geometry in db.execute("select table_name, column_name from gpkg_geometry_columns").fetchall():
                    found = db.execute(f'select * from "{table}"')
                    names = [c[0] for c in found.description]
                    rows = []
                    for i, r in enumerate(found):
                        own = dict(zip(names, r, strict=True))
                        blob = own.pop(geometry)
                        rows.append((path, i, *((geopackage_point(blob) if blob else None) or (None, None)), {k: str(v) for k, v in own.items() if v is not None}))
                    yield _emit(rows)


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    return binary(spark, path).mapInArrow(_packages, _FIELDS)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Point features of GeoJSON files, parsed by Spark."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("j"))
    rows = text.select("path", F.posexplode("j.features").alias("record", "f")).filter("f.geometry.type = 'Point'")
    at = F.from_json("f.geometry.coordinates", "array<double>")
    return rows.select("path", "record", F.get(at, F.lit(0)).alias("x"), F.get(at, F.lit(1)).alias("y"), F.col("f.properties").alias("attributes"))


# -- generic --------------------------------------------------------------------------------


def load_points(spark: SparkSession, path: str, lon: str | None = None, lat: str | None = None) -> DataFrame:
    """(lon, lat, attributes) of any supported point file; points without finite coordinates go."""
    ending = path.lower().rsplit(".", 1)[-1]
    if ending in ("shp", "gpkg", "geojson", "json"):
        read = {"shp": read_shapefile, "gpkg": read_geopackage}.get(ending, read_geojson)
        rows = read(spark, path).select(F.col("x").alias("lon"), F.col("y").alias("lat"), "attributes")
    elif ending in ("xlsx", "xlsm"):
        table = workbook.read_workbook(spark, path)
        rows = workbook.point_table(table, [lon] if lon else LON_NAMES, [lat] if lat else LAT_NAMES).select("lon", "lat", F.col("cells").alias("attributes"))
    elif ending in ("csv", "txt"):
        table = read_csv(spark, path)
        x, y = lon or guess_column(table.columns, LON_NAMES), lat or guess_column(table.columns, LAT_NAMES)
        if not x or not y:
            raise ValueError(f"no coordinate columns among {table.columns}")
        pairs = [c for name in table.columns for c in (F.lit(name), F.col(f"`{name}`"))]
        rows = table.select(to_number(F.col(f"`{x}`")).alias("lon"), to_number(F.col(f"`{y}`")).alias("lat"), F.create_map(*pairs).alias("attributes"))
    else:
        raise ValueError(f"no reader for .{ending} files")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.filter(finite("lon") & finite("lat"))


def attribute_table(spark: SparkSession, path: str) -> DataFrame:
    """(attributes): the rows of a delimited text or workbook, as maps of text by column name."""
    if path.lower().endswith((".xlsx", ".xlsm")):
        return workbook.read_workbook(spark, path).select(F.col("cells").alias("attributes"))
    table = read_csv(spark, path)
    return table.select(F.create_map(*(c for name in table.columns for c in (F.lit(name), F.col(f"`{name}`")))).alias("attributes"))


def join_attributes(rows: DataFrame, table: DataFrame, on: str, suffix: str = "_iso") -> DataFrame:
    """Rows with the attributes of the table's rows of the same ``on``; names that both have get ``suffix``."""
    key = lambda: F.try_element_at("attributes", F.lit(on))
    extra = table.select(key().alias("_on"), F.col("attributes").alias("_more")).filter(F.col("_on").isNotNull())
    met = rows.withColumn("_on", key()).join(extra, "_on", "left")
    fresh = F.transform_keys(F.map_filter("_more", lambda k, _: k != on), lambda k, _: F.when(F.map_contains_key("attributes", k), F.concat(k, F.lit(suffix))).otherwise(k))
    return met.withColumn("attributes", F.coalesce(F.map_concat("attributes", fresh), "attributes")).drop("_on", "_more")


def load_point_isotopes(spark: SparkSession, shapefile: str, table: str, join_on: str = "id", site: str = SITE_FIELD, values: dict[str, str] | None = None, source: str = "SHP", taxon: str = "Pig", group: str = "돼지") -> DataFrame:
    """A shapefile's sites with the isotope values of a text table, in the standard layout."""
    values = values or {"13C": "d13C_coll", "15N": "d15N_coll"}
    attribute = lambda name: F.try_element_at("attributes", F.lit(name))
    sites = read_shapefile(spark, shapefile).select(attribute(join_on).alias(join_on), attribute(site).alias("site"), F.col("x").alias("lon"), F.col("y").alias("lat"))
    extra = read_csv(spark, table).select(F.col(join_on), *(to_number(F.col(f"`{c}`")).alias(n) for c, n in values.items()))
    joined = join_extra(sites, extra, join_on)
    kind = "human" if group == HUMAN_TAXON else "animal"
    return finalise(joined.withColumns({"source": F.lit(source), "group": F.lit(kind), "taxon": F.lit(taxon), "taxon_group": F.lit(group)}))


def gazetteer_from_shapefile(spark: SparkSession, path: str, name: str, source: str = "shapefile") -> DataFrame:
    rows = read_shapefile(spark, path).select(F.try_element_at("attributes", F.lit(name)).alias("site"), F.col("y").alias("lat"), F.col("x").alias("lon"), "record")
    return build_gazetteer(rows, source, order="record")


def load_gazetteer(spark: SparkSession, path: str) -> DataFrame | None:
    """A manual gazetteer, its keys derived where missing; none if there is no file."""
    from ..functions.text import normalised_site
    from .files import exists

    if not exists(spark, path):
        return None
    t = read_csv(spark, path)
    key = F.coalesce("key", normalised_site(F.col("site"))) if "key" in t.columns else normalised_site(F.col("site"))
    source = F.coalesce("coord_source", F.lit("manual")) if "coord_source" in t.columns else F.lit("manual")
    return t.select(key.alias("key"), "site", to_number(F.col("lat")).alias("lat"), to_number(F.col("lon")).alias("lon"), source.alias("coord_source"))


def save_gazetteer(gazetteer: DataFrame, path: str) -> None:
    gazetteer.select("key", "site", "lat", "lon", "coord_source").write.mode("overwrite").csv(path, header=True)
