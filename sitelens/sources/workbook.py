"""Spreadsheet workbooks (xlsx) by their zip and XML parts, as rows of text cells."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import date_range, guess_column, is_number, region_name, to_number, with_human, taxon_group
from ..operators.enrich import calendar_to_bp, merge_apatite
from ..schema import finalise
from ..shared import materialise
from .files import binary

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column_number(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _elements(stream, name: str) -> Iterator[ElementTree.Element]:
    """The elements of a name, one at a time: each is taken out of the tree when the next is asked for."""
    path: list[ElementTree.Element] = []
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            path.append(node)
            continue
        path.pop()
        if node.tag == f"{_MAIN}{name}":
            yield node
            if path:
                path[-1].clear()


def workbook_rows(data: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of every row that has a cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as stream:
                shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in _elements(stream, "si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PKG}Relationship")}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")]
            part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            with z.open(part) as stream:
                number = 0
                for node in _elements(stream, "row"):
                    number = int(node.get("r") or number + 1)
                    cells: list[str | None] = []
                    for cell in node.iter(f"{_MAIN}c"):
                        at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                        if kind == "inlineStr":
                            cells[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
                        elif value is not None and value.text is not None:
                            cells[at] = shared[int(value.text)] if kind == "s" else value.text
                    if any(c not in (None, "") for c in cells):
                        yield sheet.get("name"), number, cells


#: Rows of a batch that the parser gives back; it holds no more of a workbook than these.
BATCH = 5_000


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.map_(pa.string(), pa.string())
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array([list(dict(r).items()) for r in columns[3]], kind)], names=["path", "sheet", "row", "cells"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            headers: dict[str, list[str]] = {}
            rows: list[tuple] = []
            for sheet, number, cells in workbook_rows(data):
                if sheet not in headers:
                    headers[sheet] = [str(c) if c is not None else "" for c in cells]
                    continue
                rows.append((path, sheet, number, [(h, c) for h, c in zip(headers[sheet], cells, strict=False) if h and c not in (None, "")]))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells): each sheet's rows as maps from header to text; empty cells are left out."""
    return binary(spark, path).mapInArrow(_parse, "path string, sheet string, row long, cells map<string,string>")


def cell(*names: str) -> Column:
    """The first of some headers that a row has a value for."""
    return F.coalesce(*(F.try_element_at("cells", F.lit(n)) for n in names))


_PLACE = {
    "site": ("Site Name",),
    "region": ("Province",),
    "culture": ("Culture/Chronology",),
}


def _regional_base(rows: DataFrame, group: str) -> DataFrame:
    taxon = F.lit("Human") if group == "human" else cell("Common Name", "Genus&Species")
    return rows.select(
        F.lit("China DB").alias("source"),
        F.lit(group).alias("group"),
        *(cell(*names).alias(name) for name, names in _PLACE.items()),
        to_number(cell("Latitude")).alias("lat"),
        to_number(cell("Longitude")).alias("lon"),
        to_number(cell("Estimated Year  Upper (BP)")).alias("bp_upper"),
        to_number(cell("Estimated Year Lower (BP)")).alias("bp_lower"),
        cell("Sample ID").alias("sample_id"),
        taxon.alias("taxon"),
        F.struct("path", "sheet", "row").alias("ord"),
        "cells",
    )


def load_regional_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The four-sheet regional workbook in the standard layout: collagen rows with their apatite values, then the other apatite rows."""
    rows = materialise(read_workbook(spark, path), "workbook")  # parsed once, read by sheet
    collagen = [_regional_base(rows.filter(F.col("sheet") == s), g) for s, g in (("Human organic materials", "human"), ("Animal organic materials", "animal"))]
    apatite = [_regional_base(rows.filter(F.col("sheet") == s), g) for s, g in (("Human bioapatite", "human"), ("Animal bioapatite", "animal"))]
    organic = collagen[0].unionByName(collagen[1]).select("*", to_number(cell("δ13C (‰, VPDB)")).alias("d13C_coll"), to_number(cell("δ15N (‰, AIR)")).alias("d15N_coll"), to_number(cell("Atomic C:N Ratio")).alias("CN")).drop("cells")
    mineral = apatite[0].unionByName(apatite[1]).select("*", to_number(cell("δ13CCarbonate (‰, VPDB)", "δ13C Carbonate (‰, VPDB)")).alias("d13C_ap"), to_number(cell("δ18OCarbonate (‰, VPDB)", "δ18O Carbonate (‰, VPDB)")).alias("d18O_ap")).drop("cells")
    merged = merge_apatite(organic, mineral)
    return finalise(merged.withColumn("taxon_group", with_human(F.col("group"), taxon_group(F.col("taxon")))))


def load_eurasian_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The one-sheet Eurasian workbook in the standard layout; calendar years become years BP."""
    rows = read_workbook(spark, path)
    if sheet:
        rows = rows.filter(F.col("sheet") == sheet)
    up, low = calendar_to_bp(to_number(cell("Min age (95%)")), to_number(cell("Max age (95%)")))
    human = F.lower(F.coalesce(cell("Species"), F.lit(""))).contains("homo")
    out = rows.select(
        F.lit("IsoMemo").alias("source"),
        F.when(human, "human").otherwise("animal").alias("group"),
        cell("Site name").alias("site"),
        to_number(cell("Latitude")).alias("lat"),
        to_number(cell("Longitude")).alias("lon"),
        cell("Country").alias("region"),
        cell("Archae. Culture").alias("culture"),
        up.alias("bp_upper"),
        low.alias("bp_lower"),
        cell("Common name", "Species").alias("taxon"),
        to_number(cell("delta 13C coll")).alias("d13C_coll"),
        to_number(cell("delta 15N coll")).alias("d15N_coll"),
        to_number(cell("C/N")).alias("CN"),
        to_number(cell("delta 13C carb bioap")).alias("d13C_ap"),
        to_number(cell("delta 18O carb bioap")).alias("d18O_ap"),
    )
    return finalise(out.withColumn("taxon_group", with_human(F.col("group"), taxon_group(F.col("taxon")))))


#: Headers of the local table, spelled as they are found in it.
LOCAL_HEADERS = {
    "region": ["region"],
    "culture": ["culture"],
    "period": ["period"],
    "date": ["date"],
    "lat": ["lattitude", "latitude"],
    "lon": ["longtidue", "longitude"],
    "site": ["site"],
    "form": ["feature form"],
    "species": ["spieces", "species"],
    "d13c": ["δ13c"],
    "d15n": ["δ15n"],
}


def repair_local_rows(rows: DataFrame) -> DataFrame:
    """The local table's two layouts in one: a row whose latitude cell is no number holds site, species and values further left.

    ``rows`` has the text columns of LOCAL_HEADERS.  Rows without any isotope value go.
    """
    shifted = F.col("lat").isNotNull() & (F.trim("lat") != "") & ~is_number(F.col("lat"))
    pick = lambda moved, normal: F.when(shifted, moved).otherwise(normal)
    none = F.lit(None).cast("double")
    dated = date_range(F.coalesce("date", "period"))
    species = pick(F.col("site"), F.col("species"))
    out = rows.select(
        F.lit("Local").alias("source"),
        F.when(F.lower(F.coalesce(species, F.lit(""))).contains("homo") | F.lower(F.coalesce(species, F.lit(""))).contains("human"), "human").otherwise("animal").alias("group"),
        pick(F.col("lat"), F.col("site")).alias("site"),
        pick(none, to_number(F.col("lat"))).alias("lat"),
        pick(none, to_number(F.col("lon"))).alias("lon"),
        region_name(F.col("region")).alias("region"),
        "culture",
        dated["bp_upper"].alias("bp_upper"),
        dated["bp_lower"].alias("bp_lower"),
        species.alias("taxon"),
        pick(to_number(F.col("form")), to_number(F.col("d13c"))).alias("d13C_coll"),
        pick(to_number(F.col("species")), to_number(F.col("d15n"))).alias("d15N_coll"),
        pick(to_number(F.col("d13c")), none).alias("CN"),
        F.col("period").alias("period_text"),
        F.col("date").alias("date_text"),
    )
    kept = out.filter(F.col("d13C_coll").isNotNull() | F.col("d15N_coll").isNotNull())
    grouped = kept.withColumn("taxon_group", with_human(F.col("group"), taxon_group(F.col("taxon"))))
    standard = finalise(grouped.withColumn("bp_mid", (F.col("bp_upper") + F.col("bp_lower")) / 2).drop("period_text", "date_text"))
    return standard


def load_local_table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The local research workbook in the standard layout."""
    rows = read_workbook(spark, path)
    if sheet:
        rows = rows.filter(F.col("sheet") == sheet)
    lower = F.transform_keys("cells", lambda k, _: F.lower(F.trim(k)))
    keyed = rows.select(lower.alias("cells"))
    return repair_local_rows(keyed.select(*(F.coalesce(*(F.try_element_at("cells", F.lit(h)) for h in headers)).alias(name) for name, headers in LOCAL_HEADERS.items())))


def headers(rows: DataFrame) -> list[str]:
    """Distinct headers of a workbook's rows."""
    return [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().orderBy("col").collect()]


def point_table(rows: DataFrame, lon: list[str], lat: list[str]) -> DataFrame:
    """Workbook rows with lon and lat from the headers that look like them."""
    names = headers(rows)
    x, y = guess_column(names, lon), guess_column(names, lat)
    if not x or not y:
        raise ValueError(f"no coordinate headers among {names}")
    return rows.select("cells", to_number(cell(x)).alias("lon"), to_number(cell(y)).alias("lat"))
