"""Files written by hand and read back."""

import json
import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators.grid import Grid
from sitelens.sources import files, points, rasters, sinks, workbook


def _xlsx(path, sheets):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        shared = sorted({v for rows in sheets.values() for r in rows for v in r if isinstance(v, str)})
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s.replace('&', '&amp;')}</t></si>" for s in shared) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            body = ""
            for n, r in enumerate(rows, 1):
                cells = "".join(f'<c r="{chr(65 + k)}{n}" t="s"><v>{shared.index(v)}</v></c>' if isinstance(v, str) else f'<c r="{chr(65 + k)}{n}"><v>{v}</v></c>' for k, v in enumerate(r) if v is not None)
                body += f'<row r="{n}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


_BASE = ["Site Name", "Province", "Culture/Chronology", "Sample ID", "Latitude", "Longitude", "Estimated Year  Upper (BP)", "Estimated Year Lower (BP)"]


def test_regional_workbook(spark, tmp_path):
    base = ["S1", "Jilin", "Han Dynasty", "X1", 43.5, 126.0, 2100, 2000]
    _xlsx(
        tmp_path / "r.xlsx",
        {
            "Human organic materials": [[*_BASE, "δ13C (‰, VPDB)", "δ15N (‰, AIR)", "Atomic C:N Ratio"], [*base, -18.5, 9.1, 3.2]],
            "Animal organic materials": [[*_BASE, "Common Name", "Genus&Species", "δ13C (‰, VPDB)", "δ15N (‰, AIR)", "Atomic C:N Ratio"], [*base[:3], "X2", *base[4:], None, "Sus scrofa", -20, 6, "n/a"]],
            "Human bioapatite": [[*_BASE, "δ13C Carbonate (‰, VPDB)", "δ18O Carbonate (‰, VPDB)"], [*base, -9.5, -7]],
            "Animal bioapatite": [[*_BASE, "Common Name", "δ13CCarbonate (‰, VPDB)", "δ18OCarbonate (‰, VPDB)"], [*base[:3], "X9", *base[4:], "Pig", -11, -8]],
        },
    )
    rows = sorted(workbook.load_regional_workbook(spark, str(tmp_path / "r.xlsx")).collect(), key=lambda r: (r["group"], r["d13C_coll"] is None))
    assert [(r["group"], r["taxon_group"], r["d13C_coll"], r["d13C_ap"], r["CN"]) for r in rows] == [("animal", "돼지", -20.0, None, None), ("animal", "돼지", None, -11.0, None), ("human", "사람", -18.5, -9.5, 3.2)]
    assert rows[-1]["bp_mid"] == 2050.0


def test_eurasian_workbook(spark, tmp_path):
    head = ["Site name", "Country", "Species", "Latitude", "Longitude", "Min age (95%)", "Max age (95%)", "delta 13C coll"]
    _xlsx(tmp_path / "e.xlsx", {"data": [head, ["K", "Mongolia", "Homo sapiens", 47, 106, -500, -300, -17]]})
    r = workbook.load_eurasian_workbook(spark, str(tmp_path / "e.xlsx")).first()
    assert (r["group"], r["bp_upper"], r["bp_lower"], r["taxon_group"]) == ("human", 2450.0, 2250.0, "사람")


def test_local_table_shift(spark, tmp_path):
    head = ["Region", "culture", "period", "date", "lattitude", "longtidue", "site", "feature form", "spieces", "sex", "age", "δ13C", "δ15N"]
    _xlsx(tmp_path / "l.xlsx", {"s": [head, ["primorye", "c", "p", "398–494 AD", 43, 132, "A", "pit", "pig", None, None, -19, 8], ["amur", "c", "p", "398–494 AD", "Site B", None, "dog", -20, 7, None, None, 3.3, None], ["amur", "c", "p", None, 50, 127, "C", None, "pig", None, None, None, None]]})
    rows = {r["site"]: r for r in workbook.load_local_table(spark, str(tmp_path / "l.xlsx")).collect()}
    assert set(rows) == {"A", "Site B"}
    assert (rows["A"]["region"], rows["A"]["bp_upper"], rows["A"]["d13C_coll"]) == ("Primorye", 1552.0, -19.0)
    b = rows["Site B"]
    assert (b["lat"], b["taxon"], b["d13C_coll"], b["d15N_coll"], b["CN"]) == (None, "dog", -20.0, 7.0, 3.3)


def _shapefile(path, sites):
    body = b""
    for i, (x, y, _) in enumerate(sites, 1):
        body += struct.pack(">2i", i, 10) + struct.pack("<i2d", 1, x, y)
    path.with_suffix(".shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8) + body)
    fields = [("id", 4), ("유적명", 12)]
    head = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(sites), 32 + 32 * len(fields) + 1, 1 + sum(w for _, w in fields))
    for n, w in fields:
        head += n.encode("cp949").ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14
    rows = b"".join(b" " + str(i).encode().ljust(4) + n.encode("cp949").ljust(12) for i, (_, _, n) in enumerate(sites, 1))
    path.with_suffix(".dbf").write_bytes(head + b"\r" + rows + b"\x1a")


def test_shapefile_and_table(spark, tmp_path):
    _shapefile(tmp_path / "p", [(126.0, 43.5, "가나"), (127.0, 44.0, "다라")])
    (tmp_path / "v.csv").write_bytes("id,13C,15N\n1,-18.2,7\n2,x,6\n".encode("cp949"))
    rows = sorted(points.load_point_isotopes(spark, str(tmp_path / "p.shp"), str(tmp_path / "v.csv")).collect(), key=lambda r: r["lon"])
    assert [(r["lon"], r["d13C_coll"], r["taxon_group"]) for r in rows] == [(126.0, -18.2, "돼지"), (127.0, None, "돼지")]
    assert points.load_points(spark, str(tmp_path / "p.shp")).count() == 2
    assert points.gazetteer_from_shapefile(spark, str(tmp_path / "p.shp"), "id").count() == 2


def test_csv_encodings(spark, tmp_path):
    for name, encoding in (("a", "utf-8-sig"), ("b", "cp949"), ("c", "utf-8")):
        (tmp_path / f"{name}.csv").write_bytes("경도,위도,이름\n126.5,43,가\n,1,나\n".encode(encoding))
        got = points.load_points(spark, str(tmp_path / f"{name}.csv")).collect()
        assert len(got) == 1 and got[0]["lon"] == 126.5 and "가" in got[0]["attributes"].values()


def test_geojson_and_geopackage(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [126.5, 43.0]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    assert points.load_points(spark, str(tmp_path / "a.geojson")).first()["lat"] == 43.0
    with sqlite3.connect(tmp_path / "a.gpkg") as db:
        db.execute("create table gpkg_geometry_columns(table_name text, column_name text)")
        db.execute("insert into gpkg_geometry_columns values ('t', 'geom')")
        db.execute("create table t(id integer, geom blob)")
        db.execute("insert into t values (1, ?)", (b"GP\0\1" + struct.pack("<i", 4326) + b"\1" + struct.pack("<I2d", 1, 126.5, 43.0),))
    db.close()
    assert points.load_points(spark, str(tmp_path / "a.gpkg")).first()["lon"] == 126.5
    with pytest.raises(ValueError):
        points.load_points(spark, str(tmp_path / "a.doc"))


def test_tiff_round_trip(spark, tmp_path):
    g = Grid(0.5, 100.0, -0.5, 50.0, 7, 9)
    values = np.arange(63, dtype="f4").reshape(7, 9)
    values[2, 3] = np.nan
    for name in ("bio_1.tif", "bio_4.tif"):
        (tmp_path / name).write_bytes(rasters.tiff_bytes(values, g))
    layers = rasters.paleoclim_layers(spark, str(tmp_path), (1, 4))
    cells, got = rasters.read_stack(spark, layers, divisors={"bio1": 10.0})
    assert got == g and cells.count() == 63
    r = cells.filter("row = 1 and col = 2").first()
    assert (r["bio4"], r["x"], r["y"]) == (11.0, 101.25, 49.25) and abs(r["bio1"] - 1.1) < 1e-6
    window, small = rasters.read_stack(spark, layers, bbox=(101.0, 48.0, 103.0, 49.0))
    assert (small.height, small.width) == (2, 4) and window.count() == 8
    rasters.write_layer(cells.select("row", "col", F.col("bio4").alias("value")), g, str(tmp_path / "out.tif"))
    again, _, _ = rasters.read_tiff((tmp_path / "out.tif").read_bytes())
    assert np.array_equal(again, values.astype(float), equal_nan=True)
    with pytest.raises(FileNotFoundError):
        rasters.worldclim_layers(spark, str(tmp_path), (1,))


def test_lzw():
    codes, bits = [256, 65, 66, 258, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert rasters._unlzw(data) == b"ABAB"


def test_sinks(spark, tmp_path):
    t = spark.createDataFrame([(1, float("nan"), "m"), (2, 0.5, "m")], "id int, v double, model string")
    assert json.loads(sinks.table_json(t)) == {"columns": ["id", "v"], "rows": [[1, None], [2, 0.5]]}
    sinks.write_csv(t, str(tmp_path / "t"), bom=True)
    assert files.exists(spark, str(tmp_path / "t"))
    sinks.write_summary(spark, {"n": 1}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"n": 1}
    assert files.status(spark, {"a": [str(tmp_path / "no"), str(tmp_path / "s.json")]}).first()["found"]
