"""Files written from the fixtures, in the formats that the sources read."""

from __future__ import annotations

import io
import struct
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession

from .shared import shared_dir
from .sources.files import write_bytes

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _column(k: int) -> str:
    return (_column(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def xlsx_bytes(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of sheets of rows; text cells are inline, empty ones left out."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">{targets}</Relationships>')
        for i, rows in enumerate(sheets.values()):
            body = []
            for n, row in enumerate(rows, 1):
                cells = "".join(
                    f'<c r="{_column(k)}{n}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{_column(k)}{n}"><v>{v!r}</v></c>' for k, v in enumerate(row) if v is not None
                )
                body.append(f'<row r="{n}">{cells}</row>')
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def shapefile_bytes(points: list[tuple[float, float]], fields: dict[str, list[str]]) -> tuple[bytes, bytes]:
    """(.shp, .dbf) of points with text fields in the Korean encoding."""
    body = b"".join(struct.pack(">2i", i, 10) + struct.pack("<i2d", 1, x, y) for i, (x, y) in enumerate(points, 1))
    shp = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, 1, *[0.0] * 8) + body
    coded = {n.encode("cp949"): [v.encode("cp949") for v in values] for n, values in fields.items()}
    widths = [max(map(len, values), default=1) or 1 for values in coded.values()]
    dbf = struct.pack("<4BIHH20x", 3, 1, 1, 1, len(points), 32 + 32 * len(coded) + 1, 1 + sum(widths))
    for n, w in zip(coded, widths, strict=True):
        dbf += n.ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14
    rows = b"".join(b" " + b"".join(v[i].ljust(w) for v, w in zip(coded.values(), widths, strict=True)) for i in range(len(points)))
    return shp, dbf + b"\r" + rows + b"\x1a"


def written(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A new shared folder with these files."""
    folder = shared_dir(spark, "files")
    for name, data in files.items():
        write_bytes(spark, f"{folder}/{name}", data)
    return folder
