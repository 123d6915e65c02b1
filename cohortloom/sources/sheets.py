"""Spreadsheet books (Office Open XML), small by nature: read and written on the driver, through Spark's file systems."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 1_048_576  # fixed value: what a sheet can hold
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def _text(node) -> str:
    """Runs of a cell's text; phonetic guides are left out."""
    return "".join(t.text or "" for part in node if part.tag in (f"{_NS}t", f"{_NS}r") for t in ([part] if part.tag == f"{_NS}t" else part.iter(f"{_NS}t")))


def _place(ref: str) -> int:
    """Column number of a cell's name, from 0."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(spark: SparkSession, path: str, sheet: int = 0) -> list[list[str]]:
    """The cells of a sheet as written, rows of equal length; dates are their serial numbers."""
    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        names = set(z.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        at = [s.get(f"{{{_OFFICE}}}id") for s in book.iter(f"{_NS}sheet")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = links[at[sheet]]
        root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    rows: list[list[str]] = []
    for r in root.iter(f"{_NS}row"):
        cells: list[str] = []
        for c in r.iter(f"{_NS}c"):
            k = _place(c.get("r")) if c.get("r") else len(cells)
            value, inline = c.find(f"{_NS}v"), c.find(f"{_NS}is")
            text = _text(inline) if inline is not None else "" if value is None else value.text or ""
            cells += [""] * (k + 1 - len(cells))
            cells[k] = shared[int(text)] if c.get("t") == "s" and text else text
        place = int(r.get("r") or len(rows) + 1)
        rows += [[] for _ in range(place - 1 - len(rows))]
        rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"<c><v>{v!r}</v></c>"
    clean = "".join(c for c in str(v) if c >= " " or c in "\t\n")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def book(sheets: dict[str, list[list]]) -> bytes:
    """A book of named sheets, each a list of rows."""
    out = io.BytesIO()
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        tabs = "".join(f'<sheet name="{escape(re.sub("[^A-Za-z0-9_ ]", "_", n)[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{_NS[1:-1]}" xmlns:r="{_OFFICE}"><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{head}<worksheet xmlns="{_NS[1:-1]}"><sheetData>' + "".join(f"<row>{''.join(map(_cell, r))}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def date_only(df: DataFrame) -> DataFrame:
    """Timestamps as dates: what a book shows."""
    return df.withColumns({c: F.to_date(F.col(f"`{c}`")) for c, t in df.dtypes if t.startswith("timestamp")})


def write_book(frames: dict[str, DataFrame], path: str, most: int = 100_000) -> None:
    """Small frames as sheets of one book; a frame of over `most` rows is refused (write it as Parquet)."""
    sheets = {}
    for name, df in frames.items():
        rows = date_only(df).limit(min(most, MOST_ROWS - 1) + 1).collect()
        if len(rows) > min(most, MOST_ROWS - 1):
            raise ValueError(f"{name} has over {most} rows")
        sheets[name] = [list(df.columns), *[[v if v is None or isinstance(v, (int, float, str)) else str(v) for v in r] for r in rows]]
        spark = df.sparkSession
    put(spark, path, book(sheets))


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content))
    out.close()
