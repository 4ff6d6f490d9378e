"""Workbooks (.xlsx) as tables of cells and back.

Reading: every workbook of a path is one task, which gives its cells as rows; a sheet then is a pivot over the columns of its header row.
Writing: one file has one writer, which takes the rows of all sheets in order as a stream; a sheet holds at most 1,048,576 rows.
"""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system

MOST_ROWS = 1_048_576
CELLS = "path string, sheet string, row int, col int, value string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(ref: str) -> int:
    """A is 1."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def column_name(n: int) -> str:
    out = ""
    while n:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


def cells_of(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of every cell with a value; numbers as they are written, dates as serial numbers."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for _, e in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if e.tag == _MAIN + "si":
                    shared.append("".join(t.text or "" for t in e.iter(_MAIN + "t")))
                    e.clear()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            for _, e in ElementTree.iterparse(z.open(target if target.startswith("xl/") else f"xl/{target}")):
                if e.tag != _MAIN + "row":
                    continue
                for c in e.iter(_MAIN + "c"):
                    kind, v = c.get("t"), c.find(_MAIN + "v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                    elif v is None or v.text is None or kind == "e":
                        continue
                    else:
                        value = shared[int(v.text)] if kind == "s" else ("true" if v.text == "1" else "false") if kind == "b" else v.text
                    ref = c.get("r")
                    yield sheet.get("name"), int(ref[len(re.match(r"[A-Z]+", ref)[0]) :]), column_number(ref), value
                e.clear()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of one workbook, or of all workbooks of a folder or pattern: path, sheet, row, col, value."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for cell in cells_of(data):
                    rows.append((name, *cell))
                    if len(rows) >= 100_000:
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value"]).astype({"row": "int32", "col": "int32"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, CELLS)


def read_sheet(cells: DataFrame, name: str) -> DataFrame | None:
    """A sheet as a table of strings named by its first row; None if it is missing or has no rows. A sheet has at most 16,384 columns."""
    own = cells.where(F.col("sheet") == name[:31])
    header = {r["col"]: r["value"] for r in own.where("row = 1").collect()}
    if not header:
        return None
    body = own.where(F.col("row") > 1).groupBy("row").pivot("col", sorted(header)).agg(F.first("value"))
    out = body.select(*[F.col(f"`{c}`").alias(header[c]) for c in sorted(header)])
    return out if out.take(1) else None


def as_date(c):
    """An ISO date or a serial number of days."""
    return F.when(c.rlike(r"^\d{4}-"), c.try_cast("date")).otherwise(F.date_add(F.lit("1899-12-30").cast("date"), c.try_cast("double").cast("int")))


def _row_xml(row: int, values: list, kinds: list[str]) -> str:
    out = [f'<row r="{row}">']
    for k, (v, kind) in enumerate(zip(values, kinds, strict=True)):
        ref = f"{column_name(k + 1)}{row}"
        if v is None or kind == "n" and not math.isfinite(float(v)):
            continue
        out.append(f'<c r="{ref}"><v>{v}</v></c>' if kind == "n" else f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(_printable(v))}</t></is></c>')
    return "".join(out) + "</row>"


def _printable(text: str) -> str:
    """Without the control characters that XML can't hold."""
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", text)


def _parts(names: list[str]) -> dict[str, str]:
    """The workbook's own parts beside its sheets."""
    head, office = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "http://schemas.openxmlformats.org"
    numbers = range(1, len(names) + 1)
    sheets = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(numbers, names, strict=True))
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in numbers)
    links = "".join(f'<Relationship Id="rId{k}" Type="{office}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers)
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{office}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{office}/package/2006/relationships"><Relationship Id="rId1" Type="{office}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{office}/spreadsheetml/2006/main" xmlns:r="{office}/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{office}/package/2006/relationships">{links}</Relationships>',
    }


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Writes the tables as sheets of one workbook, rows in order of the first column; names of at most 31 characters."""
    names = [n[:31] for n in sheets]
    if not sheets or len(set(names)) < len(names):
        raise ValueError("sheets need names that differ in their first 31 characters")
    headers = [df.columns for df in sheets.values()]
    kinds = [["n" if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte", "decimal") else "s" for f in df.schema.fields] for df in sheets.values()]
    rows = None
    for k, df in enumerate(sheets.values()):
        cells = F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])
        first = F.col(f"`{df.columns[0]}`")
        number = first.cast("double") if kinds[k][0] == "n" else F.lit(None).cast("double")
        one = df.select(F.lit(k).alias("sheet"), number.alias("number"), first.cast("string").alias("key"), cells.alias("cells"))
        rows = one if rows is None else rows.unionAll(one)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = file_system(path)
        with fs.open_output_stream(place) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in _parts(names).items():
                z.writestr(name, text)
            state = {"sheet": -1, "row": 0, "file": None}

            def turn(to: int) -> None:
                while state["sheet"] < to:
                    if state["file"] is not None:
                        state["file"].write(b"</sheetData></worksheet>")
                        state["file"].close()
                    state["sheet"] += 1
                    if state["sheet"] == len(names):
                        break
                    f = state["file"] = z.open(f"xl/worksheets/sheet{state['sheet'] + 1}.xml", "w", force_zip64=True)
                    f.write(b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    f.write(_row_xml(1, headers[state["sheet"]], ["s"] * len(headers[state["sheet"]])).encode())
                    state["row"] = 1

            n = 0
            for batch in batches:
                for k, values in zip(batch.column("sheet").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                    turn(k)
                    state["row"] += 1
                    if state["row"] > MOST_ROWS:
                        raise ValueError(f"{names[k]} has more rows than a sheet holds")
                    state["file"].write(_row_xml(state["row"], values, kinds[k]).encode())
                    n += 1
            turn(len(names))
        yield pa.RecordBatch.from_arrays([pa.array([n], type=pa.int64())], names=["n"])

    # the sheets' own plans run as they would; one task takes their rows, as a workbook is one file
    ordered = rows.repartition(1).sortWithinPartitions("sheet", "number", "key").select("sheet", "cells")
    ordered.mapInArrow(write, "n long").collect()
