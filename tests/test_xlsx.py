import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from panelith.sources import readers, xlsx


def test_column_names():
    for n, name in ((1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")):
        assert xlsx.column_name(n) == name and xlsx.column_number(f"{name}7") == n


def test_round_trip(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    df = spark.createDataFrame([(dt.date(2024, 1, k), 1.5 * k if k != 2 else None, 'a <b> & "c"\x01 é' if k == 1 else None) for k in range(1, 8)], "date date, x double, text string")
    readers.write_report({"first": df, "second & a name of more than 31 characters": df.select("text", "x").limit(0), "third": df.select("x")}, path)
    got = readers.read_sheet(spark, path, "first").orderBy("date").collect()
    assert [(r["date"], r["x"], r["text"]) for r in got][:2] == [("2024-01-01", "1.5", 'a <b> & "c" é'), ("2024-01-02", None, None)] and len(got) == 7
    assert readers.read_sheet(spark, path, "second & a name of more than 31 characters") is None
    assert readers.read_sheet(spark, path, "third").count() == 6
    with pytest.raises(ValueError):
        xlsx.write_workbook({}, path)


def test_rows_stand_in_order_of_the_first_column_by_its_type(spark, tmp_path):
    path = f"{tmp_path}/book.xlsx"
    numbers = spark.range(1, 13).select(F.col("id").alias("n"), F.format_string("x%d", "id").alias("s")).repartition(5)
    readers.write_report({"numbers": numbers, "texts": numbers.select("s", "n")}, path)
    cells = xlsx.read_cells(spark, path).where("row > 1 and col = 1").orderBy("row").collect()
    assert [int(c["value"]) for c in cells if c["sheet"] == "numbers"] == list(range(1, 13))
    texts = [c["value"] for c in cells if c["sheet"] == "texts"]
    assert texts == sorted(texts) and len(texts) == 12


def test_shared_strings_serial_dates_and_gaps(spark, tmp_path):
    """A workbook as other programs write it."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="close_price" sheetId="1" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId9" Target="/xl/worksheets/any.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>date</t></si><si><r><t>a</t></r><r><t>a</t></r></si><si><t>bb</t></si></sst>')
        z.writestr(
            "xl/worksheets/any.xml",
            f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>2</v></c></row>'
            '<row r="3"><c r="A3"><v>45292</v></c><c r="B3"><v>7.5</v></c><c r="D3" t="e"><v>#N/A</v></c></row><row r="4"><c r="A4"><v>45293</v></c><c r="D4"><v>3</v></c></row></sheetData></worksheet>',
        )
    (tmp_path / "other.xlsx").write_bytes(out.getvalue())
    got = readers.WorkbookSource(f"{tmp_path}/other.xlsx").facts(spark).collect()
    assert sorted((r["obs_date"], r["ticker"], r["value"]) for r in got) == [(dt.date(2024, 1, 1), "AA", 7.5), (dt.date(2024, 1, 2), "BB", 3.0)]
    assert xlsx.read_cells(spark, f"{tmp_path}/*.xlsx").where(F.col("row") == 1).count() == 3
