"""Workbooks are read back cell by cell."""

import re
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldspan.operators import report
from fieldspan.sources import workbook

NS = {"m": workbook.MAIN, "r": workbook.OFFICE}


def read(path):
    """Sheet name -> rows of (value, style); which sheets are fixed and filtered; widths."""
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets", NS)]
        links = {x.get("Id"): x.get("Target") for x in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out, fixed, widths = {}, {}, {}
        for k, name in enumerate(names, 1):
            sheet = ET.fromstring(z.read(f"xl/{links[f'rId{k}']}"))
            rows = []
            for r in sheet.find("m:sheetData", NS):
                cells = []
                for c in r:
                    text, number = c.find("m:is/m:t", NS), c.find("m:v", NS)
                    value = (text.text or "") if text is not None else float(number.text) if number is not None else None
                    cells.append((value, int(c.get("s", 0))))
                rows.append(cells)
            out[name] = rows
            fixed[name] = (sheet.find(".//m:pane", NS) is not None, sheet.find("m:autoFilter", NS).get("ref") if sheet.find("m:autoFilter", NS) is not None else None)
            widths[name] = [int(c.get("width")) for c in sheet.find("m:cols", NS)]
        styles = ET.fromstring(z.read("xl/styles.xml"))
        assert len(styles.find("m:cellXfs", NS)) == 3
        declared = {x.get("PartName") for x in ET.fromstring(z.read("[Content_Types].xml")) if x.get("PartName")}
        assert declared == {"/" + n for n in z.namelist() if n.startswith("xl/") and not n.endswith(".rels")}
    return out, fixed, widths


def test_cells_come_back(spark, tmp_path):
    texts = ["a", None, "", " <b> & \"c\" ", "é\nü", "bell\x07", "=1+1", "x" * 100, "漢" * 20]
    rows = [(k, t, k / 3 if k % 2 else None, t) for k, t in enumerate(texts)] + [(99, "inf", float("inf"), "nan")]
    df = spark.createDataFrame(rows, "k int, t string, v double, Team string")
    many = spark.range(5000).select(F.col("id"), (F.col("id") * 2).alias("twice")).repartition(7).orderBy("id")
    workbook.write({"First & <one>": [df.orderBy("k"), df.filter("k < 2").select("t", "k").orderBy("k")], "Many": [many], "None": [many.limit(0)]}, str(tmp_path / "a" / "b.xlsx"), label="Team")
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["b.xlsx"]
    got, fixed, widths = read(tmp_path / "a" / "b.xlsx")
    shown = lambda t: None if t is None else t.replace("\x07", "_x0007_")
    want = [[(c, 1) for c in df.columns]] + [[(float(k), 0), (shown(t), 0), (None if v is None or v == float("inf") else v, 0), (shown(n), 2)] for k, t, v, n in rows]
    assert got["First & <one>"] == want + [[], [("t", 1), ("k", 1)], [("a", 0), (0.0, 0)], [(None, 0), (1.0, 0)]]
    assert got["Many"] == [[("id", 1), ("twice", 1)]] + [[(float(k), 0), (2.0 * k, 0)] for k in range(5000)]
    assert got["None"] == [[("id", 1), ("twice", 1)]]
    assert fixed == {"First & <one>": (False, None), "Many": (True, "A1:B5001"), "None": (True, "A1:B1")}
    assert widths["First & <one>"][1] == 45 and widths["Many"] == [8, 8]


def test_nothing_is_left_where_a_sheet_is_too_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 3)
    with pytest.raises(Exception, match="holds 3"):
        workbook.write({"s": [spark.range(9).toDF("n")]}, str(tmp_path / "x.xlsx"))
    bad = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("n"))
    with pytest.raises(Exception, match="no"):
        workbook.write({"s": [bad]}, str(tmp_path / "x.xlsx"))
    assert list(tmp_path.iterdir()) == []


def test_sheets_of_the_report(spark, tmp_path):
    rows = [("A", q, "c1", 10.0 * q, 10.0 * q + 7.25, 7.25, r, None, None, "(0, 5, 2)", "(1, 6, 0)", 1, q % 2) for q in (1, 2, 3) for r in ("Goal", "Untagged")] + [("B", 1, "c2", 0.0, 3.0, 3.0, "Save", "EMO", "n", None, None, 0, 0)]
    names = "team, quarter, camera, start_sec, end_sec, duration_sec, result, man_situation, notes, formation, def_formation, cuts_in, cuts_out".split(", ")
    df = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, ["string", "int", "string", "double", "double", "double", "string", "string", "string", "string", "string", "int", "int"], strict=True)))
    report.write_workbook(df, str(tmp_path / "game_report.xlsx"))
    got, fixed, _ = read(tmp_path / "game_report.xlsx")
    assert list(got) == list(report.SHEETS)
    for name, table in report.sheets(df).items():
        cells = [[float(v) if isinstance(v, (int, float)) else v for v in r] for r in table.collect()]
        want = [list(table.columns), *cells]
        if name == "Result Breakdown":
            assert [[c[0] for c in r] for r in got["Game Averages"]][-len(want) :] == want
        else:
            assert [[c[0] for c in r] for r in got[name]][: len(want)] == want
    assert not fixed["Game Averages"][0] and fixed["Possession Log"] == (True, "A1:M8")
    assert [workbook.letters(k) for k in (1, 26, 27, 52, 703)] == ["A", "Z", "AA", "AZ", "AAA"]
    assert re.fullmatch(r"<c><v>1.5</v></c>", workbook.cell("1.5", True))
