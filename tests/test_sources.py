"""Round trips of the file formats."""

import io
import zipfile

import pytest

from tessera.sources import files


def test_csv_marks_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (None, None, 2.5)], "i int, s string, d double")
    files.write_csv(df, str(tmp_path / "out"), single_file=True)
    lines = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert lines == ["i, s, d", "1, a, nan", "-2147483648, None, 2.5"]


def test_fixed_width(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (200, None, None)], "i int, s string, d double")
    assert sorted(r.line for r in files.fixed_width_lines(df).collect()) == ["  1    a 2.50", "200 None None"]
    assert files.print_table(df, ["i"]).splitlines()[0].split() == ["n", "i", "s", "d"]


def test_npy_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0.5), (2, None, None)], "i long, `s p` string, d double")
    (tmp_path / "a.npy").write_bytes(files.npy_bytes(df))
    got = sorted(files.read_npy(spark, str(tmp_path / "a.npy")).collect())
    assert (got[0].i, got[0].s_p, got[0].d) == (1, "x", 0.5)
    assert got[1].s_p == "None" and got[1].d is None
    with pytest.raises(ValueError):
        files.npy_bytes(df, max_rows=1)


def workbook(rows):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join(
        f'<row r="{i}">' + "".join((f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{i}"><v>{v}</v></c>') for j, v in enumerate(r) if v is not None) + "</row>"
        for i, r in enumerate(rows, 1)
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook([["id no", "w", "t"], [1, 1.5, "a"], [None, 2, None]]))
    df = files.read_xlsx(spark, str(tmp_path / "b.xlsx"))
    assert df.dtypes == [("id_no", "bigint"), ("w", "double"), ("t", "string")]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "a"), (None, 2.0, None)]
    (tmp_path / "c.xlsx").write_bytes(files.xlsx_bytes([["id no", "w", "t"], [2.5, None, "x & <y>"], [4, "n", None]]))
    both = files.read_xlsx(spark, str(tmp_path / "*.xlsx"))
    assert both.dtypes == [("id_no", "double"), ("w", "string"), ("t", "string")]
    assert sorted(map(str, (tuple(r) for r in both.collect()))) == sorted(map(str, [(1.0, "1.5", "a"), (None, "2", None), (2.5, None, "x & <y>"), (4.0, "n", None)]))
    (tmp_path / "d.xlsx").write_bytes(files.xlsx_bytes([["other"], [1]]))
    with pytest.raises(ValueError):
        files.read_xlsx(spark, str(tmp_path / "*.xlsx"))
    with pytest.raises(IndexError):
        files.parse_xlsx((tmp_path / "b.xlsx").read_bytes(), sheet=3)


def test_table_sink(spark, tmp_path):
    df = spark.range(3)
    files.write_table(df, str(tmp_path / "out_1"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_table(df, str(tmp_path / "out_1"))
    with pytest.raises(ValueError):
        files.check_output_name("a b!c")
