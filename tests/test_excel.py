import io
import zipfile

import pytest

from millrace.sources.excel import Workbook, table
from millrace.sources.files import SourceConfig, read
from millrace.operators.schema import Field

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets, strings=(), formats=(0, 14, 164), date1904=False):
    """An xlsx file; ``sheets``: name to XML of its rows."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{RELS}"><workbookPr date1904="{int(date1904)}"/><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{s}</si>' for s in strings)}</sst>")
        xfs = "".join(f'<xf numFmtId="{f}"/>' for f in formats)
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy hh:mm"/></numFmts><cellXfs>{xfs}</cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
    return held.getvalue()


STRINGS = ("<t>id</t>", "<t>name</t>", "<r><t>Ann </t></r><r><t>B</t></r>", "<t>when</t>", "<t>total</t>")
ROWS = (
    '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="D2" t="s"><v>3</v></c></row>'
    '<row r="3"><c r="A3"><v>1</v></c><c r="B3" t="s"><v>2</v></c><c r="D3" s="1"><v>45292</v></c></row>'
    '<row r="5"><c r="A5"><v>2.5</v></c><c r="B5" t="inlineStr"><is><t>x &amp; y</t></is></c><c r="D5" s="2"><v>45292.5</v></c></row>'
    '<row r="6"><c r="A6" t="b"><v>1</v></c><c r="B6" t="e"><v>#N/A</v></c></row>'
    '<row r="7"><c r="A7" t="s"><v>4</v></c></row>'
)


def test_values_and_places():
    book = workbook({"first": "", "data": ROWS}, STRINGS)
    assert list(table(book, "data", header_row=1, skip_footer=1)) == [["id", "name", None, "when"], ["1", "Ann B", None, "2024-01-01"], ["2.5", "x & y", None, "2024-01-01 12:00:00"], ["true", None]]
    assert list(Workbook(book).rows(0)) == []
    assert next(iter(Workbook(workbook({"s": '<row><c s="1"><v>0</v></c></row>'}, date1904=True)).rows())) == ["1904-01-01"]
    with pytest.raises(ValueError, match="xlsx"):
        Workbook(b"\xd0\xcf\x11\xe0")


def test_reader(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"data": ROWS}, STRINGS))
    turned = '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>9</v></c></row><row r="4"><c r="A4" t="s"><v>4</v></c></row>'
    (tmp_path / "b.xlsx").write_bytes(workbook({"data": turned}, STRINGS))
    df = read(spark, SourceConfig(str(tmp_path), "excel", options={"sheet": "data", "header_row": 1, "skip_footer": 1}))
    assert sorted((r.id, r.name) for r in df.collect() if r.id != "true") == [("1", "Ann B"), ("2.5", "x & y"), ("9", "Ann B")]
    plain = '<row r="1"><c r="A1"><v>7</v></c><c r="B1" t="s"><v>1</v></c></row>'
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.xlsx").write_bytes(workbook({"s": plain}, STRINGS))
    df = read(spark, SourceConfig(str(tmp_path / "c"), "excel", options={"header_row": None}, fields=[Field("k", "int"), Field("v", "string")]))
    assert [tuple(r) for r in df.collect()] == [("7", "name")]
