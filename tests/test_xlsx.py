import io
import zipfile

from veilspark.plans.pipeline import cell_registrations, enrich_generic, mask_cells
from veilspark.sources import sinks
from veilspark.sources.documents import cells, documents, files, xlsx_cells

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(sheets=("Клиенты",)):
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    rows = f'<row r="1">{text("A1", "Компания")}{text("B1", "ИНН")}</row><row r="2">{text("A2", "ООО Ромашка")}<c r="B2"><v>7707083893.0</v></c><c r="C2"><f>A1+1</f><v>5</v></c><c r="D2" t="b"><v>1</v></c></row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{name}" sheetId="{i}" r:id="r{i}"/>' for i, name in enumerate(sheets, 1))
        parts = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"{HEAD}<Relationships>{parts}</Relationships>")
        for i in range(1, len(sheets) + 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'{HEAD}<worksheet xmlns="{MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "k.xlsx").write_bytes(workbook())
    got = documents(spark, str(tmp_path)).first()
    assert got.text == "=== Клиенты ===\nКомпания | ИНН\nООО Ромашка | 7707083893 | 5 | да"
    c = cells(files(spark, str(tmp_path))).selectExpr("1L AS doc_seq", "source_path AS source_file", "value", "is_formula")
    regs = {(r.original, r.label) for r in cell_registrations(c).collect()}
    assert regs == {("ООО Ромашка", "ORGANIZATION"), ("7707083893", "RU_INN")}
    known = spark.createDataFrame([("7707083893", "<X>")], "original string, placeholder string")
    assert {tuple(r) for r in enrich_generic(known, cell_registrations(c)).collect()} == {("7707083893", "<X>"), ("ООО Ромашка", "<ORG>")}
    masked = {r.value: r.masked for r in mask_cells(c, {"7707083893": "<RU_INN_1>", "5": "x"}).collect()}
    assert masked["7707083893"] == "<RU_INN_1>" and masked["5"] == "5"
    back = {(r, k): v for _, r, k, v, _, _ in xlsx_cells(sinks.xlsx_masked(workbook(), {"7707083893": "<RU_INN_1>"}))}
    assert back[2, 2] == "<RU_INN_1>" and back[2, 3] == "5" and back[2, 1] == "ООО Ромашка"


def test_sheets_keep_their_order(spark, tmp_path):
    (tmp_path / "k.xlsx").write_bytes(workbook(("Я", "Б", "А")))
    got = documents(spark, str(tmp_path)).first()
    assert [x for x in got.text.split("\n") if x.startswith("===")] == ["=== Я ===", "=== Б ===", "=== А ==="]


def test_command_line(spark, tmp_path, capsys):
    import json

    from veilspark.__main__ import main
    from veilspark.sources.documents import docx_text

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "k.xlsx").write_bytes(workbook())
    (tmp_path / "in" / "a.b.txt").write_text("Почта ivan@example.com, ИНН 7707083893")
    (tmp_path / "in" / "d.docx").write_bytes(sinks.docx_from_text("Почта ivan@example.com"))
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "k.txt").write_text("x@example.com")
    out = tmp_path / "out"
    assert main([str(tmp_path / "in"), str(out)]) == 0
    assert (out / "a.b_anonymized.txt").read_text() == "Почта <EMAIL>, ИНН <INN>"
    report = json.loads((out / "a.b_report.json").read_text())
    assert report["total_entities"] == 2 and report["source_file"] == "a.b.txt"
    assert docx_text((out / "d_anonymized.docx").read_bytes()) == "Почта <EMAIL>"
    cells_out = {(r, k): v for _, r, k, v, _, _ in xlsx_cells((out / "k_anonymized.xlsx").read_bytes())}
    assert cells_out[2, 2] == "<INN>" and cells_out[2, 1] == "<ORG>" and cells_out[1, 1] == "Компания"
    assert (out / "sub" / "k_anonymized.txt").read_text() == "<EMAIL>" and "a.b.txt" in capsys.readouterr().out
    assert main([str(tmp_path / "nothing")]) == 1
