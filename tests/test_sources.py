"""File sources, word lines, streaming and components."""

from __future__ import annotations

import zipfile

from corpusveil.operators.components import components
from corpusveil.sources.ocr import ocr_lines
from corpusveil.sources.office import read_office
from corpusveil.sources.tables import line_blocks
from corpusveil.streaming.intake import start

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('  one')}{p(' ')}<w:tbl><w:tr><w:tc>{p('x')}{p('y')}</w:tc></w:tr></w:tbl>{p('two')}</w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="L" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet {S}><sheetData><row><c r="A1" t="inlineStr"><is><t>Цена</t></is></c><c r="B1"><f>1+1</f><v>2</v></c></row><row><c r="A2"><v>100</v></c></row></sheetData></worksheet>')
    rows = read_office(spark, str(tmp_path)).orderBy("path", "block_ord").collect()
    assert [(r["block_id"], r["text"]) for r in rows] == [("docx_paragraph_0", "  one"), ("docx_table_0_r0_c0_p0", "x"), ("docx_table_0_r0_c0_p1", "y"), ("docx_paragraph_2", "two"), ("xlsx_L_r0_c0_A1", "Цена"), ("xlsx_L_r1_c0_A2", "100")]
    assert rows[5]["column_header"] == "Цена"


def test_word_lines(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 10, 20, 30, 10, "95", "Иванов"), (1, 1, 1, 1, 1, 2, 45, 20, 20, 10, "90.5", "И.И."), (1, 1, 1, 1, 1, 3, 0, 0, 1, 1, "10", "x"), (1, 1, 1, 1, 2, 1, 0, 0, 1, 1, "-1", "")], "doc_id long, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf string, text string")
    rows = ocr_lines(words, 2.0, 2.0).collect()
    assert [r["text"] for r in rows] == ["Иванов И.И."]
    assert [tuple(w) for w in rows[0]["ocr_words"]] == [(0, 6, 20, 40, 80, 60), (7, 11, 90, 40, 130, 60)]
    assert rows[0]["bbox"] == [20, 40, 130, 60]


def test_streamed_batches_equal_one_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "почта a@b.ru"), (2, "нет"), (3, "x@y.org x@y.org")], "doc_id long, text string").repartition(3).write.parquet(source)
    start(spark, source, target, str(tmp_path / "check"), ("email",)).awaitTermination(120)
    got = {r["doc_id"]: r["masked"] for r in spark.read.parquet(target).collect()}
    assert got == {1: "почта [ЭЛЕКТРОННАЯ_ПОЧТА_1]", 2: "нет", 3: "[ЭЛЕКТРОННАЯ_ПОЧТА_1] [ЭЛЕКТРОННАЯ_ПОЧТА_1]"}


def test_long_chains_are_one_component(spark):
    edges = [(1, i, i + 1) for i in range(12)] + [(2, 5, 6), (2, 9, 8)]
    got = components(spark.createDataFrame(edges, "doc_id long, a long, b long")).collect()
    assert {(r["doc_id"], r["label"]) for r in got} == {(1, 0), (2, 5), (2, 8)} and len(got) == 17


def test_lines_count_blank_ones(spark):
    rows = line_blocks(spark.createDataFrame([(1, "a\n \nb"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["block_ord"], r["text"]) for r in rows] == [(1, 0, "a"), (1, 2, "b")]
