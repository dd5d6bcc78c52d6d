"""Masked office files: runs split with their format, cells on a coloured ground, and nothing half done."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusveil.operators.detect import detect
from corpusveil.operators.masking import masked
from corpusveil.operators.matches import matches
from corpusveil.operators.redaction import redacted_cells, redacted_runs
from corpusveil.sources.office import docx_blocks, read_office, read_runs, xlsx_blocks
from corpusveil.sources.packages import write_masked_office

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def docx(path, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:mc="http://x.org/mc" xmlns:w14="http://x.org/w14" mc:Ignorable="w14"><w:body>{body}</w:body></w:document>')
        z.writestr("word/media/picture.bin", b"\x00\x01")


def r(text, style=""):
    return f'<w:r>{f"<w:rPr>{style}</w:rPr>" if style else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def p(*runs):
    return f"<w:p>{''.join(runs)}</w:p>"


def xlsx(path, rows, styles=True, workbook=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{R}">{workbook}<sheets><sheet name="Лист" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/s.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{S}"><si><t>ИНН 7707083893</t></si><si><r><t>mail </t></r><r><t>a@b.org</t></r></si></sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{S}"><numFmts count="2"><numFmt numFmtId="164" formatCode="dd\\.mm\\.yyyy"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><fills count="1"><fill/></fills><cellXfs count="4"><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165" fontId="3"/><xf numFmtId="20"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{S}"><sheetData>{rows}</sheetData></worksheet>')


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    docx(source / "a.docx", p(r("Почта a@", "<w:i/>"), r("b.o", "<w:sz w:val='40'/>"), r("rg и ИНН "), '<w:hyperlink><w:r><w:rPr><w:rStyle w:val="L"/></w:rPr><w:t>7707083893</w:t></w:r></w:hyperlink>', "<w:r><w:drawing/></w:r>", r("!")) + "<w:tbl><w:tr><w:tc>" + p(r("c@d.org")) + "<w:tbl><w:tr><w:tc>" + p(r("внутри e@f.org")) + "</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>" + p("<w:r><w:t>до</w:t><w:tab/><w:t>x@y.org</w:t><w:br/><w:t>после</w:t></w:r>"))
    docx(source / "plain.docx", p(r("ничего")))
    xlsx(source / "b.xlsx", '<row><c r="A1" t="s"><v>0</v></c><c r="B1" s="2" t="s"><v>1</v></c></row><row><c r="A2"><f>1+1</f><v>7707083893</v></c><c r="B2"><v>5</v></c></row>')
    return source


def parts(path):
    with zipfile.ZipFile(path) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_files_are_written_with_masks_and_keep_the_rest(spark, folder, tmp_path):
    blocks = read_office(spark, str(folder))
    found = matches(detect(blocks, ("email", "inn")), ("email", "inn"))
    done = {x["path"].rsplit("/", 1)[-1]: x for x in write_masked_office(spark, blocks, found, str(folder), str(tmp_path / "out")).collect()}
    assert {k: (x["n_matches"], x["n_applied"], x["written"]) for k, x in done.items()} == {"a.docx": (5, 5, True), "b.xlsx": (2, 2, True), "plain.docx": (0, 0, True)}
    out = {k: (tmp_path / "out" / x["name"]) for k, x in done.items()}
    assert out["plain.docx"].read_bytes() == (folder / "plain.docx").read_bytes()
    texts = [b["text"] for b in docx_blocks(out["a.docx"].read_bytes())]
    assert texts == ["Почта [ЭЛЕКТРОННАЯ_ПОЧТА_1] и ИНН [ИНН_1]!", "[ЭЛЕКТРОННАЯ_ПОЧТА_2]", "внутри [ЭЛЕКТРОННАЯ_ПОЧТА_3]", "до\t[ЭЛЕКТРОННАЯ_ПОЧТА_4]\nпосле"]
    before, after = parts(folder / "a.docx"), parts(out["a.docx"])
    assert list(before) == list(after) and after["word/media/picture.bin"] == b"\x00\x01"
    xml = after["word/document.xml"].decode()
    assert 'Ignorable="w14"' in xml and "xmlns:w=" in xml and "drawing" in xml and not re.search("7707083893|@", xml)
    q = lambda x: f"{{{W}}}{x}"
    runs = ElementTree.fromstring(xml).findall(f".//{q('r')}")
    marked = [x for x in runs if x.find(f"{q('rPr')}/{q('highlight')}") is not None]
    assert len(marked) == 5 and all(x.find(f"{q('rPr')}/{q('b')}") is not None for x in marked)
    # The label takes the format of the run where the match begins, before the colour; the run within it is gone.
    assert [e.tag for e in marked[0].find(q("rPr"))] == [q("b"), q("i"), q("highlight")] and "sz" not in xml
    assert [e.tag for e in marked[1].find(q("rPr"))] == [q("rStyle"), q("b"), q("highlight")]
    cells = {b["cell_coordinate"]: b["text"] for b in xlsx_blocks(out["b.xlsx"].read_bytes())}
    assert cells == {"A1": "ИНН [ИНН_1]", "B1": "mail [ЭЛЕКТРОННАЯ_ПОЧТА_1]", "B2": "5"}
    sheet = parts(out["b.xlsx"])
    assert b"<f>1+1</f>" in re.sub(rb"ns\d:|x:", b"", sheet["xl/worksheets/s.xml"]) or b"1+1" in sheet["xl/worksheets/s.xml"]
    styles = ElementTree.fromstring(sheet["xl/styles.xml"])
    new = styles.find(f"{{{S}}}cellXfs")[4:]
    assert len(new) == 2 and {x.get("fillId") for x in new} == {"1"} and [x.get("fontId") for x in new] == [None, "3"] and styles.find(f"{{{S}}}fills").get("count") == "2"


def test_a_file_with_a_match_that_does_not_fit_is_not_written(spark, folder, tmp_path):
    blocks = read_office(spark, str(folder))
    found = matches(detect(blocks, ("email",)), ("email",))
    found = found.withColumn("text", F.when(F.col("text") == "c@d.org", "z@d.org").otherwise(F.col("text")))
    done = {x["path"].rsplit("/", 1)[-1]: (x["n_matches"], x["n_applied"], x["written"]) for x in write_masked_office(spark, blocks, found, str(folder), str(tmp_path / "out")).collect()}
    assert done == {"a.docx": (4, 3, False), "b.xlsx": (1, 1, True), "plain.docx": (0, 0, True)}
    assert sorted(x.name.split("-", 1)[1] for x in (tmp_path / "out").iterdir()) == ["b.xlsx", "plain.docx"]
    with pytest.raises(ValueError):
        write_masked_office(spark, blocks, found, str(folder), f"{folder}/")


def test_runs_join_to_the_masked_text_wherever_they_are_cut(spark):
    rng = np.random.default_rng(2)
    texts, runs, found = [], [], []
    for d in range(60):
        text = "".join(rng.choice(list("abcdé😀 "), rng.integers(0, 40)))
        texts.append((d, 0, text))
        cuts = sorted(rng.integers(0, len(text) + 1, rng.integers(0, 8)).tolist())
        runs += [(d, 0, i, text[a:b], f"f{i}") for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)], strict=True))]
        for _ in range(rng.integers(0, 5) if text else 0):
            a = int(rng.integers(0, len(text)))
            b = int(rng.integers(a + 1, min(len(text), a + 6) + 1))
            found.append((d, 0, a, b, text[a:b] if rng.random() < 0.9 else "?", "inn", f"[ИНН_{len(found)}]"))
    blocks = spark.createDataFrame(texts, "doc_id long, block_ord int, text string")
    table = spark.createDataFrame(runs, "doc_id long, block_ord int, run_ord int, text string, format string")
    matched = spark.createDataFrame(found, "doc_id long, block_ord int, start int, end int, text string, entity_type string, replacement string").dropDuplicates(["doc_id", "start", "end"])
    for style in ("full", "none"):
        want = {x["doc_id"]: x["masked"] for x in masked(blocks, matched, style).collect()}
        pieces, judged = redacted_runs(table, matched, style)
        got = {}
        for x in pieces.orderBy("doc_id", "run_ord", "part").collect():
            assert x["format"] == f"f{x['run_ord']}"
            got[x["doc_id"]] = got.get(x["doc_id"], "") + x["text"]
        assert got == {d: t for d, t in want.items() if d in {r[0] for r in runs}}
        assert pieces.where("marked").count() == judged.where("applied").count() and judged.count() == matched.count()
    cells, judged = redacted_cells(blocks.withColumn("formula", F.col("doc_id") % 2 == 0), matched)
    assert {x["doc_id"]: x["masked"] for x in cells.collect()} == {d: (masked_ if d % 2 else t) for (d, _, t), masked_ in zip(texts, [dict((x["doc_id"], x["masked"]) for x in masked(blocks, matched).collect())[d] for d, _, _ in texts], strict=True)}
    assert judged.where("doc_id % 2 = 0 and applied").count() == 0


def test_dates_numbers_and_runs_are_read_as_written(spark, tmp_path):
    cell = lambda ref, v, s=0, t="n": f'<c r="{ref}" s="{s}" t="{t}"><v>{v}</v></c>'
    xlsx(tmp_path / "d.xlsx", "<row>" + cell("A1", 46093, 1) + cell("B1", "46093.75", 1) + cell("C1", "0.5", 3) + cell("D1", "2.50", 2) + cell("E1", "1E3") + cell("F1", "007") + cell("G1", "1", t="b") + cell("H1", " ", t="str") + cell("I1", 59, 1) + cell("J1", 61, 1) + "</row>")
    assert {b["cell_coordinate"]: b["text"] for b in xlsx_blocks((tmp_path / "d.xlsx").read_bytes())} == {"A1": "2026-03-12 00:00:00", "B1": "2026-03-12 18:00:00", "C1": "12:00:00", "D1": "2.5", "E1": "1000.0", "F1": "007", "G1": "True", "I1": "1900-02-28 00:00:00", "J1": "1900-03-01 00:00:00"}
    xlsx(tmp_path / "e.xlsx", "<row>" + cell("A1", 1, 1) + "</row>", workbook='<workbookPr date1904="1"/>')
    assert xlsx_blocks((tmp_path / "e.xlsx").read_bytes())[0]["text"] == "1904-01-02 00:00:00"
    docx(tmp_path / "f.docx", p(r("a", "<w:b/>"), r("b")) + p(r(" ")) + p(r("c")))
    got = [(x["block_ord"], x["run_ord"], x["text"], x["format"] is not None) for x in read_runs(spark, str(tmp_path)).orderBy("block_ord", "run_ord").collect()]
    assert got == [(0, 0, "a", True), (0, 1, "b", False), (1, 0, "c", False)]
