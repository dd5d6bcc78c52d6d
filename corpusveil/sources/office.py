"""Blocks from DOCX and XLSX files, read as binary files; each file is parsed in the task that holds it."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "path string, block_ord int, block_id string, text string, kind string, paragraph_index int, table_index int, row int, column int, cell_paragraph_index int, sheet_name string, cell_coordinate string, column_header string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


#: What a run's children are in text.
_PARTS = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
_CELL = re.compile(r"([A-Z]+)([0-9]+)")
#: Number formats of dates and times that need no definition (fixed values of the format), and the signs of them in others.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), 45, 46, 47, *range(50, 59)}
_DATE_SIGNS = re.compile(r"[dmyhs]", re.IGNORECASE)
_QUOTED = re.compile(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.|\*.', re.IGNORECASE)


def run_text(run: ElementTree.Element) -> str:
    return "".join(_PARTS[e.tag](e) for e in run if e.tag in _PARTS)


def paragraph_runs(p: ElementTree.Element) -> list[ElementTree.Element]:
    """The runs of a paragraph, also those within links and revisions."""
    return list(p.iter(f"{_W}r"))


def _paragraph(p: ElementTree.Element) -> str:
    return "".join(map(run_text, paragraph_runs(p)))


def _table(table: ElementTree.Element, name: str, index: int) -> Iterator[tuple[dict, ElementTree.Element]]:
    """The paragraphs of a table's cells, and of tables in cells behind them, each once."""
    for r, row in enumerate(table.findall(f"{_W}tr")):
        for c, cell in enumerate(row.findall(f"{_W}tc")):
            paragraphs = inner = 0
            for e in cell:
                if e.tag == f"{_W}p":
                    yield {"block_id": f"{name}_r{r}_c{c}_p{paragraphs}", "kind": "docx_table_cell", "table_index": index, "row": r, "column": c, "cell_paragraph_index": paragraphs}, e
                    paragraphs += 1
                elif e.tag == f"{_W}tbl":
                    yield from _table(e, f"{name}_r{r}_c{c}_t{inner}", index)
                    inner += 1


def docx_paragraphs(root: ElementTree.Element) -> Iterator[tuple[dict, ElementTree.Element]]:
    """What names and places each paragraph that has text, and its element, in the order of the body."""
    paragraphs = tables = 0
    body = root.find(f"{_W}body")
    for e in body if body is not None else ():
        found = [({"block_id": f"docx_paragraph_{paragraphs}", "kind": "docx_paragraph", "paragraph_index": paragraphs}, e)] if e.tag == f"{_W}p" else _table(e, f"docx_table_{tables}", tables) if e.tag == f"{_W}tbl" else ()
        paragraphs, tables = paragraphs + (e.tag == f"{_W}p"), tables + (e.tag == f"{_W}tbl")
        yield from (x for x in found if _paragraph(x[1]).strip())


def docx_blocks(content: bytes) -> list[dict]:
    """Paragraphs and cell paragraphs in the order of the body; blank ones are skipped, others keep their white space."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return [{**place, "text": _paragraph(e)} for place, e in docx_paragraphs(root)]


def docx_runs(content: bytes) -> list[dict]:
    """The runs of the same blocks: block_ord, run_ord, text and the format's XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for i, (_, e) in enumerate(docx_paragraphs(root)):
        for j, run in enumerate(paragraph_runs(e)):
            style = run.find(f"{_W}rPr")
            out.append({"block_ord": i, "run_ord": j, "text": run_text(run), "format": None if style is None else ElementTree.tostring(style, encoding="unicode")})
    return out


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _as_date(serial: float, code: str, since_1904: bool) -> str:
    """A date's number as text: a date with its time, a time alone below one day, a duration if the format counts hours on."""
    if re.search(r"\[(h+|m+|s+)\]", code, re.IGNORECASE):
        return str(timedelta(seconds=round(serial * 86400)))
    seconds = timedelta(seconds=round(serial % 1 * 86400))
    if 0 <= serial < 1:
        return str((datetime(1900, 1, 1) + seconds).time())
    # The first system counts a day that 1900 didn't have, the 60th.
    first = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30 if serial >= 60 else 31)
    return str(first + timedelta(days=int(serial // 1)) + seconds)


def sheet_parts(z: zipfile.ZipFile) -> Iterator[tuple[str, str]]:
    """Name of each sheet and the part that holds it."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = targets[sheet.get(f"{_R}id")].lstrip("/")
        yield sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"


class _Values:
    """The text of a workbook's cells."""

    def __init__(self, z: zipfile.ZipFile):
        names = set(z.namelist())
        self.shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        workbook = ElementTree.fromstring(z.read("xl/workbook.xml"))
        self.since_1904 = any(e.get("date1904") in ("1", "true") for e in workbook.iter(f"{_S}workbookPr"))
        styles = ElementTree.fromstring(z.read("xl/styles.xml")) if "xl/styles.xml" in names else ElementTree.Element("none")
        own = {e.get("numFmtId"): e.get("formatCode") or "" for e in styles.iter(f"{_S}numFmt")}
        cells = styles.find(f"{_S}cellXfs")
        self.formats = [(int(x.get("numFmtId") or 0), own.get(x.get("numFmtId"), "")) for x in cells] if cells is not None else []

    def text(self, cell: ElementTree.Element) -> str | None:
        """A cell's text, null for formulas and empty cells. Dates and decimal numbers are written out."""
        if cell.find(f"{_S}f") is not None:
            return None
        raw, kind = cell.findtext(f"{_S}v"), cell.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
        if not raw:
            return None
        if kind == "s":
            return self.shared[int(raw)]
        if kind == "b":
            return {"1": "True", "0": "False"}.get(raw)
        if kind == "n":
            number, code = self.formats[int(cell.get("s") or 0)] if int(cell.get("s") or 0) < len(self.formats) else (0, "")
            if number in _DATE_FORMATS or _DATE_SIGNS.search(_QUOTED.sub("", code.split(";")[0])):
                return _as_date(float(raw), code, self.since_1904)
            return str(float(raw)) if re.search("[.eE]", raw) else raw
        return raw


def xlsx_blocks(content: bytes) -> list[dict]:
    """Cells with a value, by sheet and row; formulas and blank ones are skipped. The header is the text of the column's first row."""
    out: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        values = _Values(z)
        for name, part in sheet_parts(z):
            headers: dict[int, str] = {}
            for cell in ElementTree.fromstring(z.read(part)).iter(f"{_S}c"):
                text, ref = values.text(cell), cell.get("r")
                if text is None or not text.strip():
                    continue
                row, column = int(_CELL.fullmatch(ref)[2]) - 1, _column(ref)
                if row == 0:
                    headers[column] = text
                out.append({"block_id": f"xlsx_{name}_r{row}_c{column}_{ref}", "text": text, "kind": "xlsx_cell", "row": row, "column": column, "sheet_name": name, "cell_coordinate": ref, "column_header": headers.get(column, "")})
    return out


READERS = {"docx": docx_blocks, "xlsx": xlsx_blocks}


def office_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, path and content of all DOCX and XLSX files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{docx,xlsx,DOCX,XLSX}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def suffix(name: str) -> str:
    return name.rsplit(".", 1)[-1].lower()


def _rows(files: DataFrame, read: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """A row for each dict that `read` (name, content) gives; a file's are kept together."""
    fields = [x.split()[0] for x in schema.split(", ")]
    whole = [f for f, t in (x.split() for x in schema.split(", ")) if t == "int"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([{f: {"path": name, **b}.get(f) for f in fields} for b in read(name, content)], columns=fields).astype({f: "Int32" for f in whole})

    return files.select("path", "content").mapInPandas(run, schema).withColumn("doc_id", F.xxhash64("path"))


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all DOCX and XLSX files below a path. A file of another suffix is not read; a broken one fails the job."""
    return _rows(office_files(spark, path), lambda name, content: [{"block_ord": i, **b} for i, b in enumerate(READERS[suffix(name)](content))], BLOCKS)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of the blocks of all DOCX files below a path: path, block_ord, run_ord, text, format, doc_id."""
    docx = office_files(spark, path).where(F.lower("path").endswith(".docx"))
    return _rows(docx, lambda name, content: docx_runs(content), "path string, block_ord int, run_ord int, text string, format string")
