"""DOCX and XLSX files with masks put in, as packages that keep everything else.

Which text a run or a cell gets is worked out on tables; here each file's few changes are written into its
XML, by the task that holds the file. A file of which a match could not be put in is not written.
"""

from __future__ import annotations

import copy
import io
import posixpath
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redaction import redacted_cells, redacted_runs
from .office import _PARTS, _S, _W, docx_paragraphs, office_files, paragraph_runs, read_runs, sheet_parts, suffix
from .tables import cut

# The colour behind masked cells, and that of masked words.
FILL, HIGHLIGHT = "FFFFF59D", "yellow"
#: The order of a run's properties that stand before and behind the two that a mask sets.
_BOLD_AFTER = ("rStyle", "rFonts")
_HIGHLIGHT_AFTER = ("rStyle", "rFonts", "b", "bCs", "i", "iCs", "caps", "smallCaps", "strike", "dstrike", "outline", "shadow", "emboss", "imprint", "noProof", "snapToGrid", "vanish", "webHidden", "color", "spacing", "w", "kern", "position", "sz", "szCs")
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"


def _keep_names(xml: bytes) -> None:
    """Have the prefixes of a part written as they were read, since some attributes name them."""
    for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(xml), events=["start-ns"]):
        if not prefix.startswith("ns") or not prefix[2:].isdigit():
            ElementTree.register_namespace(prefix, uri)


def _set(properties: ElementTree.Element, name: str, value: str | None, after: tuple[str, ...]) -> None:
    """A property of a run, in the place that the format wants."""
    for old in properties.findall(f"{_W}{name}"):
        properties.remove(old)
    new = ElementTree.Element(f"{_W}{name}", {} if value is None else {f"{_W}val": value})
    at = max((i + 1 for i, e in enumerate(properties) if e.tag in {f"{_W}{a}" for a in after}), default=0)
    properties.insert(at, new)


def _written(run: ElementTree.Element, text: str, marked: bool) -> ElementTree.Element:
    """A run of the same format with this text."""
    new = ElementTree.Element(run.tag, run.attrib)
    own = run.find(f"{_W}rPr")
    properties = copy.deepcopy(own) if own is not None else ElementTree.Element(f"{_W}rPr")
    if marked:
        _set(properties, "b", None, _BOLD_AFTER)
        _set(properties, "highlight", HIGHLIGHT, _HIGHLIGHT_AFTER)
    if len(properties):
        new.append(properties)
    for i, line in enumerate(text.split("\n")):
        if i:
            new.append(ElementTree.Element(f"{_W}br"))
        for j, part in enumerate(line.split("\t")):
            if j:
                new.append(ElementTree.Element(f"{_W}tab"))
            if part:
                e = ElementTree.SubElement(new, f"{_W}t", {_SPACE: "preserve"})
                e.text = part
    return new


def masked_docx(content: bytes, blocks: dict[int, dict[int, list[tuple[str, bool]]]]) -> bytes:
    """The package with new pieces (text, marked) for runs, by block and run. A run of a block that has no pieces loses its text; other blocks stay."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml")
    _keep_names(xml)
    root = ElementTree.fromstring(xml)
    for i, (_, paragraph) in enumerate(docx_paragraphs(root)):
        if i not in blocks:
            continue
        parents = {child: parent for parent in paragraph.iter() for child in parent}
        for j, run in enumerate(paragraph_runs(paragraph)):
            pieces = blocks[i].get(j, [])
            if not any(e.tag in _PARTS for e in run):
                continue
            place = list(parents[run]).index(run)
            for k, (text, marked) in enumerate(pieces):
                parents[run].insert(place + 1 + k, _written(run, text, marked))
            for e in [e for e in run if e.tag in _PARTS]:
                run.remove(e)
            if all(e.tag == f"{_W}rPr" for e in run):
                parents[run].remove(run)
    return _repacked(content, {"word/document.xml": ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)})


def masked_xlsx(content: bytes, cells: dict[tuple[str, str], str]) -> bytes:
    """The package with new text for cells (sheet, coordinate), on a coloured ground, their style else as it was."""
    new: dict[str, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        has_styles = "xl/styles.xml" in z.namelist()
        styles_xml = z.read("xl/styles.xml") if has_styles else None
        styles = ElementTree.fromstring(styles_xml) if has_styles else None
        styles = styles if styles is not None and styles.find(f"{_S}cellXfs") is not None and styles.find(f"{_S}fills") is not None else None
        filled: dict[str, str] = {}
        for name, part in sheet_parts(z):
            own = {ref: text for (sheet, ref), text in cells.items() if sheet == name}
            if not own:
                continue
            xml = z.read(part)
            _keep_names(xml)
            root = ElementTree.fromstring(xml)
            for cell in root.iter(f"{_S}c"):
                if cell.get("r") not in own:
                    continue
                for e in list(cell):
                    cell.remove(e)
                cell.set("t", "inlineStr")
                t = ElementTree.SubElement(ElementTree.SubElement(cell, f"{_S}is"), f"{_S}t", {_SPACE: "preserve"})
                t.text = own[cell.get("r")]
                if styles is not None:
                    style = cell.get("s") or "0"
                    if style not in filled:
                        filled[style] = _filled(styles, style)
                    cell.set("s", filled[style])
            new[part] = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
    if styles is not None and filled:
        _keep_names(styles_xml)
        new["xl/styles.xml"] = ElementTree.tostring(styles, encoding="UTF-8", xml_declaration=True)
    return _repacked(content, new)


def _filled(styles: ElementTree.Element, style: str) -> str:
    """The number of a style like this one with the colour behind it."""
    fills, formats = styles.find(f"{_S}fills"), styles.find(f"{_S}cellXfs")
    at = next((i for i, f in enumerate(fills) if (c := f.find(f"{_S}patternFill/{_S}fgColor")) is not None and c.get("rgb") == FILL), None)
    if at is None:
        pattern = ElementTree.SubElement(ElementTree.SubElement(fills, f"{_S}fill"), f"{_S}patternFill", {"patternType": "solid"})
        ElementTree.SubElement(pattern, f"{_S}fgColor", {"rgb": FILL})
        at = len(fills) - 1
        fills.set("count", str(len(fills)))
    new = copy.deepcopy(formats[int(style)])
    new.set("fillId", str(at))
    new.set("applyFill", "1")
    formats.append(new)
    formats.set("count", str(len(formats)))
    return str(len(formats) - 1)


def _repacked(content: bytes, new: dict[str, bytes]) -> bytes:
    """The package with some parts replaced, in the same order."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for info in z.infolist():
            w.writestr(info, new.get(info.filename, z.read(info.filename)), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_masked_office(spark: SparkSession, blocks: DataFrame, found: DataFrame, source: str, target: str, style: str = "full") -> DataFrame:
    """Write the files below `source` with the matches of their blocks masked into the folder `target`.

    `blocks` are those of `read_office`, `found` matches with doc_id, block_ord, start, end, text, entity_type
    and replacement. Returns doc_id, path, name (of the file in `target`: the document's id and its own name),
    n_matches, n_applied and written. A file is written only if all its matches were put in; one without
    matches is copied. Nothing is written into `source`, and a task that runs again replaces its file.
    """
    if posixpath.normpath(source) == posixpath.normpath(target):
        raise ValueError("the target must not be the source")
    root = target if "://" in target else f"file://{target}"
    key = ["doc_id", "block_ord"]
    runs = read_runs(spark, source)
    touched = found.select(*key).distinct()
    pieces, in_runs = redacted_runs(runs.join(touched, key, "left_semi").drop("path"), found.join(runs.select(*key).distinct(), key, "left_semi"), style)
    cells, in_cells = redacted_cells(blocks.where("kind = 'xlsx_cell'").select(*key, "text", "sheet_name", "cell_coordinate"), found.join(blocks.where("kind = 'xlsx_cell'").select(*key), key, "left_semi"), style)
    judged = in_runs.select("doc_id", "applied").unionByName(in_cells.select("doc_id", "applied")).groupBy("doc_id").agg(F.sum(F.col("applied").cast("long")).alias("n_applied"))
    asked = found.groupBy("doc_id").agg(F.count("*").alias("n_matches"))
    edits = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("block_ord", "run_ord", "part", "text", "marked"))).alias("runs"))
    filled = cells.where("marked").groupBy("doc_id").agg(F.collect_list(F.struct("sheet_name", "cell_coordinate", "masked")).alias("cells"))
    files = office_files(spark, source).join(asked, "doc_id", "left").join(judged, "doc_id", "left").join(edits, "doc_id", "left").join(filled, "doc_id", "left")
    files = files.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_matches", "n_applied")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                name, whole = f"{r.doc_id & (1 << 64) - 1:016x}-{r.path.rsplit('/', 1)[-1]}", r.n_matches == r.n_applied
                if whole:
                    if suffix(r.path) == "docx":
                        edited = defaultdict(lambda: defaultdict(list))
                        for e in r.runs if r.runs is not None else ():
                            edited[e["block_ord"]][e["run_ord"]].append((e["text"], e["marked"]))
                        content = masked_docx(r.content, edited) if edited else r.content
                    else:
                        content = masked_xlsx(r.content, {(c["sheet_name"], c["cell_coordinate"]): c["masked"] for c in r.cells}) if r.cells is not None else r.content
                    own = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
                    with fs.open_output_stream(own) as out:
                        out.write(content)
                    fs.move(own, f"{base}/{name}")
                rows.append((r.doc_id, r.path, name, r.n_matches, r.n_applied, whole))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "name", "n_matches", "n_applied", "written"])

    return cut(files.mapInPandas(run, "doc_id long, path string, name string, n_matches long, n_applied long, written boolean"), "packages", keep=True)
