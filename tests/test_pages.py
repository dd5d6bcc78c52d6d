"""Pages of placed characters: reading order, cells, rectangles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusveil.operators.detect import detect
from corpusveil.sources.pages import GRID, page_blocks, page_characters, pages_to_recognise, span_rectangles, with_table_cells, word_rectangles

CHARS = "doc_id long, page_number int, char_ord int, c string, x0 double, y0 double, x1 double, y1 double"
CELLS = "doc_id long, page_number int, table int, row int, column int, x0 double, y0 double, x1 double, y1 double"


def line(text, x, y, order, doc=1, page=0, w=6.0, h=10.0):
    return [(doc, page, order * 1000 + i, c, float(x + w * i), float(y), float(x + w * (i + 1)), float(y + h)) for i, c in enumerate(text)]


def test_lines_blocks_and_reading_order(spark):
    rows = line("below", 10, 200, 0) + line("first ", 10, 10, 1) + line("second", 10, 22, 2) + line("right", 400, 8, 3) + line("far", 700, 8, 4) + line("next page", 10, 10, 0, page=1)
    rows += line("   ", 10, 400, 5) + line("raised", 10, 500, 6) + [(1, 0, 6100, "²", 46.0, 497.0, 50.0, 507.0)] + [(1, 0, None, "x", 0.0, 0.0, 1.0, 1.0), (1, 0, 9000, "x", None, 0.0, 1.0, 1.0), (1, 0, 9001, None, 0.0, 0.0, 1.0, 1.0)]
    placed = page_characters(spark.createDataFrame(rows, CHARS).repartition(5))
    got = [(r["page_number"], r["block_ord"], r["block_id"], r["text"]) for r in page_blocks(placed).orderBy("block_ord").collect()]
    assert got == [
        (0, 0, "pdf_page_0_block_0", "right\n"), (0, 1, "pdf_page_0_block_1", "far\n"), (0, 2, "pdf_page_0_block_2", "first \nsecond\n"), (0, 3, "pdf_page_0_block_3", "below\n"), (0, 4, "pdf_page_0_block_5", "raised²\n"),
        (1, 5, "pdf_page_1_block_0", "next page\n"),
    ]
    texts = {r["block"]: r["text"] for r in page_blocks(placed).where("page_number = 0").collect()}
    assert all(texts[r["block"]][r["offset"]] == r["c"] for r in placed.where("page_number = 0 and c <> ' '").collect())
    pages = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id long, page_number int")
    assert [tuple(r) for r in pages_to_recognise(pages, page_blocks(placed)).collect()] == [(1, 2)]
    empty = spark.createDataFrame([], CHARS)
    assert page_blocks(page_characters(empty)).count() == 0


def test_cells_equal_a_plain_search(spark):
    rng = np.random.default_rng(8)
    rows, cells = [], []
    for d in range(12):
        at = rng.uniform(0, 300, 2)
        widths, heights = rng.uniform(20, 200, 4), rng.uniform(12, 90, 5)
        for r in range(5):
            for c in range(4):
                x, y = at[0] + widths[:c].sum(), at[1] + heights[:r].sum()
                cells.append((d, 0, 0, r, c, float(x), float(y), float(x + widths[c]), float(y + heights[r])))
                text = str(rng.choice(["Цена", "Название", "12 000,50", " 7 ", "слово", ""])) if r else ["Цена", "Стоимость работ", "Имя", ""][c]
                rows += line(text, float(x + 2), float(y + 1), r * 4 + c, doc=d)
    placed = page_characters(spark.createDataFrame(rows, CHARS))
    blocks = page_blocks(placed)
    got = {(r["doc_id"], r["block"], s["cell_row"], s["cell_column"], s["start"], s["end"]) for r in with_table_cells(blocks, placed, spark.createDataFrame(cells, CELLS)).where("cell_spans is not null").collect() for s in r["cell_spans"]}
    want = {}
    for r in placed.collect():
        for d, _, _, row, col, x0, y0, x1, y1 in cells:
            if d == r["doc_id"] and row and x0 <= (r["x0"] + r["x1"]) / 2 < x1 and y0 <= (r["y0"] + r["y1"]) / 2 < y1:
                want.setdefault((d, r["block"], r["block_line"], row, col), []).append(r["offset"])
    assert got == {(d, b, row, col, min(o), max(o) + 1) for (d, b, _, row, col), o in want.items()} and len(got) > 100 and GRID > 0


def test_sums_of_priced_columns_are_amounts(spark):
    rows = line("Цена", 10, 0, 0) + line("Число", 200, 0, 1) + line(" 1 200,50 ", 10, 20, 2) + line("1 200", 200, 20, 3) + line("3 шт.", 10, 40, 4)
    cells = [(1, 0, 0, r, c, 190.0 * c, 20.0 * r - 2, 190.0 * (c + 1), 20.0 * r + 15) for r in range(3) for c in range(2)]
    placed = page_characters(spark.createDataFrame(rows, CHARS))
    blocks = with_table_cells(page_blocks(placed), placed, spark.createDataFrame(cells, CELLS)).select("doc_id", "block_ord", "text", "cell_spans", "money_spans")
    found = [(s["entity_type"], s["text"]) for r in detect(blocks, ("amount",)).collect() for s in r["spans"]]
    assert found == [("amount", "1 200,50")]


def test_a_span_over_lines_has_a_rectangle_in_each_and_one_label(spark):
    rows = line("see Ivan", 10, 0, 0) + line("ov here Petrov", 10, 12, 1)
    placed = page_characters(spark.createDataFrame(rows, CHARS))
    blocks = page_blocks(placed)
    found = spark.createDataFrame([(1, 0, 4, 11, "Ivan\nov", "person_name", "[A]"), (1, 0, 17, 23, "Petrov", "person_name", "[B]"), (1, 0, 0, 3, "sea", "person_name", "[C]"), (2, 0, 0, 3, "see", "person_name", "[D]")], "doc_id long, block_ord int, start int, end int, text string, entity_type string, label string")
    got = [(r["start"], r["block_line"], r["x0"], r["y0"], r["x1"], r["y1"], r["label"]) for r in span_rectangles(placed, blocks, found).orderBy("start", "block_line").collect()]
    assert got == [(4, 0, 34.0, 0.0, 58.0, 10.0, "[A]"), (4, 1, 10.0, 12.0, 22.0, 22.0, None), (17, 1, 58.0, 12.0, 94.0, 22.0, "[B]")]


def test_recognised_words_are_joined_by_line(spark):
    words = [(0, 6, 20.0, 40.0, 80.0, 60.0), (7, 11, 90.0, 42.0, 130.0, 60.0), (12, 15, 10.0, 70.0, 40.0, 90.0), (16, 20, 50.0, 71.0, 60.0, 75.0)]
    df = spark.createDataFrame([(words,), ([],), (None,)], "w array<struct<start:int,end:int,x0:double,y0:double,x1:double,y1:double>>")
    got = [[tuple(x) for x in r["r"]] if r["r"] is not None else None for r in df.select(word_rectangles(F.col("w"), F.lit(3), F.lit(18)).alias("r")).collect()]
    assert got == [[(20.0, 40.0, 130.0, 60.0), (10.0, 70.0, 60.0, 90.0)], [], None]
