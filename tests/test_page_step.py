"""The step that goes through pages: many pages a call of Python, one shuffle, no search that is known to find nothing."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import layout, pages
from lodestar.plans import paged

BOXES = "doc_id string, page int, seq int, x0 double, y0 double, x1 double, y1 double"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _restated(boxes):
    """Cuts one by one, as ``reading_order`` defines them."""
    if len(boxes) > 1:
        for axis, least in ((1, 10.0), (2, 1.0)):
            at = layout.widest_gap([(b[axis], b[axis + 2]) for b in boxes], least)
            sides = at is not None and ([b for b in boxes if b[axis] < at], [b for b in boxes if b[axis] >= at])
            if sides and all(sides):
                return _restated(sides[0]) + _restated(sides[1])
    return sorted(boxes, key=lambda b: (b[2], b[1]))


@pytest.mark.parametrize("seed", range(40))
def test_order_without_gutters_is_that_of_the_cuts(seed):
    rng = random.Random(seed)
    made = [(n, x := rng.randrange(0, 60), y := rng.randrange(0, 90), x + rng.randrange(-2, 30), y + rng.randrange(-2, 9)) for n in range(rng.randrange(1, 14))]
    assert layout.reading_order([b[1:] for b in made]) == [b[0] for b in _restated(made)]


def test_a_column_is_sorted_at_once(monkeypatch):
    calls = []
    found = layout.widest_gap
    monkeypatch.setattr(layout, "widest_gap", lambda *a: calls.append(1) or found(*a))
    column = [(10.0, 14.0 * n, 90.0, 14.0 * n + 12) for n in range(500)]
    assert layout.reading_order(column[::-1]) == list(range(499, -1, -1))
    assert len(calls) <= 2


def _merged_restated(boxes, prose, gap=10.0):
    groups = list(boxes)
    while True:
        pairs = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        near = lambda a: (a[0] - gap, a[1] - gap, a[2] + gap, a[3] + gap)
        hit = next(((i, j) for i, j in pairs if layout._overlap(near(groups[i]), groups[j]) > 0 and not any(layout._overlap(layout._hull(groups[i], groups[j]), p) > 0 for p in prose)), None)
        if hit is None:
            return groups
        groups[hit[0]] = layout._hull(groups[hit[0]], groups.pop(hit[1]))


@pytest.mark.parametrize("seed", range(60))
def test_merges_are_those_of_the_first_pairs(seed):
    rng = random.Random(seed)
    box = lambda: (x := rng.randrange(0, 300), y := rng.randrange(0, 300), x + rng.randrange(1, 60), y + rng.randrange(1, 60))
    boxes, prose = [box() for _ in range(rng.randrange(0, 20))], [box() for _ in range(rng.randrange(0, 4))]
    assert layout.merged_figures(boxes, prose) == _merged_restated(boxes, prose)


def test_merging_does_not_begin_anew(monkeypatch):
    """A chain at the end of many lone boxes: the lone ones are compared once with each other, not once a merge."""
    lone = [(1000.0 * n, 0.0, 1000.0 * n + 5, 5.0) for n in range(1, 61)]
    chain = [(0.0, 100.0 + 8 * n, 5.0, 105.0 + 8 * n) for n in range(60)]
    calls = []
    found = layout._overlap
    monkeypatch.setattr(layout, "_overlap", lambda *a: calls.append(1) or found(*a))
    assert len(layout.merged_figures(lone + chain, [])) == 61
    assert len(calls) < 20_000


def test_pages_take_no_call_each(spark):
    boxes = spark.createDataFrame([("d", 1, n, 0.0, 14.0 * n, 9.0, 14.0 * n + 12) for n in range(4)], BOXES)
    figures = layout.page_figures(boxes.withColumns({"kind": F.lit("raster"), "text": F.lit("")}))
    for df in (layout.page_order(boxes), figures):
        assert "InPandas" not in _plan(df) and _plan(df).count("Exchange hashpartitioning") == 1


def test_null_texts_and_empty_pages(spark):
    rows = [("d", 1, 0, "raster", None, 0.0, 0.0, 50.0, 50.0), ("d", 1, 1, "text", None, 0.0, 60.0, 50.0, 70.0), ("d", 2, 0, "text", "a", 0.0, 0.0, 5.0, 5.0)]
    made = layout.page_figures(spark.createDataFrame(rows, "doc_id string, page int, seq int, kind string, text string, x0 double, y0 double, x1 double, y1 double"))
    assert [tuple(r) for r in made.collect()] == [("d", 1, 0, 0.0, 0.0, 50.0, 50.0)]
    assert layout.page_order(spark.createDataFrame([], BOXES)).count() == 0


def _elements(spark):
    bbox = lambda n: [0.0, 14.0 * n, 90.0, 14.0 * n + 12]
    schema = "doc_id string, page int, seq int, text string, bbox array<double>"
    blocks = spark.createDataFrame([("d", p, n, f"t{n}", bbox(n)) for p in (1, 2) for n in range(4)], schema)
    tables = spark.createDataFrame([("d", 2, 0, {"a": 1}, bbox(2))], "doc_id string, page int, seq int, cells map<string,int>, bbox array<double>")
    figures = spark.createDataFrame([("d", 1, 0, False, bbox(0))], "doc_id string, page int, seq int, blank boolean, bbox array<double>")
    return pages.page_elements(tables, blocks, figures)


def test_elements_are_shuffled_by_page_and_by_document(spark):
    found = pages.with_asset_ids(_elements(spark))
    assert _plan(pages.sectioned(found.withColumns({"heading": F.lit(None).cast("string"), "level": F.lit(3), "body": F.col("text")}))).count("Exchange hashpartitioning") == 2
    got = sorted((r.page, r.place, r.kind, r.text, r.asset_id) for r in found.collect())
    assert got == [(1, 0, "image", None, "img-0.png"), (1, 1, "text", "t1", None), (1, 2, "text", "t2", None), (1, 3, "text", "t3", None), (2, 0, "text", "t0", None), (2, 1, "text", "t1", None), (2, 2, "table", None, "table-0"), (2, 3, "text", "t3", None)]


def test_counts_from_one_pass(spark):
    each = pages.with_asset_ids(_elements(spark)).withColumns({"heading": F.when(F.col("text") == "t2", "t2"), "level": F.when(F.col("text") == "t2", 3), "body": F.when(F.col("text") != "t2", F.col("text"))})
    made = pages.sectioned(each)
    known = spark.createDataFrame([("d", 1, False), ("d", 2, True), ("empty", 1, False)], "doc_id string, page int, needs_ocr boolean")
    both = [pages.paragraph_counts(made, known), pages.document_counts(pages.document_sections(made), pages.document_assets(made), known)]
    a, b = (sorted((r.doc_id, r.page_count, r.needs_ocr, tuple(r.counts)) for r in df.collect()) for df in both)
    assert a == b == [("d", 2, True, (2, 1, 1)), ("empty", 1, False, (0, 0, 0))]


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("lines")
    text = "\n".join(f"{n}. Line {n}" if n % 3 else f"line {n} goes on, in plain words." for n in range(90))
    spark.createDataFrame([(1, text), (2, "one\n\ntwo"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, 0)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def _reads(df):
    return sum("FileScan" in line and "documents.parquet" in line for line in _plan(df).splitlines())


def test_counts_read_the_documents_for_the_page_step_and_for_the_summaries(spark, lines):
    found = paged.document_counts(spark, lines)
    assert _reads(found) == 2 and len(found.collect()) == 2


def test_totals_read_the_documents_for_the_page_step_and_for_the_summaries(spark, lines):
    found = paged.run_totals(spark, lines)
    assert _reads(found) == 2 and [(r.docs, r.failed) for r in found.collect()] == [(1, 1)]


def test_counts_shuffle_no_text(spark, lines):
    """Lines are told apart where they are read: neither the page step nor what follows it carries texts, and no document is put in order."""
    for df in (paged.run_totals(spark, lines), paged.document_counts(spark, lines)):
        rows = [line for line in _plan(df).splitlines() if "struct(" in line and "_box" in line]
        assert rows and not any("text, text#" in line or "bbox, bbox#" in line for line in rows)
        assert "row_number" not in _plan(df) and "Window" not in _plan(df)


@pytest.mark.parametrize("seed", range(4))
def test_counts_of_elements_are_those_of_paragraphs(spark, seed):
    """With and without headings, assets first, blank images, blocks under assets, empty elements."""
    rng = random.Random(seed)
    rows = []
    for d in range(60):
        for n in range(rng.randrange(1, 9)):
            kind, y = rng.choice(["text", "text", "text", "table", "image"]), 14.0 * rng.randrange(6)
            heading = "H" if kind == "text" and rng.random() < 0.4 else None
            body = rng.choice(["b", "b", "", None])
            rows.append((f"d{d}", rng.randrange(1, 4), n, kind, rng.choice([True, False, None]), heading, 3 if heading else None, body, [0.0, y, 90.0, y + 12]))
    schema = "doc_id string, page int, seq int, kind string, blank boolean, heading string, level int, body string, bbox array<double>"
    each = spark.createDataFrame(rows, schema)
    known = each.groupBy("doc_id", "page").agg(F.bool_or(F.col("seq") == 3).alias("needs_ocr")).unionByName(spark.createDataFrame([("empty", 1, False)], "doc_id string, page int, needs_ocr boolean"))
    says = (F.col("kind") != "text") | (F.coalesce("body", F.lit("")) != "")
    opens = F.when(F.col("heading").isNotNull(), True).when(says, False)
    found = pages.element_counts(pages.ordered_elements(each.withColumn("opens", opens), ("kind", "blank", "opens")), known)
    wanted = pages.paragraph_counts(pages.sectioned(pages.with_asset_ids(pages.ordered_elements(each))), known)
    a, b = (sorted((r.doc_id, r.page_count, r.needs_ocr, tuple(r.counts)) for r in df.collect()) for df in (found, wanted))
    assert a == b and len(a) == 61
