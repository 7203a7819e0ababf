"""Golden literals of the text rules."""

import uuid

import pytest
from pyspark.sql import functions as F

from lodestar.functions import boxes
from lodestar.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,size,heading,level",
    [
        ("4 Harvest of the northern orchards", 10.0, True, 1),
        ("7.2.9.1.3 Depth is cut at four", 10.0, True, 4),
        ("APPENDIX OF TIDES", 10.0, True, 3),
        ("Larger than its page", 13.0, True, 2),
        ("Much larger than its page", 16.0, True, 1),
        ("Remark:", 10.0, True, 3),
        ("A sentence about ferries, with far too many words to label anything.", 10.0, False, None),
        ("lower case runs in:", 10.0, False, None),
        ("K 2", 10.0, False, None),
        ("3.14", 10.0, False, None),
        ("N" * 201, 20.0, False, None),
    ],
)
def test_headings(spark, text, size, heading, level):
    args = F.lit(text), F.lit(size), F.lit(11.0)
    assert one(spark, T.is_heading(*args)) is heading
    if heading:
        assert one(spark, T.heading_level(*args)) == level


@pytest.mark.parametrize(
    "text,prose",
    [
        ("12 24 36 48 60 72 84 96", False),
        ("Table 9 lists them", True),
        ("listing of ships", True),
        ("boats cross the bay at dawn", True),
        ("boats cross the bay", False),
        ("a b c d e f g h", False),
        ("", False),
    ],
)
def test_prose(spark, text, prose):
    assert one(spark, T.is_prose(F.lit(text))) is prose


def test_small_functions(spark):
    name = "1234:5:text:6"
    assert one(spark, T.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.UUID(T.NAMESPACE), name))
    assert one(spark, T.masked(F.lit("p-12"))) == "p-#"
    assert one(spark, T.joined_lines(F.array(F.lit("hyphen-"), F.lit("ated"), F.lit("word")))) == "hyphenated word"
    assert one(spark, T.with_caption(F.lit(None).cast("string"), F.lit("b"))) == "b"
    assert one(spark, T.split_custom_id(F.lit("a::b::c"))) == ("a", "b::c")
    assert one(spark, T.split_custom_id(F.lit("a"))) == ("a", "")
    assert one(spark, T.readable(F.lit("  unreadable scan "))) == ""
    assert one(spark, T.backoff(F.lit(3.0), F.lit("x"))) == 4.0
    assert one(spark, T.backoff(F.lit(9.0), F.lit(None).cast("string"))) == 60.0
    assert one(spark, T.is_pdf(F.lit(b"%PDF-1.7"))) and not one(spark, T.is_pdf(F.lit(b"")))
    assert one(spark, T.endpoint(F.lit("p:m:x"))) == ("p", "m:x")


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, map(float, v)))
    assert one(spark, boxes.intersection_area(box(0, 0, 10, 10), box(5, 5, 20, 20))) == 25.0
    assert one(spark, boxes.covered(box(0, 0, 10, 10), box(0, 0, 6, 10)))
    assert not one(spark, boxes.covered(box(0, 0, 0, 10), box(0, 0, 6, 10)))
