import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text
from corpusmill.operators.sections import split_sections, stamp_pages

LISTED = "array<struct<title:string,page_start:int,page_end:int>>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("**Configuration**", "Configuration"),
        ("*Introduction*", "Introduction"),
        ("_Notes_", "Notes"),
        ("Hello <span>world</span>", "Hello world"),
        ("  spaced   out  ", "spaced out"),
        (" wide ", "wide"),
        ("", ""),
    ],
)
def test_clean_heading(spark, raw, clean):
    assert one(spark, text.clean_heading(F.lit(raw))) == clean


def test_tokens(spark):
    assert one(spark, text.approx_tokens(F.lit(923))) == 1200
    assert one(spark, text.approx_tokens(F.lit(924))) == 1202
    assert one(spark, F.size(text.words(F.lit("a  b\nc ")))) == 2
    assert one(spark, text.lower_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, text.tags_from_json(F.lit('["a"]'))) == ["a"]
    assert one(spark, text.tags_from_json(F.lit("{}"))) == []


def sections(spark, md, fallback="Doc"):
    found = one(spark, split_sections(F.lit(md).cast("string"), F.lit(fallback)))
    return None if found is None else [(s["title"], s["level"], s["content"]) for s in found]


def test_split_sections(spark):
    assert sections(spark, "# A\r\none\r\n## B\r\ntwo") == [("A", 1, "one"), ("B", 2, "two")]
    assert sections(spark, "before\n# A\nx\n# Empty\n\n# C\ny") == [("A", 1, "x"), ("C", 1, "y")]
    assert sections(spark, "{0}---------\nplain") == [("Doc", 1, "plain")]
    assert sections(spark, "# only\n# headings") == [("Doc", 1, "# only\n# headings")]
    assert sections(spark, "#no space") == [("Doc", 1, "#no space")]
    assert sections(spark, " \n\t") == []
    assert sections(spark, None) is None


def stamped(spark, titles, listed):
    s = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(1).cast("smallint").alias("level"),
                           F.lit("x").alias("content"), F.lit(None).cast("int").alias("page_start"),
                           F.lit(None).cast("int").alias("page_end")) for t in titles))
    j = F.array(*(F.struct(F.lit(t).alias("title"), F.lit(a).alias("page_start"), F.lit(b).alias("page_end"))
                  for t, a, b in listed)) if listed else F.array().cast(LISTED)
    return [(r["title"], r["page_start"], r["page_end"]) for r in one(spark, stamp_pages(s, j))]


def test_stamp_pages(spark):
    assert stamped(spark, ["A", "**B**"], [("A", 1, 2), ("B", 3, 4)]) == [("A", 1, 2), ("**B**", 3, 4)]
    assert stamped(spark, ["A", "X", "B"], [("A", 1, 1), ("B", 2, 2)])[1:] == [("X", None, None), ("B", 2, 2)]
    assert stamped(spark, ["A"], []) == [("A", None, None)]
    far = [(f"j{k}", k, k) for k in range(4)] + [("A", 9, 9)]
    assert stamped(spark, ["A"], far) == [("A", None, None)]
    assert stamped(spark, ["A"], far[1:]) == [("A", 9, 9)]
