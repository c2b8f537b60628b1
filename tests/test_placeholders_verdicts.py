"""E1-E3, F3-F5 on hand-made rows."""

from pyspark.sql import functions as F

from qlift.functions import placeholders as PHF
from qlift.functions import verdicts as V
from qlift.operators import judging as J


def test_placeholder_bodies(spark):
    rows = ["<>", "<a", "a>", "<a <b>>", "<a/b>", "<x><y>"]
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    got = [r[0] for r in df.select(PHF.placeholders("d")).collect()]
    assert got == [[], [], [], ["b"], ["a/b"], ["x", "y"]]
    opts = [r[0] for r in df.select(PHF.options(F.lit(" a / b /c "))).limit(1).collect()]
    assert opts == [["a", "b", "c"]]
    filled = [r[0] for r in df.select(PHF.fill_first("d")).collect()]
    assert filled == ["<>", "<a", "a>", "<a b>", "a", "xy"]


def test_parse_review(spark):
    raw = ("- Review Perceived Intelligence: quote: \"x\"\r\n- Perceived Intelligence: high\r\n"
           "- Detail: Very Low\n- Clarity: superb\n- Overall score: low")
    df = spark.createDataFrame([(1, 0, 1, raw), (2, 0, 1, "no verdict")], "query_id long, model_id long, level long, raw string")
    rows = J.score_labels(J.parse_review(df)).orderBy("line_no").collect()
    got = [(r.criterion, r.label, r.score, r.status) for r in rows]
    assert got == [("Perceived Intelligence", "high", 3, "ok"), ("Detail", "Very Low", 1, "ok"),
                   ("Clarity", "superb", None, "invalid"), ("Overall score", "low", 2, "ok")]


def test_ordinal_labels(spark):
    rows = ["very low", "low", "high", "very high", "High effort", "very low effort", "NA", "na", "", "medium"]
    df = spark.createDataFrame([(r,) for r in rows], "l string")
    got = [(r[0], r[1]) for r in df.select(V.ordinal("l"), V.label_status("l")).collect()]
    assert got == [(1, "ok"), (2, "ok"), (3, "ok"), (4, "ok"), (3, "ok"), (1, "ok"), (None, "na"), (None, "na"),
                   (None, "invalid"), (None, "invalid")]


def test_parse_binary_and_effort(spark):
    rows = ['{"Score": "Highly Likely", "Explanation": "a b"}', '{"Score":"Highly Unlikely"}', '{"Score":"Maybe"}', "n/a"]
    df = spark.createDataFrame([(r,) for r in rows], "raw string")
    assert [r[0] for r in df.select(V.parse_binary("raw")).collect()] == [True, False, None, None]
    e = spark.createDataFrame([('{"comprehension_score": "low effort", "modification_score": "high effort", "explanation": "x"}',),
                               ("{bad",)], "raw string")
    got = [tuple(r) for r in e.select(V.parse_effort("raw").alias("v")).select("v.comprehension_score", "v.explanation").collect()]
    assert got == [("low effort", "x"), (None, None)]
