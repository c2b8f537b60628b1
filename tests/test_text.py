"""B1-B14 on hand-made rows and against plain-Python re-statements."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qlift.functions import templates as TP
from qlift.functions import text as TX


def py_normalize(t, lower=True, strip=True):
    if lower:
        t = t.lower()
    if strip:
        t = t.strip()
    return re.sub(r"\s+", " ", t)


def py_truncate(t, n):
    return " ".join(t.split(" ")[-n:])[-5 * n:]


def one(spark, col, rows, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(col).collect()]


def test_normalize_cases(spark):
    rows = ["a\tb", "a\nb", "a b", "a b", "a\u001cb", "  \t mixed  CASE \n", "", None]
    got = one(spark, TX.normalize("x").alias("y"), rows)
    exp = [None if r is None else py_normalize(r) for r in rows]
    assert got == exp
    got2 = one(spark, TX.normalize("x", lower=False, strip=False).alias("y"), rows)
    assert got2 == [None if r is None else re.sub(r"\s+", " ", r) for r in rows]


def test_truncate_cases(spark):
    long_word = "x" * 500
    rows = ["a b", "a b c d", "one  two   three", long_word, "w " * 100]
    got = one(spark, TX.truncate_tail("x", 3).alias("y"), rows)
    assert got == [py_truncate(r, 3) for r in rows]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=8))
def test_normalize_truncate_property(spark, texts):
    got = one(spark, TX.truncate_tail(TX.normalize("x"), 4).alias("y"), texts)
    exp = [py_truncate(py_normalize(t), 4) for t in texts]
    assert got == exp


def test_merge_prefix_suffix(spark):
    df = spark.createDataFrame([("how to ",), ("how to ba",), ("ba",), ("",)], "p string")
    got = [r[0] for r in df.select(TX.merge_prefix_suffix("p", F.lit("bake"))).collect()]
    assert got == ["how to bake", "how to bake", "bake", "bake"]


def test_split_lang(spark):
    df = spark.createDataFrame([("no tab",), ("pre\tfr",), ("a\tb\tc",)], "l string")
    got = [tuple(r) for r in df.select(TX.split_lang("l").alias("s")).select("s.prefix", "s.lang").collect()]
    assert got == [("no tab", "en"), ("pre", "fr"), ("a\tb\tc", "en")]


def test_extract_after_marker(spark):
    rows = ["no marker", "q ###> answer  \n", "a ###> b ###> c", "q ###> "]
    got = one(spark, TX.extract_after_marker("x").alias("y"), rows)
    assert got == ["", "answer", "", ""]


def test_extract_by_offset(spark):
    df = spark.createDataFrame([("plain text", 2), ("x ##query##: abc reply", 3), ("##query##: a ##query##: bb tail", 2)],
                               "t string, n int")
    got = [r[0] for r in df.select(TX.extract_by_offset("t", F.col("n"))).collect()]
    exp = ["plain text"[4:], " abc reply"[5:], " bb tail"[4:]]
    assert got == exp


def test_render_keeps_values_verbatim(spark):
    tpl = "A: #a# B: #b#"
    df = spark.createDataFrame([('say "hi" \\ $1 #b#\nnext', "two")], "a string, b string")
    raw = df.select(TP.render(tpl, {"a": "a", "b": "b"}, json_mode=False)).first()[0]
    assert raw == 'A: say "hi" \\ $1 #b#\nnext B: two'
    js = df.select(TP.render(tpl, {"a": "a", "b": "b"})).first()[0]
    assert js == "A: " + json.dumps('say "hi" \\ $1 #b#\nnext', ensure_ascii=False) + ' B: "two"'


def test_json_field(spark):
    rows = ['{"enhanced_query": "x"}', "{bad", '{"other": 1}']
    assert one(spark, TX.json_field("x", "enhanced_query").alias("y"), rows) == ["x", None, None]


def test_training_text_roundtrip(spark):
    df = spark.createDataFrame([("q one", "better q  ")], "q string, e string")
    t = df.select(TX.training_text("q", "e").alias("t"))
    # the end marker stays (it is part of the completion); right-strip applies to what follows it
    got = t.select(TX.extract_after_marker(F.regexp_replace("t", re.escape(TX.END_MARK) + "$", "")).alias("x")).first()[0]
    assert got == "better q"


def test_completion_context_of_short_queries(spark, tmp_path):
    """Queries of fewer than three words (none, null) have empty suggestions."""
    from qlift.plans.text_q import b05

    rows = [(1, 0, "user", "hi"), (2, 0, "user", ""), (3, 0, "user", None), (4, 0, "user", "Two words"), (5, 0, "user", "a b c d")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.query_id: r.context for r in b05(spark, str(tmp_path)).collect()}
    assert got == {
        101: "### Related Searches: hi |  | , ### Previous Query: hi, ### Prefix: hi ### Completion: hi",
        202: "### Related Searches:  |  | , ### Previous Query: , ### Prefix:  ### Completion: ", 303: None,
        404: "### Related Searches: two | words | , ### Previous Query: two words, ### Prefix: two words ### Completion: Two words",
        505: "### Related Searches: a | b | c, ### Previous Query: a b c d, ### Prefix: a b c d ### Completion: a b c"}
