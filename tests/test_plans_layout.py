"""Plan checks, the generators' output-tree layout, and a heavily skewed conversation."""

import json
import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qlift.operators import conversations as CV
from qlift.plans.registry import load_all
from qlift.sources import files

SF = "/root/testdata/sf0.001"
PY_NODES = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "PythonUDF", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("key", [k for k in sorted(load_all()) if k[0] in "abcdefg"])
def test_no_python_in_relational_plans(spark, key):
    df = load_all()[key].fn(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(n in plan for n in PY_NODES), key


def test_read_output_tree_reference_layout(spark):
    root = tempfile.mkdtemp()
    for model in ("model_a", "model_b"):
        os.makedirs(os.path.join(root, model))
        for level in (1, 4):
            with open(os.path.join(root, model, f"level{level}.jsonl"), "w") as f:
                f.write(json.dumps({"query_id": level, "draft": f"{model}-{level}"}) + "\n")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("draft", T.StringType())])
    got = sorted((r.model, r.level, r.draft) for r in files.read_output_tree(spark, root, schema).collect())
    assert got == [("model_a", 1, "model_a-1"), ("model_a", 4, "model_a-4"),
                   ("model_b", 1, "model_b-1"), ("model_b", 4, "model_b-4")]


def test_followups_on_one_hot_conversation(spark):
    # one conversation holds a third of all turns: the pairs must still equal a lag() reference
    rows = [(0, t, f"w{t % 13} x{t % 7}") for t in range(3000)] + [(c, t, f"c{c} t{t}") for c in range(1, 2001) for t in range(3)]
    q = spark.createDataFrame(rows, "conv_id long, turn long, query string").withColumn("query_id", F.col("conv_id") * 10000 + F.col("turn"))
    got = CV.followup_pairs(q).select("conv_id", "turn", "prev_turn")
    w = Window.partitionBy("conv_id").orderBy("turn")
    ref = q.select("conv_id", "turn", F.lag("turn").over(w).alias("prev_turn")).filter("prev_turn IS NOT NULL")
    assert got.count() == ref.count() == 2999 + 2000 * 2
    assert got.exceptAll(ref).count() == 0
    ctx = CV.session_context(q, "conv_id", "turn", "query", 2).filter("conv_id = 0 AND turn = 2").first().context
    assert ctx == "w0 x0 | w1 x1"
