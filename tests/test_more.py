import pytest
from pyspark.sql import functions as F

from tracequarry.functions import answers as A
from tracequarry.operators import executor
from tracequarry.plans import prompts


@pytest.mark.parametrize("a,b,plain,same", [("YES", "true", True, False), ("\\frac{1}{2}", "0.5", True, False), ("1/2", "0.5", True, True), ("1,000", "1000", True, False), ("3.00001", "3", True, True), ("x", "y", False, False), (None, "1", False, False)])
def test_plain_and_equivalent(one, a, b, plain, same):
    assert one(A.verify_plain, a, b) is plain and one(A.equivalent, a, b) is same


def test_symbolic_layer(spark):
    df = spark.createDataFrame([(1, "(x+1)^2", "x^2+2*x+1"), (2, "x+1", "x+2"), (3, "7", "7"), (4, "__import__('os')", "1"), (5, None, "1")], "trace_id long, answer string, ground_truth string")
    assert {r.trace_id: r.method for r in executor.verify_symbolic(df).collect()} == {1: "symbolic", 2: "fail", 3: "string_exact", 4: "fail", 5: "fail"}


def test_prompts(spark):
    df = spark.createDataFrame([("A", "q"), ("Z", "q")], "arm string, p string")
    assert [r.v for r in df.select(prompts.prompt_for(F.col("arm"), F.col("p"), {"A": "Think. {prompt}"}).alias("v")).collect()] == ["Think. q", "q"]
    assert prompts.choose_arms(["A_cot", "B_reg"], ["reg"]) == ["B_reg"]


def test_streamed_steps(spark, tmp_path):
    from tracequarry.streaming.traces import run_steps

    parts = [[("t", 0, "checkpoint(A)"), ("t", 1, "x=1")], [("t", 2, "backtrack(A)"), ("t", 3, "verify(x == 1)✗"), ("u", 0, "y=2")]]
    schema = "trace_id string, step_index int, step string"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = run_steps(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.trace_id, r.step_index): (r.step_type, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("t", 1)] == ("assignment", "1") and got[("t", 2)][0] == "backtrack" and "not defined" in got[("t", 3)][1] and got[("u", 0)] == ("assignment", "2")
