"""Receipts at size: open cells behind the shuffle, replaced arms without one."""

from tracequarry.operators import receipts
from tracequarry.plans.catalogue import QUERIES
from tracequarry.sources.fixtures import receipts as receipts_view

SF = "/root/testdata/sf0.001"


def test_remaining_cells_are_listed(spark):
    """Every open cell is a row; null ids and ids given twice stay, and more than 63 cells take more than one set of bits."""
    problems = spark.createDataFrame([(1,), (2,), (2,), (None,)], "problem_id long")
    done = spark.createDataFrame([(1, "a0", 1), (1, "a9", 9), (2, "a3", 4), (2, "zz", 4), (None, "a1", 1), (2, None, 4)], "problem_id long, arm string, budget int")
    arms, budgets = [f"a{i}" for i in range(10)], list(range(10))
    rows = lambda df: sorted(map(str, df.collect()))
    got = rows(receipts.remaining_of(problems, done, arms, budgets))
    assert len(got) == 396 and got == rows(receipts.remaining(receipts.grid(problems, arms, budgets), done))
    listed = QUERIES["resume_remaining_cells"](spark, SF)
    assert listed.columns == ["problem_id", "arm", "budget"] and listed.count() == receipts_view(spark, SF).where("not is_correct").count()


def test_replaced_arms_are_broadcast(spark):
    """Old rows must not be shuffled by arm, which would be a task an arm."""
    rows = receipts_view(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "BroadcastHashJoin" in receipts.replace_arms(rows, rows.where("arm = 'A'"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
