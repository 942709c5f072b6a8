"""Queries that once ran over a part of their rows, on all of them."""

import numpy as np
from pyspark.sql import functions as F

from tracequarry.operators import metrics, stats
from tracequarry.plans.catalogue import QUERIES
from tracequarry.sources.fixtures import receipts as receipts_view

SF = "/root/testdata/sf0.001"


def test_receipts_stream_holds_all_budgets(spark):
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(QUERIES["receipts_stream"](spark, SF)) == rows(metrics.cell_summary(receipts_view(spark, SF)))


def test_scratchpads_of_small_answers(spark):
    """7 checks x == 94 on x = 93 and ends wrong; 17 marks a true check as false; 27 is right after one mend."""
    got = {r.trace_id: (r.depth, r.domain, r.n_steps, r.answer, r.failures, r.is_valid) for r in QUERIES["scratchpad_summary"](spark, SF).collect()}
    assert len(got) == 150
    assert got[7] == ("3", "algebra", 8, "94", 1, False) and got[17] == ("3", "algebra", 8, "99", 0, False) and got[27] == ("3", "algebra", 8, "131", 1, True)


def test_stage4_rewards_of_scratchpads(spark):
    """47 tokens, right, none of this reward's tags, so an empty tail: 1.2 + 0.5 * 3 / 50; a wrong one within 50 tokens gets 0."""
    got = {r.trace_id: r.reward for r in QUERIES["reward_stage4"](spark, SF).collect()}
    assert len(got) == 1500 and abs(got[17] - 1.23) < 1e-9 and got[7] == 0.0


def test_bootstrap_draws_as_many_as_the_reference(spark):
    got = QUERIES["paired_bootstrap"](spark, SF).collect()
    assert got and all(9_000 < r.n_reps <= 10_000 and r.lo <= r.hi for r in got)


def test_bootstrap_draws_once_for_equal_outcomes(spark):
    """Counts of problems weigh as their sum would, drawn once for each outcome; the normal limit tells the bounds."""
    w = stats.outcome_weights(np.array([5, 6, 7]), np.array([1, 40, 10**7]), 4000, 42)
    assert (w[0] == stats.poisson_weights(np.array([5]), 4000, 42)[0]).all()
    assert all(abs(x.mean() - n) < 0.08 * n**0.5 and abs(x.var() / n - 1) < 0.1 for x, n in zip(w, (1, 40, 10**7)))
    assert (w == stats.outcome_weights(np.array([5, 6, 7]), np.array([1, 40, 10**7]), 4000, 42)).all()
    given = spark.range(300_000).select((F.col("id") / 2).cast("long").alias("problem_id"), F.lit(256).alias("budget"), F.when(F.col("id") % 2 == 0, "C").otherwise("D").alias("arm"))
    k = F.col("problem_id")
    rows = given.select("*", (k % 3 < 2).alias("is_correct"), F.when(F.col("arm") == "C", 1000 + k % 2 * 10).otherwise(1500).cast("long").alias("mj"))
    assert stats.paired(rows, "C", "D").groupBy("ok_a", "ok_b", "mj_a", "mj_b").count().count() == 4
    r = stats.paired_bootstrap(rows, "C", "D").first()
    point = (1500 - 1005) * 1.5 / 1000
    spread = (r.hi - r.lo) / 2
    assert r.n_reps == 10_000 and abs((r.lo + r.hi) / 2 - point) < 0.001 and 0.5 < spread / (1.96 * point * (0.5 / 150_000) ** 0.5) < 1.5


def test_costly_parts_are_computed_once(spark):
    """A plan names a fold or a parse as often as it is computed; each of these once stood in its plan many times."""
    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("document_parse").count("reg:bypass") <= 6 and plan("reward_terms").count("lower(") <= 2 and plan("rescoring_transitions").count("lower(") <= 4
    assert plan("step_counts").count("replan") <= 3 and plan("invariant_diagnostics").count("replan") <= 6 and plan("convert_english").count("aggregate(") == 1
