import pytest
from pyspark.sql import functions as F

from tracequarry.functions import answers as A
from tracequarry.functions import steps as S
from tracequarry.functions import text as T
from tracequarry.operators import energy, executor, rewards, stats, summaries
from tracequarry.plans import report

RECEIPT = "arm string, budget int, problem_id long, category string, is_correct boolean, truncated boolean, is_contaminated boolean, tokens_emitted long, mj long, latency_ms long, is_estimate boolean"


@pytest.fixture
def rows(spark):
    data = [(arm, 256, p, "c", p % 2 == 0 and arm != "B", False, False, 10 * (i + 1), 1000 * (i + 1) + p, 500, arm == "D" and p == 3) for i, arm in enumerate("ABCD") for p in range(20)]
    return spark.createDataFrame(data, RECEIPT)


def test_valuation_and_ablation(rows):
    got = {r.arm: r for r in summaries.valuation(rows).collect()}
    assert (got["A"].n, got["A"].correct, got["A"].accuracy, got["A"].latency_per_correct, got["A"].mean_latency) == (20, 10, 0.5, 1.0, 0.5)
    assert got["B"].joules_per_correct is None and got["B"].latency_per_correct is None and [got[a].is_estimate for a in "ABCD"] == [False, False, False, True]
    cells = {r.arm: r for r in summaries.ablation(rows).collect()}
    assert cells["C"].compression == pytest.approx(1 / 3) and cells["D"].pass_per_token == 50 / 40 and cells["A"].min_tokens == cells["A"].max_tokens == 10
    assert summaries.valuation(rows.limit(0)).count() == 0


def test_decision_and_reports(rows):
    r = stats.decision_with_interval(rows, "C", "D", reps=400).first()
    assert r.excludes_zero and r.adds_format_value and r.verdict == "CONFIRMED"
    r = stats.decision_with_interval(rows, "D", "C", reps=400).first()
    assert r.excludes_zero and not r.adds_format_value and r.verdict == "CONFIRMED"
    r = stats.decision_with_interval(rows, "B", "C", reps=400).first()
    assert not r.excludes_zero and r.verdict == "NULL"
    assert "CONFIRMED" in report.valuation_report(rows, reps=100) and "compression" in report.ablation_report(rows) and r"\begin{tabular}{lccccc}" in report.comparison_report(rows)


def test_conversion(spark):
    df = spark.createDataFrame([("a", True, 10, 4), ("a", False, 0, 0), ("a", True, 0, 0), ("b", False, 3, 1)], "source string, converted boolean, english_tokens long, symbolic_tokens long")
    assert {tuple(r) for r in summaries.conversion(df).collect()} == {("a", 3, 2, 1, 0.8), ("b", 1, 0, 1, None)}
    assert [r.compression for r in summaries.token_audit(df).collect()] == [0.6, 1.0, 1.0, 0.667]
    assert tuple(summaries.token_savings(df.withColumn("latency_ms", F.lit(250))).first()) == (13, 5, pytest.approx(61.538461), 1.0)


def test_selections(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i == 4 else i % 3) for i in range(9)], "id long, s string, k int")
    assert {tuple(r) for r in summaries.dimensions(df, "s", "k").collect()} == {("s", "a"), ("s", "b"), ("k", "0"), ("k", "1"), ("k", "2"), ("k", None)}
    placed = summaries.numbered(df, "id").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(1, 10)) and placed[0].label == "EVAL-200-001" and sorted(r.id for r in placed) == list(range(9)) and summaries.numbered(df.limit(0), "id").count() == 0
    assert [r.s for r in summaries.ordered_distinct(df, "s", "id").collect()] == ["a", "b"] and [r.n for r in summaries.histogram(df, "s").collect()] == [5, 4]
    assert sorted((r.s, r.id) for r in summaries.first_of_each(df, ["s"], ["id"], 2).collect()) == [("a", 0), ("a", 2), ("b", 1), ("b", 3)]
    scored = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, is_correct boolean")
    assert [r.id for r in summaries.audited(df, scored, "id").where("is_correct").collect()] == [1]
    traces = spark.createDataFrame([("<ans>7</ans>", "7"), ("none", "7"), ("<ans>yes</ans>", "true")], "completion string, ground_truth string")
    assert tuple(summaries.plain_pass_rate(traces, A.grammar(F.col("completion")), A.verify_plain).first()) == (3, 2, pytest.approx(2 / 3))


@pytest.mark.parametrize("text,want", [("The answer is: 12 of 15", "12"), ("3 + 4 = 7.5.", "7.5"), ("Total cost\nin total he pays 18. ", "18"), ("the RESULT was about -4", "-4"), ("a 3 and 9 apples", "9"), ("none", None), (None, None)])
def test_english(one, text, want):
    assert one(A.english, text) == want


def test_texts(one):
    assert one(T.head, "x" * 900) == "x" * 800 and one(T.tail, "ab" * 100) == "ab" * 60 and one(T.tail, "ab") == "ab"
    assert one(T.numbers, "a-3 b4.5") == ["-3", "4.5"] and one(T.code_blocks, "```python\nx=1\n```\n```python y```") == ["x=1", "y"]
    assert [one(T.model_family, n) for n in ("Qwen2TokenizerFast", "LlamaTokenizer", "GPT2")] == ["Qwen", "LLaMA", "Universal CausalLM"]
    assert one(lambda c: A.cut_off(F.lit(512), F.lit(512), c), "no end") and not one(lambda c: A.cut_off(F.lit(512), F.lit(512), c), "\\boxed{1}")
    assert tuple(one(S.step_counts, "let(x=1) | x+1→2 | verify(x==1)✓ | concept: a ∴ ans=2")) == (4, 1, 1, 1, 1)


def test_concepts(spark, one):
    plan = "<think><reg:plan>concept: Linear_Sum | strategy: direct</reg:plan><reg:deduce>a=1 ∴ ans=1</reg:deduce></think><ans>1</ans>"
    score = lambda expected: one(lambda c: rewards.concept_alignment(S.declared_concept(c, S.document(c)["register_type"]), F.lit(expected).cast("string")), plan)
    assert [score(e) for e in ("linear", "the linear_sum of two", "crt", "", None)] == [0.5, 0.5, 0.3, 0.3, 0.3]
    assert one(lambda c: rewards.concept_alignment(S.declared_concept(c, S.document(c)["register_type"]), F.lit("x")), "<reg:bypass>6</reg:bypass>" + plan) == 0.0
    assert one(lambda c: rewards.form_and_noise(c, S.document(c)["is_valid"]), "<think>x <b") == pytest.approx(-1.3) and one(lambda c: rewards.form_and_noise(c, S.document(c)["is_valid"]), "a=1 ∴ ans=1") == pytest.approx(0.7)
    df = spark.createDataFrame([(1, plan, "1", "linear"), (2, plan, "1", None)], "trace_id long, completion string, ground_truth string, concept string")
    got = {r.trace_id: r.concept for r in executor.composite_reward(df, concept_col="concept").collect()}
    assert got[1] == pytest.approx(0.18) and got[2] == pytest.approx(0.1)


def test_dynamic_energy(spark):
    samples = spark.createDataFrame([("two", 0, 10_000), ("two", 2_000_000, 10_000), ("one", 5, 8_000), ("low", 5, 10)], "run_id string, t long, mw long")
    runs = spark.createDataFrame([(r, 3_000_000, m) for r, m in (("two", True), ("one", True), ("low", True), ("none", True), ("cpu", False), ("odd", None))], "run_id string, duration_us long, has_meter boolean")
    got = {r.run_id: (r.joules, r.is_estimate) for r in energy.dynamic(samples, runs, idle_mw=5_000).collect()}
    assert got == {"two": (10.0, False), "one": (9.0, False), "low": (0.0, False), "none": (0.0, False), "cpu": (pytest.approx(99.75), True), "odd": (pytest.approx(99.75), True)}
    idle = spark.createDataFrame([("a", 10), ("a", 20), ("b", None)], "run_id string, mw long")
    assert {r.run_id: r.idle_mw for r in energy.idle_baseline(idle).collect()} == {"a": 15.0, "b": 6750.0}


def test_bootstrap_weights():
    import numpy as np

    w = stats.poisson_weights(np.arange(-500, 1500), 1000, 42)
    assert abs(w.mean() - 1) < 0.005 and abs(w.var() - 1) < 0.01 and abs((w == 0).mean() - np.exp(-1)) < 0.002
    assert abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.1 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08
    assert (stats.poisson_weights(np.arange(5), 10, 42) == stats.poisson_weights(np.arange(5), 10, 42)).all()
