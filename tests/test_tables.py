import json

import pytest
from pyspark.sql import functions as F

from tracequarry import schemas
from tracequarry.functions import mathx as M
from tracequarry.operators import curriculum, energy, generators, metrics, receipts, rewards
from tracequarry.plans import report
from tracequarry.sources import records


def rows(spark, data):
    return spark.createDataFrame([(a, b, ok, t, int(j * 1000), False, False, "x") for a, b, ok, t, j in data], "arm string, budget int, is_correct boolean, tokens_emitted int, mj long, truncated boolean, is_contaminated boolean, category string")


def test_overthinking(spark):
    r = metrics.overthinking(rows(spark, [("A", 512, True, 50, 1), ("A", 512, True, 500, 1), ("A", 512, False, 120, 1), ("A", 512, False, 300, 1)])).first()
    assert (r.n, r.accuracy, r.mean_tokens, r.oaa_64, r.oaa_512, r.token_efficiency) == (4, 0.5, 242.5, 0.25, 0.5, 1.0)
    assert r.overthinking_score == pytest.approx(2 / 3) and 0 < r.auc_oaa <= r.accuracy
    assert metrics.overthinking(rows(spark, [])).count() == 0


def test_choke(spark):
    r = {x.arm: x.choke_factor for x in metrics.budget_choke_factor(rows(spark, [("A", 256, False, 256, 150), ("A", 2048, True, 800, 450), ("B", 256, True, 6, 15), ("B", 2048, True, 6, 15)])).collect()}
    assert r == {"A": 1.0, "B": 0.0}


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(k, n) for n in (0, 1, 7, 200) for k in range(0, n + 1, max(1, n // 5))], "k long, n long")
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    for r in df.select("k", "n", lo.alias("lo"), hi.alias("hi")).collect():
        assert 0 <= r.lo <= (r.k / r.n if r.n else 0) <= r.hi + 1e-12 <= 1 + 1e-12


def test_number_theory(spark):
    df = spark.range(1)
    value = lambda c: df.select(c.alias("v")).first()["v"]
    lit = F.lit
    assert value(M.legendre_terms(lit(200), lit(3))) == [66, 22, 7, 2] and value(M.legendre(lit(200), lit(3))) == 97
    assert value(M.inverse_mod(lit(7), lit(11))) == 8 and value(M.inverse_mod(lit(4), lit(8))) is None
    pairs = lambda *p: F.array(*[F.struct(lit(r).cast("long").alias("r"), lit(m).cast("long").alias("m")) for r, m in p])
    assert value(M.solve_crt(pairs((4, 7), (9, 11)))) == 53 and value(M.solve_crt(pairs((1, 4), (2, 6)))) is None and value(M.solve_crt(pairs((2, 4), (4, 6)))) == 10
    assert [value(M.derangements(lit(n))) for n in range(6)] == [1, 0, 1, 2, 9, 44]
    assert value(M.power_mod(lit(7), lit(222), lit(13))) == pow(7, 222, 13) and value(M.euler_phi(lit(36))) == 12 and value(M.power_sum(lit(3), lit(4))) == 47 and value(M.choose(lit(10), lit(4))) == 210


def test_rewards_order(spark):
    texts = [("<ans>1</ans>", "1"), ("<think>" + "step " * 60 + "</think><ans>1</ans>", "1"), ("<ans>2</ans>", "1"), ("<ans>1</ans> loop loop loop loop loop loop loop", "1"), ("endphp <ans>1</ans>", "1")]
    df = spark.createDataFrame(texts, "c string, t string")
    p = [r.v for r in df.select(rewards.parsimony(F.col("c"), F.col("t")).alias("v")).collect()]
    assert p[0] > 1.5 and p[2] == -1.0 and p[0] > p[1] and p[3] < 0.5 and p[4] < 1.0
    s = [r.v for r in df.select(rewards.stage4(F.col("c"), F.col("t"), F.lit("x")).alias("v")).collect()]
    assert s[0] > 1.0 and s[3] < -1.5 and s[4] < -0.5


def test_selection(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else "a") for i in range(60)], "id long, s string")
    quota = curriculum.quota_fill(df, "s", "id", 33).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in quota} == {"a": 13, "b": 10, "c": 10}
    assert [r.s for r in curriculum.round_robin(df, ["s"], "id", 5).collect()] == ["a", "b", "c", "a", "b"]
    assert curriculum.stratified_sample(df, "s", "id", 4).count() == 12
    split = curriculum.split_rows(df, "id", 10)
    assert split.where("split = 'validation'").count() == 10 and split.count() == 60
    assert curriculum.split_rows(df.limit(0), "id", 10).count() == 0


def test_energy(spark):
    df = spark.createDataFrame([("r", 0, 10_000), ("r", 1_000_000, 20_000), ("r", 3_000_000, 20_000), ("s", 5, 10_000)], "run_id string, t long, mw long")
    got = {r.run_id: r.joules for r in energy.trapezoid(df, 0).collect()}
    assert got == {"r": 55.0, "s": 0.0}


def test_generated_rows(spark):
    df = generators.concept_curriculum(spark, 20).cache()
    assert df.groupBy("concept").count().where("concept not in ('factual_bypass', 'intent_dialogue')").select("count").distinct().collect()[0][0] == 20
    assert df.where("ground_truth is null or prompt is null or full_target is null").count() == 0
    for r in df.where("concept = 'chinese_remainder'").collect():
        x, (a, p, b, q) = int(r.ground_truth), [int(v) for v in __import__("re").findall(r"\d+", r.prompt)]
        assert x % p == a and x % q == b and x == min(v for v in range(p * q) if v % p == a and v % q == b)
    assert {r.depth: r["count"] for r in generators.depth_curriculum(spark).groupBy("depth").count().collect()} == {"Δ0": 300, "Δ1": 500, "Δ2": 450, "Δ3": 350}


def test_conversion(spark):
    texts = [(0, "Solve 3x + 6 = 21."), (1, "All cats are animals. Tom is a cat."), (2, "She has 5 apples. She gives 2. Then buys 4 more."), (3, "nothing here")]
    got = {r.trace_id: (r.answer, r.confidence) for r in generators.convert_solutions(spark.createDataFrame(texts, "trace_id long, completion string")).collect()}
    assert got == {0: ("5", 0.85), 1: ("True", 0.8), 2: ("7", 0.75)}


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","question":"q","answer":"a"}\n\nnot json\n{"id":"2","messages":[{"role":"s","content":"x"},{"role":"user","content":"p"}]}\n')
    path = str(tmp_path / "a.jsonl")
    good = records.read_tolerant(spark, path, schemas.TRAINING)
    assert sorted(r.prompt for r in records.load_for("grpo", good).collect()) == ["p", "q"]
    with pytest.raises(Exception):
        records.read_strict(spark, path, schemas.TRAINING).collect()
    ok, bad = records.read_quarantined(spark, path, schemas.TRAINING)
    assert ok.count() == 2 and len(bad.collect()) == 1
    assert records.first_existing(spark, [str(tmp_path / "none"), path]) == path
    assert records.read_all(spark, [str(tmp_path / "none")], schemas.TRAINING).count() == 0
    doc = {"model": "m", "itemized_results": [{"id": "1", "correct": True}, {"id": "2", "correct": False}]}
    (tmp_path / "r.json").write_text(json.dumps(doc, indent=1))
    assert records.read_report_items(spark, str(tmp_path / "r.json")).count() == 2
    arms = {"items": [{"id": "1", "arms": {"A": {"is_correct": True, "tokens": 3}, "B": {"is_correct": False, "tokens": 4}}}]}
    (tmp_path / "m.json").write_text(json.dumps(arms))
    assert {(r.arm, r.tokens) for r in records.read_arm_receipts(spark, str(tmp_path / "m.json")).collect()} == {("A", 3), ("B", 4)}
    assert records.matches_pin(records.file_digests(spark, path), {"a.jsonl": "00"}).first().matches is False
    gsm = spark.createDataFrame([("x #### 1,234",), ("none",)], "answer string")
    assert [(r.truth, r.reasoning) for r in records.parse_worked_answers(gsm).collect()] == [("1234", "x")]


def test_streamed_appends(spark, tmp_path):
    from tracequarry.streaming.receipts import append_once

    df = rows(spark, [("A", 256, True, 1, 1)]).withColumn("problem_id", F.lit("p"))
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        append_once(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_receipt_keys(spark):
    cells = receipts.grid(spark.createDataFrame([("p",), ("q",)], "problem_id string"), ["A", "B"], [1, 2])
    done = cells.where("problem_id = 'p'")
    assert receipts.remaining(cells, done).count() == 4 and receipts.finished_problems(done, ["A", "B"], [1, 2]).count() == 1


def test_report_and_functions(spark):
    from tracequarry.session import register_functions
    from tracequarry.sources.fixtures import receipts as view

    text = report.evaluation_report(view(spark, "/root/testdata/sf0.001"))
    assert text.count("\n## ") == 8 and "CONFIRMED" in text
    register_functions(spark)
    assert spark.sql("select audit_deduction('n=1 | n=2').is_valid v").first().v is False
    assert spark.sql("select * from run_scratchpad('x=1 | ans=1')").count() == 2
