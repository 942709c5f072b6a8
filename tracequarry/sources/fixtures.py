"""Reasoning-trace tables derived deterministically from the driver's star schema, in integer arithmetic.

The trace and receipt expressions are SQL that Spark and DuckDB read alike, so that checks start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arms of an evaluation with their index, and token budgets.
ARMS = (("A", 0), ("B", 1), ("C", 2), ("D", 3), ("E", 4), ("F", 5))
BUDGETS = (256, 512, 1024, 2048)
MAX_TOKENS = 512

RAW_TOKENS = "8 + (o_orderkey * 31 + ix * 97 + length(o_orderpriority) * 13) % 1500"

#: One completion for each order, by template; `w` is right except for every seventh order.
TRACE = """CASE o_orderkey % 10
 WHEN 0 THEN '<reg:bypass>' || w || '</reg:bypass>'
 WHEN 1 THEN '<reg:intent>intent: greet | strategy: validate | tone: calm</reg:intent>'
 WHEN 2 THEN '<think><reg:plan>concept: linear_sum | identity: a plus b | strategy: direct | level: ' || CAST(o_orderkey % 3 AS STRING) || '</reg:plan><reg:deduce>let(a=' || a || ') | ' || a || '+' || b || '→' || w || ' ∴ ans = ' || w || '</reg:deduce><reg:verify>verify(' || a || '+' || b || ' == ' || w || ')✓</reg:verify></think><ans>' || w || '</ans>'
 WHEN 3 THEN '<reg:deduce>n=' || a || ' | n=' || c || ' | total=' || w || '</reg:deduce><reg:verify>FAIL</reg:verify>'
 WHEN 4 THEN 'Adding the parts gives ' || chr(92) || 'boxed{' || w || '} as required'
 WHEN 5 THEN 'x=' || w || ' ∴ ans = ' || w
 WHEN 6 THEN '<think>let(x=' || a || ') | x+1'
 WHEN 7 THEN '<reg:scratchpad depth="' || CAST(o_orderkey % 5 + 1 AS STRING) || '" domain="algebra">checkpoint(CP1) | guess=' || a || ' | verify(guess == ' || t || ')✗ | backtrack(CP1) | replan(sum) | x=' || a || '+' || b || ' | verify(x == ' || w || ')✓ | ∴ ans = ' || w || '</reg:scratchpad>'
 WHEN 8 THEN '<think>let(tot=' || a || ') | tot+=' || b || '→' || w || ' | verify(tot == ' || w || ')✓ ∴ ans=' || w || '</think>' || chr(10) || '<ans>' || w || '</ans>'
 ELSE 'let me think step by step. first we add then stop. therefore the answer is ' || w || '. so so so so so so so so' END"""

PARTS = {
    "t": "CAST(o_custkey AS STRING)",
    "w": "CAST(o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS STRING)",
    "a": "CAST(o_custkey % 100 AS STRING)",
    "b": "CAST(o_custkey - o_custkey % 100 AS STRING)",
    "c": "CAST(o_custkey % 100 + o_orderkey % 2 AS STRING)",
}


#: Completions by the answer grammar, whole and broken in eight ways; the rest as above.
TAGGED = """CASE o_orderkey % 14
 WHEN 0 THEN '<think>' || nl || '<reg:bypass>' || w || '</reg:bypass>' || nl || '</think>' || nl || '<ans>' || w || '</ans>'
 WHEN 1 THEN '<think>' || nl || '<reg:plan>concept: sum</reg:plan>' || nl || '<reg:deduce>' || a || '+' || b || '→' || w || '</reg:deduce>' || nl || '<reg:verify>✓</reg:verify>' || nl || '</think>' || nl || '<ans>' || w || '</ans>'
 WHEN 2 THEN '<think>' || nl || '<reg:plan>concept: sum' || nl || 'level: 1</reg:plan>' || nl || '<reg:deduce>' || w || '</reg:deduce>' || nl || '</think>' || nl || '<ans>' || w || '</ans>'
 WHEN 3 THEN '<think><reg:plan>concept: sum</reg:plan></think>'
 WHEN 4 THEN '<think>' || nl || '<reg:deduce>' || w || '</reg:deduce>' || nl || '</think>' || nl || '<ans>' || w || '</ans>'
 WHEN 5 THEN '<think>' || nl || '<reg:bypass></reg:bypass>' || nl || '</think>'
 WHEN 6 THEN '<think>' || nl || '<reg:plan>p</reg:plan>' || nl || '<reg:deduce>' || w || '</reg:deduce><reg:verify>✓</reg:verify>' || nl || '</think>' || nl || '<ans>' || w || '</ans>'
 WHEN 7 THEN '<think>' || nl || '<reg:plan>p</reg:plan>' || nl || '<reg:deduce>' || a || ' < ' || w || '</reg:deduce>' || nl || '</think>' || nl || '<ans>' || w || '</ans>'
 WHEN 8 THEN '<think>' || nl || '<reg:plan>p</reg:plan>' || nl || '<reg:deduce>' || w || '</reg:deduce>' || nl || '<reg:verify>' || b || '</reg:verify>' || nl || '</think>'
 WHEN 9 THEN '<think>' || nl || '<reg:bypass>' || w || '</reg:bypass>' || nl || '</think>' || nl || '<ans>' || w || '</ans>' || nl
 WHEN 10 THEN '<think>' || nl || '<reg:plan>p</reg:plan>' || nl || '<reg:deduce>' || w
 WHEN 11 THEN '<think>' || nl || '<reg:bypass>' || w || '</reg:bypass>' || nl || '</think>' || nl || '<ans>' || substring('</ans>', 1, CAST(o_orderkey % 7 AS INT))
 ELSE completion END"""


def tagged_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, completion): traces that follow the answer grammar for a while, each to another point."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    rows = orders.select("*", *[F.expr(e).alias(k) for k, e in PARTS.items()], F.lit("\n").alias("nl"))
    return rows.withColumn("completion", F.expr(TRACE)).select(F.col("o_orderkey").alias("trace_id"), F.expr(TAGGED).alias("completion"))


TAGGED_SQL = f"""
tagged AS (
  SELECT o_orderkey AS trace_id, {TAGGED.replace("AS INT)", "AS INTEGER)")} AS completion
  FROM (SELECT *, {TRACE} AS completion, chr(10) AS nl FROM (SELECT *, {", ".join(f"{e} AS {k}" for k, e in PARTS.items())} FROM orders)))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer splits than there are cores, dealt out evenly; larger ones stay as their files are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a narrow table that a task gets at most, about.
ROWS_A_TASK = 100_000


def dealt(df: DataFrame) -> DataFrame:
    """A narrow table dealt out evenly to as many tasks as its rows ask for, whatever the row groups of its files, so that no task grows with the table."""
    wanted = -(-df.count() // ROWS_A_TASK)
    return df.repartition(max(wanted, df.sparkSession.sparkContext.defaultParallelism))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (problem, arm, budget): orders exploded over two constant dimensions, so no join at all."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate"))
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(i).alias("ix")) for a, i in ARMS]))
    rows = orders.select("*", arms.alias("_a")).select("*", "_a.arm", "_a.ix", F.explode(F.array(*map(F.lit, BUDGETS))).alias("budget")).withColumn("raw", F.expr(RAW_TOKENS))
    tokens = F.least("budget", "raw")
    truncated = F.col("raw") >= F.col("budget")
    return rows.select(
        F.col("o_orderkey").alias("problem_id"), "arm", "ix", "budget", F.col("o_orderpriority").alias("category"), F.year("o_orderdate").alias("year"),
        (F.col("o_orderkey") % 20 == 0).alias("is_contaminated"), tokens.alias("tokens_emitted"), truncated.alias("truncated"),
        (~truncated & ((F.col("o_orderkey") * 7 + F.col("ix") * 3) % 10 < 3 + F.col("ix"))).alias("is_correct"), (tokens * (1400 + 50 * F.col("ix"))).alias("mj"),
    )


RECEIPTS_SQL = f"""
arms(arm, ix) AS (VALUES {", ".join(f"('{a}', {i})" for a, i in ARMS)}), budgets(budget) AS (VALUES {", ".join(f"({b})" for b in BUDGETS)}),
receipts AS (
  SELECT o_orderkey AS problem_id, arm, ix, budget, o_orderpriority AS category, year(o_orderdate) AS year, o_orderkey % 20 = 0 AS is_contaminated,
    least(budget, raw) AS tokens_emitted, raw >= budget AS truncated, raw < budget AND (o_orderkey * 7 + ix * 3) % 10 < 3 + ix AS is_correct,
    least(budget, raw) * (1400 + 50 * ix) AS mj
  FROM (SELECT *, {RAW_TOKENS} AS raw FROM orders, arms, budgets))
"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, completion, ground_truth, tokens_emitted, category) for each order."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"))
    rows = orders.select("*", *[F.expr(e).alias(k) for k, e in PARTS.items()])
    return rows.select(
        F.col("o_orderkey").alias("trace_id"), F.expr(TRACE).alias("completion"), F.col("t").alias("ground_truth"), (8 + F.col("o_orderkey") * 31 % 700).alias("tokens_emitted"), F.col("o_orderpriority").alias("category")
    )


TRACES_SQL = f"""
traces AS (
  SELECT o_orderkey AS trace_id, {TRACE} AS completion, t AS ground_truth, 8 + o_orderkey * 31 % 700 AS tokens_emitted, o_orderpriority AS category
  FROM (SELECT *, {", ".join(f"{e} AS {k}" for k, e in PARTS.items())} FROM orders))
"""


def power_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, t, watts): events as irregular power samples, with whole microseconds as time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.col("value") * 1000).cast("long").alias("mw"), "event_id")
