"""Receipts: resuming, replacing arms, rescoring and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A

KEY = ["problem_id", "arm", "budget"]


def grid(problems: DataFrame, arms, budgets, id_col: str = "problem_id") -> DataFrame:
    """Every (problem, arm, budget): constants are exploded onto the rows, nothing is joined."""
    return problems.select(F.col(id_col).alias("problem_id"), F.explode(F.array(*map(F.lit, arms))).alias("arm")).select("*", F.explode(F.array(*map(F.lit, budgets))).alias("budget"))


def remaining(cells: DataFrame, done: DataFrame, key=KEY) -> DataFrame:
    return cells.join(done.select(*key), key, "left_anti")


def remaining_of(problems: DataFrame, done: DataFrame, arms, budgets, id_col: str = "problem_id") -> DataFrame:
    """The rows of ``remaining(grid(...), done)``: done cells meet their problem as bits, so cells are made behind the shuffle, not before it."""
    cells = [(a, b) for a in arms for b in budgets]
    groups = [cells[k : k + 63] for k in range(0, len(cells), 63)]
    bit = lambda own: F.coalesce(*[F.when((F.col("arm") == a) & (F.col("budget") == b), F.lit(1 << i).cast("long")) for i, (a, b) in enumerate(own)], F.lit(0).cast("long"))
    held = done.groupBy("problem_id").agg(*[F.bit_or(bit(own)).alias(f"_held{g}") for g, own in enumerate(groups)])
    both = problems.select(F.col(id_col).alias("problem_id")).join(held, "problem_id", "left")
    open_ = lambda g, own: [F.when(F.coalesce(F.col(f"_held{g}").bitwiseAND(F.lit(1 << i).cast("long")) == 0, F.lit(True)), F.struct(F.lit(a).alias("arm"), F.lit(b).alias("budget"))) for i, (a, b) in enumerate(own)]
    left = F.array_compact(F.array(*[c for g, own in enumerate(groups) for c in open_(g, own)]))
    return both.select("problem_id", F.explode(left).alias("_cell")).select("problem_id", "_cell.arm", "_cell.budget")


def finished_problems(done: DataFrame, arms, budgets) -> DataFrame:
    """Problems with all their cells done."""
    full = len(arms) * len(budgets)
    return done.groupBy("problem_id").agg(F.count_distinct("arm", "budget").alias("cells")).where(F.col("cells") == full)


def replace_arms(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows of other arms and all new rows; arms are a dimension, so they are broadcast and the old rows are not shuffled to a task an arm."""
    return old.join(F.broadcast(new.select("arm").distinct()), "arm", "left_anti").select(*old.columns).unionByName(new)


def rescored(traces: DataFrame, limit: int = 512) -> DataFrame:
    """Old lenient and new strict verdict for each completion."""
    c, truth = F.col("completion"), F.col("ground_truth")
    new = A.strict(c, F.col("tokens_emitted"), F.lit(limit))
    rows = traces.withColumn("_n", new).withColumn("_o", A.lenient(c))
    return rows.select("trace_id", "category", A.verify_lenient(F.col("_o"), truth, F.col("category")).alias("old_correct"), A.verify_strict(F.col("_n.answer"), truth).alias("new_correct"), F.col("_n.method").alias("method"))


def transitions(scored: DataFrame, *keys: str) -> DataFrame:
    o, n = F.col("old_correct"), F.col("new_correct")
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(o).alias("old"), F.count_if(n).alias("new"), F.count_if(o & ~n).alias("flipped_to_fail"), F.count_if(~o & n).alias("flipped_to_pass"), F.count_if(o & n).alias("kept_pass"))


def manifest(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files read as binary."""
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def upsert(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    return old.join(new, key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
