"""Readers and writers of JSON records, with the defaults that each consumer applies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import found, stripped


# -- scans ------------------------------------------------------------------------------------------------------
def read_strict(spark: SparkSession, path, schema: str) -> DataFrame:
    """One record per line; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path, schema: str) -> DataFrame:
    """One record per line; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_quarantined(spark: SparkSession, path, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good records, malformed lines)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = rows.where("r._bad is null").select("r.*").drop("_bad")
    return good, rows.where("r._bad is not null").select(F.col("value").alias("line"))


def read_report_items(spark: SparkSession, path) -> DataFrame:
    """The items of nested report documents."""
    return spark.read.schema(schemas.REPORT).option("multiLine", True).json(path).select(F.inline("itemized_results"))


def read_arm_receipts(spark: SparkSession, path) -> DataFrame:
    """A row for each item and arm of documents that map arms to results."""
    items = spark.read.schema(schemas.ARM_RECEIPTS).option("multiLine", True).json(path).select(F.inline("items"))
    return items.select("id", "category", "ground_truth", F.explode("arms").alias("arm", "v")).select("id", "category", "ground_truth", "arm", "v.*")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found_ = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found_ is not None and len(found_) > 0


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths (or globs) that are there, in any store Spark reads."""
    return [p for p in paths if _exists(spark, p)]


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next(iter(existing(spark, paths)), None)


def read_all(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The union of the files that exist; none gives an empty table."""
    there = existing(spark, paths)
    return spark.read.schema(schema).json(there) if there else spark.createDataFrame([], schema)


def read_latest(spark: SparkSession, folder: str, glob: str, schema: str) -> DataFrame:
    """The most recently changed file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    newest = files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).collect()
    return read_tolerant(spark, newest[0]["path"], schema) if newest else spark.createDataFrame([], schema)


# -- loaders ------------------------------------------------------------------------------------------------------
def _given(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def _prompt() -> Column:
    return F.coalesce(_given("prompt", "question", "problem"), F.get("messages", F.lit(1))["content"])


def load_for(consumer: str, rows: DataFrame) -> DataFrame:
    """The projection of one consumer: ``grpo``, ``stage4`` or ``stage5``.  Rows without a prompt drop out."""
    answer = F.coalesce(_given("ground_truth", "answer"), F.lit(""))
    if consumer == "grpo":
        kept = rows.select(_prompt().alias("prompt"), answer.alias("answer"), F.coalesce(_given("register", "domain"), F.lit("symbolic_deductive")).alias("register"), "concept", "expected_type")
    elif consumer == "stage4":
        register = F.coalesce(_given("register", "type"), F.lit("symbolic_deductive"))
        kept = rows.select(_prompt().alias("prompt"), answer.alias("answer"), answer.alias("answers"), register.alias("register"), register.alias("registers"))
    elif consumer == "stage5":
        kept = rows.select(_prompt().alias("prompt"), answer.alias("answer"), F.coalesce(_given("register"), F.lit("symbolic_deductive")).alias("register"), F.coalesce(_given("cognitive_depth"), F.lit("Δ1")).alias("cognitive_depth"))
    else:
        raise ValueError(consumer)
    return kept.where("prompt is not null")


def load_benchmark(rows: DataFrame) -> DataFrame:
    """Prompt id, category, truth and baseline with the defaults of evaluation."""
    number = F.format_string("Q-%03d", F.monotonically_increasing_id() + 1)
    columns = set(rows.columns)
    have = lambda *names: [F.col(n).cast("string") for n in names if n in columns]
    return rows.select(
        F.coalesce(*have("eval_id", "id"), number).alias("id"), F.coalesce(*have("category", "source_benchmark"), F.lit("unknown")).alias("category"), F.coalesce(*have("prompt", "question"), F.lit("")).alias("prompt"),
        F.coalesce(*have("ground_truth", "answer"), F.lit("")).alias("ground_truth"), F.coalesce(*[c.try_cast("int") for c in have("english_baseline_tokens", "baseline_cot_tokens")], F.lit(250)).alias("baseline_tokens"),
    )


def parse_worked_answers(rows: DataFrame, text_col: str = "answer") -> DataFrame:
    """Truth behind ``####`` without commas and the reasoning before it; rows without the mark drop out."""
    c = F.col(text_col)
    return rows.withColumn("truth", F.replace(found(c, r"####\s*([\-\d,\.]+)"), F.lit(","), F.lit(""))).withColumn("reasoning", stripped(F.substring_index(c, "####", 1))).where("truth is not null")


def parse_levelled(rows: DataFrame, max_level: int = 3, text_col: str = "solution") -> DataFrame:
    """Solutions up to a level, with the first boxed answer; rows without one drop out."""
    level = F.regexp_extract("level", r"(\d+)", 1).try_cast("int")
    return rows.withColumn("truth", found(F.col(text_col), r"\\boxed\{([^}]+)\}")).where((F.coalesce(level, F.lit(0)) <= max_level) & F.col("truth").isNotNull())


def contamination_index(documents: DataFrame, *columns: str) -> DataFrame:
    """Distinct ids of the given array columns."""
    return reduce(DataFrame.union, [documents.select(F.explode(c).alias("id")) for c in columns]).distinct()


def training_text(rows: DataFrame) -> DataFrame:
    """One text column from records of either shape, without an opening thought mark."""
    chosen = F.coalesce(F.nullif(F.col("full_target"), F.lit("")), F.get("messages", F.lit(2))["content"])
    return rows.select("id", _prompt().alias("prompt"), F.regexp_replace(chosen, r"^<think>\n", "").alias("target")).where("target is not null")


#: The marks that a training text is wrapped in.
WRAPPING = {"begin": "<｜begin of sentence｜>", "user": "<｜User｜>", "assistant": "<｜Assistant｜>", "end": "<｜end of sentence｜>"}


def wrapped_text(rows: DataFrame, marks: dict[str, str] = WRAPPING) -> DataFrame:
    """(id, prompt_text, full_text) of training records of either shape: the prompt up to the opened thought, and the whole.

    A record with ``full_target`` loses the thought mark that its target begins with.  One with ``messages`` takes its last turn as the answer and the one before as the
    prompt; thought marks inside the answer go.  A record with neither is an error, as a file of another kind would otherwise pass unseen.
    """
    target, messages = F.col("full_target"), F.col("messages")
    answer = F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))
    asked = F.when(F.size(messages) > 1, F.coalesce(F.try_element_at(messages, F.lit(-2))["content"], F.lit(""))).otherwise(F.lit(""))
    plain = F.replace(F.replace(answer, F.lit("<think>\n"), F.lit("")), F.lit("<think>"), F.lit(""))
    other = F.raise_error(F.concat(F.lit("neither full_target nor messages: "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("string")
    body = F.when(target.isNotNull(), F.regexp_replace(target, r"^<think>\n?", "")).when(messages.isNotNull(), plain).otherwise(other)
    prompt = F.when(target.isNotNull(), F.coalesce("prompt", F.lit(""))).otherwise(asked)
    opened = F.concat(F.lit(marks["begin"] + marks["user"]), prompt, F.lit(marks["assistant"] + "<think>\n"))
    return rows.select("id", opened.alias("prompt_text"), F.concat(opened, body, F.lit(marks["end"])).alias("full_text"))


# -- sinks ------------------------------------------------------------------------------------------------------
def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; letters outside ASCII stay as they are, absent values are left out."""
    df.write.mode(mode).json(path)


def write_receipts(df: DataFrame, path: str, mode: str = "append") -> None:
    """A table partitioned by what every report filters on; rows are gathered by partition first, large ones over several tasks."""
    df.hint("rebalance", "arm", "budget").write.mode(mode).partitionBy("arm", "budget").parquet(path)


def overwrite_arms(df: DataFrame, path: str) -> None:
    """Replaces only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("arm", "budget").parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def matches_pin(digests: DataFrame, pins: dict[str, str]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for k, v in pins.items() for x in (k, v.lower())])
    return digests.withColumn("matches", F.col("sha256") == F.try_element_at(table, F.col("name")))


def write_splits(df: DataFrame, path: str, split_col: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split_col).json(path)
