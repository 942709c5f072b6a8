"""Queries over the engine's mechanisms: the answer grammar, stopping rules, receipts that arrive as a stream, padded batches, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar
from ..functions import registers as R
from ..functions import text as T
from ..functions.sql import register_sql_functions
from ..operators import collate, contrast, curriculum, energy, rollups, stopping, summaries
from ..session import delete_folder, shared_folder, swept
from ..sources import records, versions
from ..sources.fixtures import RECEIPTS_SQL, TAGGED_SQL, TRACES_SQL, spread, table, tagged_traces, traces
from ..sources.fixtures import receipts as receipts_view
from ..streaming.ledger import Ledger
from . import prompts
from .registry import ORACLES, query, wilson_sql

# A viable prefix of the grammar as nested optional groups, written by hand from its rules.
_TAIL = "</think>(\n(<ans>([^<]+(</ans>)?)?)?)?"
_VERIFY = f"<reg:verify>([^<]+(</reg:verify>(\n({_TAIL})?)?)?)?"
_DEDUCE = f"<reg:deduce>([^<]+(</reg:deduce>(\n({_TAIL}|{_VERIFY})?)?)?)?"
_PLAN = f"<reg:plan>([^<]+(</reg:plan>(\n({_DEDUCE})?)?)?)?"
_BYPASS = f"<reg:bypass>([^<]+(</reg:bypass>(\n({_TAIL})?)?)?)?"
_PREFIX = f"^(<think>(\n({_BYPASS}|{_PLAN})?)?)?"


@query(f"""WITH {TAGGED_SQL}, p AS (SELECT completion, regexp_extract(completion, '{_PREFIX}') AS head FROM tagged),
l AS (SELECT *, regexp_extract(head, '(?s).*(<[^>]*>)', 1) AS last, regexp_extract(head, '(?s).*>(.*)$', 1) AS rest FROM p),
s AS (SELECT head = completion AND last = '</ans>' AS accepted, length(head) AS read, CASE last
  WHEN '<think>' THEN CASE rest WHEN '' THEN 'root/think' ELSE 'root/think/register_sequence' END WHEN '<reg:bypass>' THEN 'root/think/register_sequence/bypass_branch'
  WHEN '<reg:plan>' THEN 'root/think/register_sequence/reasoning_branch/plan_block' WHEN '<reg:deduce>' THEN 'root/think/register_sequence/reasoning_branch/deduce_block'
  WHEN '<reg:verify>' THEN 'root/think/register_sequence/reasoning_branch/verify_block'
  WHEN '</reg:plan>' THEN CASE rest WHEN '' THEN 'root/think/register_sequence/reasoning_branch' ELSE 'root/think/register_sequence/reasoning_branch/deduce_block' END
  WHEN '</think>' THEN 'root/answer' WHEN '<ans>' THEN 'root/answer' WHEN '</ans>' THEN '' ELSE 'root/think' END AS open_rules, last FROM l)
SELECT open_rules, accepted, count(*) AS n, sum(read)::BIGINT AS letters, min(read)::BIGINT AS least, max(read)::BIGINT AS most FROM s GROUP BY open_rules, accepted""")
def grammar_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where traces leave the answer grammar: the rules open there, how many, and how far they got."""
    rows = tagged_traces(spark, sf_dir).select(grammar.parsed(F.col("completion")).alias("p")).select("p.*")
    read = F.col("read").cast("long")
    return rows.groupBy("open_rules", "accepted").agg(F.count(F.lit(1)).alias("n"), F.sum(read).alias("letters"), F.min(read).alias("least"), F.max(read).alias("most"))


def _stops_sql(source: str, key: str, window: int, least: int, shown: str) -> str:
    """First stop of each text of ``source(key, x)`` cut into runs of four letters; ``shown`` tells the closure in the tail ``t``."""
    return f"""n AS (SELECT {key}, x, unnest(range(1, (length(x) + 3) // 4 + 1)) AS pos FROM {source}),
t AS (SELECT {key}, pos, substr(x, greatest(0, pos - {window}) * 4 + 1, least(pos, {window}) * 4) AS t FROM n WHERE pos >= {least}),
s AS (SELECT {key}, pos, {shown} AS reason FROM t)
SELECT {key}, min(pos) AS pos, arg_min(reason, pos) AS reason FROM s WHERE reason IS NOT NULL GROUP BY {key}"""


#: Closures of a conversation: the end of a sentence or of a line.
SENTENCE = stopping.Rule(10, 4, (". ", "\n"))


@query("WITH c AS (SELECT conv_id, turn, text AS x FROM conversations), " + _stops_sql("c", "conv_id, turn", 10, 4, "CASE WHEN contains(t, '. ') THEN '. ' WHEN contains(t, chr(10)) THEN chr(10) END"))
def stop_points_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn's first sentence ends, by a ring of the last ten tokens."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return stopping.stop_points(stopping.pieces(turns, "text"), ["conv_id", "turn"], SENTENCE)


@query(f"WITH {TAGGED_SQL}, c AS (SELECT trace_id, CASE WHEN trace_id % 3 = 0 THEN 'C' ELSE 'A' END AS arm, completion AS x FROM tagged), stops AS (WITH " + _stops_sql("c", "trace_id, arm", 30, 4, r"""CASE WHEN contains(t, '</ans>') THEN '</ans>' WHEN contains(t, '</reg:bypass>') THEN '</reg:bypass>'
  WHEN regexp_matches(t, '\\boxed\{[^{}]*\}') THEN 'boxed' WHEN arm = 'C' AND contains(t, '</reg:verify>') THEN '</reg:verify>' END""") + ") SELECT arm, reason, count(*) AS n, sum(pos)::BIGINT AS tokens FROM stops GROUP BY arm, reason")
def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why and after how many tokens completions would have been stopped, by arm."""
    rows = tagged_traces(spark, sf_dir).select("trace_id", F.when(F.col("trace_id") % 3 == 0, "C").otherwise("A").alias("arm"), "completion")
    stops = stopping.stop_points_of(rows, "completion", ["trace_id", "arm"], stopping.ROBUST, arm_col="arm")
    return stops.groupBy("arm", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").cast("long").alias("tokens"))


@query(ORACLES["arm_budget_summary"])
def receipts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts arrive in five micro-batches, one of them twice; the result is the summary of what was stored, merged from the batches' sums."""
    base = shared_folder(spark, "receipts")
    rows = receipts_view(spark, sf_dir).select("problem_id", "arm", "budget", "is_correct", "truncated", "tokens_emitted", "mj")
    ledger = Ledger(spark, f"{base}/ledger", rows.schema)
    with swept(spark):
        for k in (0, 1, 2, 3, 1):
            rows.where(F.pmod("problem_id", F.lit(4)) == k).write.mode("append").parquet(f"{base}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
            ledger.run(source, f"{base}/checkpoint", every=2, report=lambda summary: summary.collect()).awaitTermination()
            delete_folder(spark, f"{base}/in")  # what is stored need not be kept as it arrived
        summary = ledger.refresh()
        told = spark.createDataFrame(summary.collect(), summary.schema)  # a row for each arm and budget
    delete_folder(spark, base)
    return told


@query("""WITH d AS (SELECT greatest(1, (len(string_split(text, ' ')) + 7) // 8) AS q, len(string_split(text, ' ')) AS tokens FROM documents WHERE text IS NOT NULL),
w AS (SELECT tokens, CASE WHEN q <= 16 THEN q ELSE (q + (1 << (length(bin(q - 1)) - 4)) - 1) // (1 << (length(bin(q - 1)) - 4)) * (1 << (length(bin(q - 1)) - 4)) END * 8 AS width FROM d)
SELECT width::BIGINT AS width, count(*) AS n, sum(tokens)::BIGINT AS tokens, (sum(width) - sum(tokens))::BIGINT AS padding, 0::BIGINT AS over_budget FROM w GROUP BY width""")
def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one padded batch of at most 16384 places; rows, tokens and padding by width, counted from the batches' masks."""
    words = F.split("text", " ")
    docs = spread(table(spark, sf_dir, "documents").where("text IS NOT NULL")).select("doc_id", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(50_000)).cast("int")).alias("ids"))
    return collate.padding_report(collate.collate(docs, id_col="doc_id", ids_col="ids"), 16_384)


@query("""WITH f AS (SELECT doc_id // 200 AS run, doc_id AS modified, strlen(text)::BIGINT AS bytes, doc_id % 23 <> 11 AS synced FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY modified DESC) AS rank, sum(bytes) OVER (PARTITION BY run ORDER BY modified DESC) AS bytes_so_far,
  sum(bytes) OVER (PARTITION BY run) AS whole, (SELECT min(x.modified) FROM f x WHERE x.run = f.run AND NOT x.synced) AS stop FROM f)
SELECT run, modified, rank::INTEGER AS rank, bytes_so_far::BIGINT AS bytes_so_far, rank > 20 AND (whole >= 500000 OR stop IS NULL OR modified < stop) AS "delete" FROM r""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files of a run go: documents as files, 200 a run, of which the 20 newest stay and 500 KB force."""
    files = table(spark, sf_dir, "documents").select(
        F.expr("doc_id div 200").alias("run"), F.col("doc_id").cast("string").alias("path"), F.col("doc_id").alias("modified"), F.octet_length("text").cast("long").alias("bytes"), (F.col("doc_id") % 23 != 11).alias("synced")
    )
    return versions.retention(files, keep=20, group=["run"], limit_bytes=500_000).select("run", "modified", "rank", "bytes_so_far", "delete")


_R = "WITH " + RECEIPTS_SQL
_LO, _HI = wilson_sql("correct", "n")


@query(f"""{_R}, s AS (SELECT *, unnest(CASE WHEN is_contaminated THEN ['all'] ELSE ['all', 'clean'] END) AS scope FROM receipts),
c AS (SELECT scope, arm, budget, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE truncated) AS truncated, sum(mj)::BIGINT AS mj, sum(tokens_emitted)::BIGINT AS tokens,
  count(*) FILTER (WHERE is_correct AND problem_id % 11 = 0) AS rescued FROM s GROUP BY GROUPING SETS ((scope, arm, budget), (scope, arm), (scope)))
SELECT scope, arm, budget, n, correct, round(correct::DOUBLE / n, 4) AS accuracy, round({_LO}, 4) AS ci_lo, round({_HI}, 4) AS ci_hi, truncated, round(mj / 1000.0e0, 2) AS total_joules,
  CASE WHEN correct > 0 THEN round(mj::DOUBLE / (correct * 1000), 2) END AS joules_per_correct, round(tokens::DOUBLE / n, 1) AS mean_tokens, rescued FROM c""")
def receipt_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, arms and the whole, of all and of clean receipts, with the answers that only the symbolic layer accepted."""
    method = F.when(F.col("is_correct") & (F.col("problem_id") % 11 == 0), rollups.RESCUED).otherwise("string_exact")
    return rollups.slices(receipts_view(spark, sf_dir).withColumn("verification_method", method))


_GRADED = """graded AS (SELECT trace_id, category, completion, CASE WHEN trace_id % 7 <> 3 THEN 2020 + trace_id % 5 END AS year, CASE trace_id % 4 WHEN 0 THEN 'Δ0' WHEN 1 THEN 'Δ1' WHEN 2 THEN '' END AS depth,
  strpos(completion, '>' || ground_truth || '<') > 0 AS is_correct, tokens_emitted, 40 + trace_id * 17 % 900 AS english_tokens, strpos(completion, '<reg:bypass>') > 0 AS bypass, strpos(completion, '<reg:plan>') > 0 AS plan,
  strpos(completion, '<reg:intent>') > 0 AS intent FROM traces)"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with a verdict, a year and a depth that some lack, English tokens, and the flags of their registers."""
    c, i = F.col("completion"), F.col("trace_id")
    flags = R.presence(c)
    rows = traces(spark, sf_dir).select(
        "trace_id", "category", "completion", F.when(i % 7 != 3, 2020 + i % 5).alias("year"), F.when(i % 4 == 0, "Δ0").when(i % 4 == 1, "Δ1").when(i % 4 == 2, "").alias("depth"),
        F.contains(c, F.concat(F.lit(">"), "ground_truth", F.lit("<"))).alias("is_correct"), "tokens_emitted", (40 + i * 17 % 900).alias("english_tokens"), flags.alias("f"), (T.trailing_noise(c) < 0).alias("noise"),
    )
    return rows.select("*", "f.bypass", "f.plan", "f.intent").drop("f")


@query(f"""WITH {TRACES_SQL}, {_GRADED}, d AS (SELECT *, unnest([{{'d': 'category', 'v': category}}, {{'d': 'year', 'v': CAST(year AS VARCHAR)}}, {{'d': 'depth', 'v': depth}}]) AS p FROM graded)
SELECT p.d AS dimension, p.v AS value, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, sum(tokens_emitted)::BIGINT AS symbolic_tokens, sum(english_tokens)::BIGINT AS english_tokens,
  count(*) FILTER (WHERE {" OR ".join(f"regexp_matches(completion, '{x.replace("'", "''")}')" for x in (*T.TRAILING_NOISE, T.OPEN_TAG_AT_END))}) AS noise_count, count(*) FILTER (WHERE bypass) AS bypass_count, count(*) FILTER (WHERE plan) AS plan_count,
  count(*) FILTER (WHERE intent) AS intent_count, round(count(*) FILTER (WHERE is_correct) * 100.0e0 / count(*), 2) AS accuracy, round((1 - sum(tokens_emitted)::DOUBLE / sum(english_tokens)) * 100.0e0, 2) AS compression
FROM d WHERE p.v IS NOT NULL AND p.v <> '' GROUP BY p.d, p.v""")
def rollup_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.by_dimension(graded(spark, sf_dir), "category", "year", "depth")


@query(f"""{_R}, r AS (SELECT *, CASE WHEN problem_id % 13 <> 0 THEN category END AS subject, mj // 40 AS ms FROM receipts),
c AS (SELECT arm, subject, grouping(subject) AS whole, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, sum(tokens_emitted)::BIGINT AS tokens, min(tokens_emitted) AS min_tokens, max(tokens_emitted) AS max_tokens,
  count(*) FILTER (WHERE truncated) AS t, sum(ms)::BIGINT AS ms FROM r GROUP BY GROUPING SETS ((arm), (arm, subject)))
SELECT arm, subject, n, correct, round(correct * 100.0e0 / n, 2) AS pass_at_1, round(tokens::DOUBLE / n, 1) AS mean_tokens, min_tokens, max_tokens, round(t * 100.0e0 / n, 2) AS truncation_rate, round(ms / 1000.0e0 / n, 2) AS mean_latency,
  round((correct * 100.0e0 / n) / (tokens::DOUBLE / n) * 1000.0e0, 2) AS information_efficiency, round(tokens::DOUBLE / n * 3.0e0, 1) AS traffic FROM c WHERE whole = 1 OR subject IS NOT NULL""")
def arm_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = receipts_view(spark, sf_dir).withColumns({"subject": F.when(F.col("problem_id") % 13 != 0, F.col("category")), "latency_ms": F.expr("mj div 40")}).withColumnRenamed("tokens_emitted", "tokens")
    return rollups.arms_by_subject(rows)


def _wide(sql: str) -> str:
    """SQL over receipts whose largest budget is not the usual one for most arms, and lacks for one."""
    return sql.replace("FROM receipts", "FROM (SELECT * REPLACE (CASE WHEN budget = 2048 THEN CASE arm WHEN 'A' THEN 1500 WHEN 'B' THEN 2048 ELSE 4096 END ELSE budget END AS budget) FROM receipts)")


@query(_wide(ORACLES["overthinking_oaa_auc"]).replace("SELECT *, CASE WHEN accuracy + token", """, b AS (SELECT arm, budget, accuracy FROM d), h AS (SELECT arm, coalesce(max(accuracy) FILTER (WHERE budget = 256), 0) AS acc_low,
  coalesce(max(accuracy) FILTER (WHERE budget = 2048), max(accuracy) FILTER (WHERE budget = 4096), 0) AS acc_high FROM b GROUP BY arm)
SELECT d.*, h.acc_low, h.acc_high, CASE WHEN acc_high > 1e-6 THEN (acc_high - acc_low) / acc_high WHEN acc_low <= 1e-6 THEN 0.0e0 ELSE -1.0e0 END AS choke_factor, CASE WHEN accuracy + token""").replace("AS overthinking_score FROM d", "AS overthinking_score FROM d JOIN h ON h.arm = d.arm"))
def overthinking_choke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overthinking with the choke factor where arms differ in their largest budget: at 2048, at the largest of all, or lacking."""
    wide = F.when(F.col("arm") == "A", 1500).when(F.col("arm") == "B", 2048).otherwise(4096)
    return rollups.overthinking_with_choke(receipts_view(spark, sf_dir).withColumn("budget", F.when(F.col("budget") == 2048, wide).otherwise(F.col("budget"))))


@query(f"""WITH {TRACES_SQL}, {_GRADED}, c AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE NOT ({" OR ".join(f"regexp_matches(completion, '{x.replace("'", "''")}')" for x in T.BROKEN_ENDINGS)})) AS clean,
  sum(tokens_emitted)::BIGINT AS tokens, sum(english_tokens)::BIGINT AS english FROM graded GROUP BY category)
SELECT category, n, correct, round(correct * 100.0e0 / n, 2) AS pass_at_1, round(clean * 100.0e0 / n, 2) AS cleanliness, tokens, english, round((1 - tokens::DOUBLE / english) * 100.0e0, 2) AS savings,
  round(correct * 100.0e0 / n * (1 + ln(greatest(1.0e0, english::DOUBLE / tokens))), 2) AS ock FROM c""")
def modern_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.modern_headline(graded(spark, sf_dir), "category", clean=T.is_clean(F.col("completion")))


@query(f"""SELECT g.trace_id, g.answer AS by_grammar, l.answer AS by_any, r.register_type, e.tokens FROM ({ORACLES["extract_grammar"]}) g JOIN ({ORACLES["extract_lenient"]}) l USING (trace_id) JOIN ({ORACLES["register_parse"]}) r USING (trace_id)
JOIN (WITH {TRACES_SQL} SELECT trace_id, list_sum(list_transform(list_filter(string_split_regex(completion, '\\s+'), lambda w: w <> ''), lambda w: length(w) - length(translate(w, '{T.OPERATORS}', '')) + greatest(1, length(translate(w, '{T.OPERATORS}', '')) // 4)))::BIGINT AS tokens FROM traces) e USING (trace_id)""")
def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions under their SQL names, called from SQL text."""
    register_sql_functions(spark)
    return spark.sql(
        """SELECT trace_id, extract_answer(completion, 'grammar') AS by_grammar, extract_answer(completion, 'lenient') AS by_any, parse_registers(strip_blanks(completion)).register_type AS register_type,
             cast(estimate_tokens(completion) AS bigint) AS tokens FROM {traces}""",
        traces=traces(spark, sf_dir),
    )


@query("""WITH s AS (SELECT CASE WHEN event_type = 'error' THEN 1000000 + event_id ELSE user_id END AS run_id, epoch_us(ts) AS t, floor(value * 1000)::BIGINT AS mw FROM events),
w AS (SELECT *, greatest(mw - 6750, 0) + lag(greatest(mw - 6750, 0)) OVER o AS q, t - lag(t) OVER o AS dt FROM s WINDOW o AS (PARTITION BY run_id ORDER BY t, mw)),
e AS (SELECT run_id, count(*) AS n, coalesce(sum(q::HUGEINT * dt)::DOUBLE, 0.0e0) / 2e9 AS joules, greatest(max(mw) - 6750, 0) AS above FROM w GROUP BY run_id),
r AS (SELECT run_id, greatest(max(t) - min(t), 1000000) AS us FROM s GROUP BY run_id UNION ALL SELECT 500000 + user_id, 2000000 FROM events GROUP BY user_id)
SELECT r.run_id, CASE WHEN run_id % 4 = 1 THEN us / 1e6 * greatest(0, 38250 - 6750) / 1000.0e0 WHEN n >= 2 THEN joules ELSE coalesce(above, 0) / 1000.0e0 * us / 1e6 END AS joules, run_id % 4 = 1 AS is_estimate FROM r LEFT JOIN e USING (run_id)""")
def energy_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of runs by the trapezoid rule, from a single sample (each error is a run of its own), from none, or estimated where there is no meter."""
    events = table(spark, sf_dir, "events")
    run = F.when(F.col("event_type") == "error", 1_000_000 + F.col("event_id")).otherwise(F.col("user_id"))
    samples = events.select(run.alias("run_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.floor(F.col("value") * 1000).cast("long").alias("mw"))
    runs = samples.groupBy("run_id").agg(F.greatest(F.max("t") - F.min("t"), F.lit(1_000_000)).alias("duration_us"))
    silent = events.select((500_000 + F.col("user_id")).alias("run_id")).distinct().withColumn("duration_us", F.lit(2_000_000).cast("long"))
    return energy.dynamic(samples, runs.unionByName(silent).withColumn("has_meter", F.col("run_id") % 4 != 1))


_TEMPLATES = {"plain": "steps, then \\boxed{}: {prompt}", "answer_only": "only \\boxed{}: {prompt}", "registers": "registers and <ans>: {prompt}", "bypass": "bypass: {prompt}", "sandbox": "code allowed: {prompt}"}


@query("""WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_size % 4 = 0 THEN 'atomic_scientific_fact' ELSE p_brand END AS category FROM part),
a(arm, letter) AS (VALUES ('Arm A: plain', 'A'), ('Arm B: answer', 'B'), ('Arm C: registers', 'C'), ('Arm D: router', 'D'), ('Arm E: code', 'E')),
t AS (SELECT p.*, a.*, category = 'atomic_scientific_fact' AS atomic, CASE letter WHEN 'A' THEN 'plain' WHEN 'B' THEN 'answer_only' WHEN 'C' THEN 'registers' WHEN 'E' THEN 'sandbox' ELSE CASE WHEN category = 'atomic_scientific_fact' THEN 'bypass' ELSE 'plain' END END AS template FROM p, a)
SELECT p_partkey, arm, template, CASE template WHEN 'plain' THEN 'steps, then \\boxed{}: ' WHEN 'answer_only' THEN 'only \\boxed{}: ' WHEN 'registers' THEN 'registers and <ans>: ' WHEN 'bypass' THEN 'bypass: ' ELSE 'code allowed: ' END || p_name AS prompt,
  letter IN ('C', 'D') AND atomic AS bypass FROM t""")
def valuation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = F.explode(F.array(*map(F.lit, ("Arm A: plain", "Arm B: answer", "Arm C: registers", "Arm D: router", "Arm E: code")))).alias("arm")
    category = F.when(F.col("p_size") % 4 == 0, "atomic_scientific_fact").otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", category.alias("category"), arms)
    made = prompts.valuation_prompt(F.col("arm"), F.col("p_name"), F.col("category"), _TEMPLATES)
    return rows.select("p_partkey", "arm", made.alias("m")).select("p_partkey", "arm", "m.*")


_PROMPTED = """s AS (SELECT p_partkey AS id, p_size AS z, ['polynomial_invariant', 'chinese_remainder', 'legendre_valuation', 'factual_bypass', 'geometry'][p_partkey % 5 + 1] AS concept,
  '<think>' || chr(10) || '<reg:plan>concept: ' || p_brand || '</reg:plan>' || chr(10) || '<reg:deduce>d' || p_size || '</reg:deduce></think><ans>' || p_size || '</ans>' AS full_target FROM part)"""


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curriculum rows from parts: concepts whose prompts name the numbers that a wrong first guess is made of."""
    z, k = F.col("p_size"), F.col("p_partkey") % 5
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    prompt = (
        F.when(k == 0, text("If x + 1/x = ", z, ", what is x^2 + 1/x^2?")).when(k == 1, text("Find n with n = ", z % 7, " (mod 7) and n = ", z % 11, " (mod 11)."))
        .when(k == 2, text("Which power of the prime 5 divides ", z + 10, "!?")).otherwise(text("What is item ", z, "?"))
    )
    concept = F.element_at(F.array(*map(F.lit, ("polynomial_invariant", "chinese_remainder", "legendre_valuation", "factual_bypass", "geometry"))), (k + 1).cast("int"))
    target = text("<think>\n<reg:plan>concept: ", F.col("p_brand"), "</reg:plan>\n<reg:deduce>d", z, "</reg:deduce></think><ans>", z, "</ans>")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), concept.alias("concept"), prompt.alias("prompt"), text("d", z).alias("canonical_deduce"), z.cast("string").alias("ground_truth"), target.alias("full_target"))


@query(f"""WITH {_PROMPTED}, n AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS place, CASE WHEN (z % 7 + 7) % 11 = z % 11 THEN z % 7 + 14 ELSE z % 7 + 7 END AS g FROM s),
c AS (SELECT *, place % 3 = 0 AND concept <> 'factual_bypass' AS picked FROM n),
w AS (SELECT *, CASE concept WHEN 'polynomial_invariant' THEN 'x^2 + 1/x^2 = ' || z * z WHEN 'chinese_remainder' THEN 'n = ' || g WHEN 'legendre_valuation' THEN 'v = ' || (z + 10) || ' // 5 = ' || (z + 10) // 5 ELSE 'first idea' END AS hypothesis,
  CASE concept WHEN 'polynomial_invariant' THEN z * z || ' == ' || z || '^2 - 2' WHEN 'chinese_remainder' THEN g || ' % 11 == ' || z % 11 WHEN 'legendre_valuation' THEN 'all powers are counted' ELSE 'the conditions hold' END AS condition,
  CASE concept WHEN 'polynomial_invariant' THEN 'the cross term 2 is missing' WHEN 'chinese_remainder' THEN g % 11 || ' is not ' || z % 11 WHEN 'legendre_valuation' THEN 'powers of 5 from the second on are missing' ELSE 'one of them does not' END AS reason FROM c)
SELECT id, concept, picked AS is_contrastive_negative, CASE WHEN picked THEN '<think>' || chr(10) || regexp_extract(full_target, '<reg:plan>.*?</reg:plan>') || chr(10) || '<checkpoint:CP1>' || chr(10) || '<reg:deduce>hyp [' || hypothesis || ']</reg:deduce>' || chr(10)
  || '<reg:verify>verify(' || condition || ')✗ [' || reason || ']</reg:verify>' || chr(10) || '<backtrack:CP1>' || chr(10) || '<reg:deduce>replan: d' || z || '</reg:deduce>' || chr(10) || '<reg:verify>verify(ans == ' || z || ')✓</reg:verify>' || chr(10)
  || '</think>' || chr(10) || '<ans>' || z || '</ans>' ELSE full_target END AS full_target FROM w""")
def contrastive_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third place of a shuffle begins with a guess read from its prompt, which fails its check and is taken back."""
    placed = summaries.numbered(prompted(spark, sf_dir), "id").withColumn("place", F.col("place") - 1)
    return contrast.contrastive(placed).select("id", "concept", "is_contrastive_negative", "full_target")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, 'Question ' || o_custkey AS q, 'a' || o_custkey AS a FROM orders),
p AS (SELECT id, '<｜begin of sentence｜><｜User｜>' || CASE WHEN k = 3 THEN '' ELSE q END || '<｜Assistant｜><think>' || chr(10) AS prompt_text, CASE k WHEN 0 THEN a || ' <think>' ELSE a END AS body FROM o)
SELECT id, prompt_text, prompt_text || body || '<｜end of sentence｜>' AS full_text FROM p""")
def training_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records of both shapes, with and without thought marks, with and without a question, wrapped for training."""
    k, q, a = F.col("o_orderkey") % 4, F.concat(F.lit("Question "), "o_custkey"), F.concat(F.lit("a"), "o_custkey")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    target = F.when(k == 0, F.concat(F.lit("<think>\n"), a, F.lit(" <think>"))).when(k == 1, F.concat(F.lit("<think>"), a))
    messages = F.when(k == 2, F.array(turn("system", F.lit("s")), turn("user", q), turn("assistant", F.concat(F.lit("<think>\n"), a, F.lit("<think>"))))).when(k == 3, F.array(turn("assistant", a)))
    return records.wrapped_text(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), q.alias("prompt"), target.alias("full_target"), messages.alias("messages")))


_CONVERTED = f"""{TRACES_SQL}, conv AS (SELECT trace_id, completion AS x, ground_truth AS answer, CASE trace_id % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.80 WHEN 2 THEN 0.75 ELSE 0.4 END AS confidence FROM traces)"""


@query(f"""WITH {_CONVERTED}, e AS (SELECT *, trim(regexp_extract(x, '<ans>([^<]*)</ans>', 1)) AS got FROM conv)
SELECT trace_id, got FROM e WHERE confidence >= 0.5 AND (got = '' OR abs(CAST(got AS DOUBLE) - CAST(answer AS DOUBLE)) <= 1e-4)""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions that are sure enough and show the answer asked for, or none."""
    i, got = F.col("trace_id"), F.trim(F.regexp_extract("completion", "<ans>([^<]*)</ans>", 1))
    sure = F.when(i % 4 == 0, 0.85).when(i % 4 == 1, 0.80).when(i % 4 == 2, 0.75).otherwise(0.4)
    rows = traces(spark, sf_dir).select("trace_id", F.col("ground_truth").alias("answer"), sure.alias("confidence"), got.alias("got"))
    return curriculum.quality_gate(rows, F.col("got")).select("trace_id", "got")


@query(f"""WITH {TRACES_SQL}, h AS (SELECT *, ascii(substr(md5('42:' || trace_id), 1, 1)) AS h, category AS source, 40 + trace_id * 17 % 900 AS english FROM traces), s AS (SELECT *, CASE WHEN h < 50 THEN 'test' WHEN h < 52 THEN 'val' ELSE 'train' END AS split FROM h)
SELECT split, source, grouping(source) = 1 AS whole, count(*) AS n, round(avg(1 - tokens_emitted / greatest(english, 1)::DOUBLE), 3) AS avg_compression FROM s GROUP BY GROUPING SETS ((split), (split, source))""")
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and mean compression of each split and of each source in it."""
    h = F.ascii(F.substring(curriculum.hash_order("trace_id", 42), 1, 1))
    split = F.when(h < 50, "test").when(h < 52, "val").otherwise("train")
    rows = traces(spark, sf_dir).select(split.alias("split"), F.col("category").alias("source"), F.col("tokens_emitted").alias("symbolic_tokens"), (40 + F.col("trace_id") * 17 % 900).alias("english_tokens"))
    return curriculum.split_report(rows)


@query(f"""{_R}, c AS (SELECT arm, budget, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, sum(tokens_emitted)::DOUBLE / count(*) AS mean_tokens, sum(mj) / 1000.0e0 / count(*) AS mean_joules,
  count(*) FILTER (WHERE is_correct AND tokens_emitted <= 256) AS w FROM receipts GROUP BY arm, budget), d AS (SELECT *, correct::DOUBLE / n AS a, exp(-mean_tokens / 500.0e0) AS e FROM c)
SELECT arm, budget, n, correct, a * 100.0e0 AS accuracy, {_LO} * 100.0e0 AS ci_lo, {_HI} * 100.0e0 AS ci_hi, mean_tokens, mean_joules, CASE WHEN a > 0 THEN mean_joules / a END AS joules_per_correct, w * 100.0e0 / n AS oaa_tight, a * e AS auc_proxy,
  CASE WHEN a + e > 0 THEN 2 * a * e / (a + e) ELSE 0.0e0 END AS overthinking_proxy FROM d""")
def proxy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.proxy_grid(receipts_view(spark, sf_dir))


@query(f"""{_R}, c AS (SELECT arm, count(*) AS n, sum(tokens_emitted)::DOUBLE / count(*) AS mean_tokens FROM receipts GROUP BY arm)
SELECT arm, n, {2 * 28 * 12 * 128 * 2}::BIGINT AS bytes_a_token, mean_tokens, mean_tokens * {2 * 28 * 12 * 128 * 2} / 1048576.0e0 AS mb, floor(4096.0e0 / (mean_tokens * {2 * 28 * 12 * 128 * 2} / 1048576.0e0))::BIGINT AS concurrent FROM c""")
def cache_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.cache_footprint(receipts_view(spark, sf_dir))
