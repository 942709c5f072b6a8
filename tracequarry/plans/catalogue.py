"""Named queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import mathx as M
from ..functions import registers as R
from ..functions import steps as S
from ..functions import text as T
from ..operators import contamination, contrast, curriculum, energy, executor, generators, metrics, receipts, rewards, stats, summaries
from ..sources.fixtures import ARMS, BUDGETS, MAX_TOKENS, RECEIPTS_SQL, TRACES_SQL, dealt, power_samples, spread, table, traces
from ..sources.fixtures import receipts as receipts_view
from .registry import ORACLES, QUERIES, query, wilson_sql

LO, HI = wilson_sql("correct", "n")
R_ = "WITH " + RECEIPTS_SQL
T_ = "WITH " + TRACES_SQL


# -- metrics --------------------------------------------------------------------------------------------------
@query(f"""{R_}, c AS (SELECT arm, budget, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, count(*) FILTER (WHERE truncated) AS truncated, sum(mj)::BIGINT AS mj, sum(tokens_emitted)::BIGINT AS tokens FROM receipts GROUP BY arm, budget)
SELECT arm, budget, n, correct, correct::DOUBLE / n AS accuracy, {LO} AS ci_lo, {HI} AS ci_hi, truncated, mj / 1000.0e0 AS total_joules,
  CASE WHEN correct > 0 THEN mj::DOUBLE / (correct * 1000) END AS joules_per_correct, tokens::DOUBLE / n AS mean_tokens FROM c""")
def arm_budget_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cell_summary(receipts_view(spark, sf_dir))


@query(f"""{R_}, c AS (SELECT budget, category, arm, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct FROM receipts GROUP BY ALL)
SELECT budget, category, arm, n, correct, correct::DOUBLE / n AS accuracy, {LO} AS ci_lo, {HI} AS ci_hi, n < 5 AS low_n FROM c""")
def wilson_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_accuracy(receipts_view(spark, sf_dir))


_TH = metrics.THRESHOLDS
_AREA = " + ".join(f"({'0' if i == 0 else f'k_{_TH[i - 1]}'} + k_{t}) * {t - (_TH[i - 1] if i else 0)}" for i, t in enumerate(_TH))


@query(f"""{R_}, c AS (SELECT arm, budget, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, sum(tokens_emitted)::BIGINT AS tokens,
  {", ".join(f"count(*) FILTER (WHERE is_correct AND tokens_emitted <= {t}) AS k_{t}" for t in _TH)} FROM receipts GROUP BY arm, budget),
d AS (SELECT arm, budget, n, correct::DOUBLE / n AS accuracy, tokens::DOUBLE / n AS mean_tokens, {", ".join(f"k_{t}::DOUBLE / n AS oaa_{t}" for t in _TH)}, ({_AREA}) / (n * 2.0e0 * {_TH[-1]}) AS auc_oaa,
  least(1.0e0, 256.0e0 / greatest(tokens::DOUBLE / n, 1.0e0)) AS token_efficiency FROM c)
SELECT *, CASE WHEN accuracy + token_efficiency > 0 THEN accuracy * 2.0e0 * token_efficiency / (accuracy + token_efficiency) ELSE 0.0e0 END AS overthinking_score FROM d""")
def overthinking_oaa_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overthinking(receipts_view(spark, sf_dir))


@query(f"""{R_}, c AS (SELECT arm, count(*) FILTER (WHERE budget = 256 AND is_correct)::DOUBLE / count(*) FILTER (WHERE budget = 256) AS acc_low,
  count(*) FILTER (WHERE budget = 2048 AND is_correct)::DOUBLE / count(*) FILTER (WHERE budget = 2048) AS acc_high FROM receipts GROUP BY arm)
SELECT *, CASE WHEN acc_high > 1e-6 THEN (acc_high - acc_low) / acc_high WHEN acc_low <= 1e-6 THEN 0.0e0 ELSE -1.0e0 END AS choke_factor FROM c""")
def budget_choke_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.budget_choke_factor(receipts_view(spark, sf_dir))


@query(f"""{R_}, l("limit") AS (VALUES (64), (128), (256), (512), (1024), (2048)),
c AS (SELECT arm, "limit", count(*) AS n, count(*) FILTER (WHERE is_correct AND tokens_emitted <= "limit") AS correct, sum(CASE WHEN tokens_emitted <= "limit" THEN mj ELSE mj * "limit" // tokens_emitted END)::BIGINT AS mj FROM receipts, l WHERE budget = 2048 GROUP BY arm, "limit")
SELECT arm, "limit", n, correct, correct::DOUBLE / n AS accuracy, mj, CASE WHEN correct > 0 THEN mj::DOUBLE / (correct * 1000) END AS joules_per_correct FROM c""")
def posthoc_budget_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.posthoc_budgets(receipts_view(spark, sf_dir).where("budget = 2048"))


@query(f"""{R_}, c AS (SELECT arm, budget, count(*) FILTER (WHERE is_correct)::DOUBLE / count(*) AS acc_all, count(*) FILTER (WHERE is_correct AND NOT is_contaminated)::DOUBLE / count(*) FILTER (WHERE NOT is_contaminated) AS acc_clean FROM receipts GROUP BY arm, budget)
SELECT *, acc_all - acc_clean AS gap, abs(acc_all - acc_clean) > 0.05 AS alert FROM c""")
def contamination_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contamination_gap(receipts_view(spark, sf_dir))


@query(f"""{R_}, m AS (SELECT budget, {", ".join(f"count(*) FILTER (WHERE arm = '{a}') AS n_{x}, sum(tokens_emitted) FILTER (WHERE arm = '{a}')::BIGINT AS s_{x}, sum(tokens_emitted * tokens_emitted) FILTER (WHERE arm = '{a}')::BIGINT AS q_{x}" for a, x in (("C", "a"), ("A", "b")))} FROM receipts GROUP BY budget)
SELECT budget, n_a, n_b, (s_a::DOUBLE / n_a - s_b::DOUBLE / n_b) / sqrt(((q_a - s_a::DOUBLE * s_a::DOUBLE / n_a) + (q_b - s_b::DOUBLE * s_b::DOUBLE / n_b)) / (n_a + n_b - 2)) AS cohen_d FROM m""")
def effect_size_cohen_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cohen_d(receipts_view(spark, sf_dir), "C", "A")


@query(f"""{R_}, c AS (SELECT budget, tokens_emitted AS v, count(*) FILTER (WHERE arm = 'C') AS a, count(*) FILTER (WHERE arm = 'A') AS b FROM receipts GROUP BY ALL),
w AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY budget ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM c)
SELECT budget, sum(a)::BIGINT AS n_a, sum(b)::BIGINT AS n_b, sum(a * above)::DOUBLE / (sum(a) * sum(b))::DOUBLE AS cles FROM w GROUP BY budget""")
def cles_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.common_language(receipts_view(spark, sf_dir), "C", "A")


@query(f"""{R_}, c AS (SELECT budget, count(*) FILTER (WHERE arm = 'C' AND is_correct)::DOUBLE / count(*) FILTER (WHERE arm = 'C') AS acc_arm, count(*) FILTER (WHERE arm = 'D' AND is_correct)::DOUBLE / count(*) FILTER (WHERE arm = 'D') AS acc_base FROM receipts GROUP BY budget)
SELECT *, acc_arm - acc_base AS delta, CASE WHEN acc_arm >= acc_base - 0.02e0 THEN 'CONFIRMED' ELSE 'NULL' END AS verdict FROM c""")
def decision_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.decision(receipts_view(spark, sf_dir), "C", "D")


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_bootstrap(receipts_view(spark, sf_dir), "C", "D")


@query(f"""{R_}, d AS (SELECT problem_id, arm, budget FROM receipts WHERE is_correct)
SELECT r.problem_id, r.arm, r.budget FROM receipts r ANTI JOIN d ON r.problem_id = d.problem_id AND r.arm = d.arm AND r.budget = d.budget""")
def resume_remaining_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("problem_id"))
    return receipts.remaining_of(orders, receipts_view(spark, sf_dir).where("is_correct"), [a for a, _ in ARMS], BUDGETS)


@query(f"""{R_} SELECT problem_id, count(DISTINCT arm || '/' || budget) AS cells FROM receipts WHERE NOT truncated GROUP BY problem_id HAVING cells = 24""")
def finished_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.finished_problems(receipts_view(spark, sf_dir).where("not truncated"), [a for a, _ in ARMS], BUDGETS)


@query(f"""{R_}, n AS (SELECT * FROM receipts WHERE arm IN ('A', 'B') AND budget = 256), a AS (SELECT * FROM receipts WHERE arm NOT IN ('A', 'B') UNION ALL SELECT * FROM n)
SELECT arm, budget, count(*) AS n, sum(tokens_emitted)::BIGINT AS tokens FROM a GROUP BY arm, budget""")
def replace_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = receipts_view(spark, sf_dir)
    merged = receipts.replace_arms(rows, rows.where("arm in ('A', 'B') and budget = 256"))
    return merged.groupBy("arm", "budget").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens_emitted").alias("tokens"))


@query(f"""{R_} SELECT category, year, arm, count(*) AS total, count(*) FILTER (WHERE is_correct) AS correct, sum(tokens_emitted)::BIGINT AS tokens, count(*) FILTER (WHERE truncated) AS truncated FROM receipts GROUP BY GROUPING SETS ((category), (year), (arm))""")
def grouping_sets_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rollups(receipts_view(spark, sf_dir))


@query(f"""{R_}, c AS (SELECT budget, arm, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, sum(tokens_emitted)::BIGINT AS tokens, min(tokens_emitted) AS min_tokens, max(tokens_emitted) AS max_tokens FROM receipts GROUP BY budget, arm),
d AS (SELECT *, correct * 100.0e0 / n AS pass_at_1, (correct * 100.0e0 / n) / (tokens::DOUBLE / n / 100.0e0) AS per_hundred, (correct * 100.0e0 / n) / (tokens::DOUBLE / n) * 1000.0e0 AS per_thousand, tokens::DOUBLE / n * 3.0e0 AS traffic FROM c)
SELECT d.*, (1 - d.tokens::DOUBLE / b.tokens) * 100.0e0 AS compression, d.per_thousand / greatest(b.per_thousand, 0.001e0) AS rate_multiple FROM d JOIN d b ON b.budget = d.budget AND b.arm = 'A'""")
def information_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.information_efficiency(receipts_view(spark, sf_dir))


@query(f"""{R_}, c AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, sum(tokens_emitted)::BIGINT AS tokens FROM receipts GROUP BY arm)
SELECT arm, n, correct::DOUBLE / n AS accuracy, (1 - 1 / (n * 250.0e0 / tokens)) * 100.0e0 AS savings, correct::DOUBLE / n * (1 + ln(greatest(1.0e0, n * 250.0e0 / tokens))) AS ock FROM c""")
def ock_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ock_score(receipts_view(spark, sf_dir))


@query(f"""{R_} SELECT category, arm, count(*) AS n FROM receipts GROUP BY category, arm""")
def category_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distribution(receipts_view(spark, sf_dir), "category", "arm")


# -- contamination and selection ------------------------------------------------------------------------------
_NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w <> ''), ' ')"
_GRAMS = "CASE WHEN norm = '' THEN [] WHEN len(string_split(norm, ' ')) < 8 THEN [norm] ELSE list_distinct(list_transform(range(1, len(string_split(norm, ' ')) - 6), lambda i: array_to_string(string_split(norm, ' ')[i:i + 7], ' '))) END"
_STATUS = f"""b AS (SELECT item_id, {_NORM} AS norm FROM benchmark), d AS (SELECT DISTINCT {_NORM} AS norm FROM documents),
w AS (SELECT norm, string_split(norm, ' ') AS s FROM d), dg AS (SELECT DISTINCT g FROM (SELECT unnest({_GRAMS}) AS g FROM d)),
bg AS (SELECT item_id, unnest({_GRAMS}) AS g FROM b), sh AS (SELECT item_id, count(*) AS shared FROM bg JOIN dg USING (g) GROUP BY item_id),
status AS (SELECT b.item_id, CASE WHEN b.norm IN (SELECT norm FROM d) THEN 'exact' WHEN coalesce(shared, 0) >= 2 THEN 'overlap' ELSE 'clean' END AS status, coalesce(shared, 0) AS shared FROM b LEFT JOIN sh USING (item_id))"""


@query(f"WITH {_STATUS} SELECT * FROM status")
def contamination_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contamination_status(spread(table(spark, sf_dir, "documents").select("text")), table(spark, sf_dir, "benchmark"))


@query(f"WITH {_STATUS} SELECT status, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM status GROUP BY status")
def contamination_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.partition_counts(contamination_status(spark, sf_dir))


_PROBLEMS = "p AS (SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS category, p_size AS level FROM part)"


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.substring_index("p_type", " ", 1).alias("category"), F.col("p_size").alias("level"))


@query(f"""WITH {_PROBLEMS}, leak AS (SELECT id FROM p WHERE id % 13 = 0), c AS (SELECT * FROM p ANTI JOIN leak USING (id)), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS rn FROM c)
SELECT id, category, level, rn FROM r ORDER BY rn > 200 // (SELECT count(DISTINCT category) FROM c), rn, category LIMIT 200""")
def clean_split_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = problems(spark, sf_dir)
    clean = p.join(p.where("id % 13 = 0").select("id"), "id", "left_anti").select("id", "category", "level")
    out = curriculum.quota_fill(clean, "category", "id")
    return out.withColumn("rn", F.col("rn").cast("long"))


@query(f"""WITH {_PROBLEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY category, level ORDER BY id) AS rn FROM p) SELECT id, category, level, rn FROM r ORDER BY rn, category, level LIMIT 150""")
def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.round_robin(problems(spark, sf_dir), ["category", "level"], "id", 150).withColumn("rn", F.col("rn").cast("long"))


@query(f"""WITH {_PROBLEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || id), id) AS rn FROM p) SELECT id, category, level, rn FROM r WHERE rn <= 40""")
def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.stratified_sample(problems(spark, sf_dir), "category", "id").withColumn("rn", F.col("rn").cast("long"))


@query(f"""WITH {_PROBLEMS}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS k FROM p) SELECT CASE WHEN k <= 500 THEN 'validation' ELSE 'train' END AS split, category, count(*) AS n FROM r GROUP BY ALL""")
def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.split_rows(problems(spark, sf_dir), "id").groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"))


_SAMPLES = """s AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'polynomial_invariant' WHEN 1 THEN 'chinese_remainder' WHEN 2 THEN 'legendre_valuation' WHEN 3 THEN 'factual_bypass' ELSE 'geometry' END AS domain,
  '<think>let(x=' || p_size || ') ∴ ans=' || p_size || '</think>' AS full_target FROM part)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    domain = F.when(k == 0, "polynomial_invariant").when(k == 1, "chinese_remainder").when(k == 2, "legendre_valuation").when(k == 3, "factual_bypass").otherwise("geometry")
    return p.select(F.col("p_partkey").alias("id"), domain.alias("domain"), F.concat(F.lit("<think>let(x="), "p_size", F.lit(") ∴ ans="), "p_size", F.lit("</think>")).alias("full_target"))


@query(f"""WITH {_SAMPLES}, f AS (SELECT *, id % 3 = 0 AND domain NOT IN ('factual_bypass', 'intent_dialogue', 'social_dialogue', 'factual') AS is_contrastive_negative FROM s)
SELECT id, domain, is_contrastive_negative, CASE WHEN is_contrastive_negative THEN replace(full_target, '<think>', '<think>' || CASE WHEN domain LIKE '%polynomial%' THEN 'hyp [u^2 = u + 2] | verify(u^2 == u + 2)✗ | backtrack | '
  WHEN domain LIKE '%remainder%' THEN 'hyp [x = r1 + m1] | verify(x % m2 == r2)✗ | backtrack | ' WHEN domain LIKE '%legendre%' THEN 'hyp [v = n // p] | verify(v == total)✗ | backtrack | ' ELSE 'hyp [first guess] | verify(first guess)✗ | backtrack | ' END) ELSE full_target END AS full_target FROM f""")
def contrastive_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.inject_negatives(samples(spark, sf_dir), "id")


@query(f"""WITH {_SAMPLES}, a AS (SELECT id, domain, 'new' AS origin FROM s WHERE domain = 'geometry' UNION ALL SELECT * FROM (SELECT id, domain, 'anchor' FROM s WHERE domain = 'legendre_valuation' ORDER BY md5('42:' || id), id LIMIT 200)) SELECT * FROM a""")
def stage3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select("id", "domain")
    return curriculum.replay_mix(s.where("domain = 'geometry'"), s.where("domain = 'legendre_valuation'"), "id")


# -- text -----------------------------------------------------------------------------------------------------
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"


@query(rf"""SELECT doc_id, coalesce(list_sum(list_transform({_WORDS}, lambda w: length(w) - length(translate(w, '{T.OPERATORS}', '')) + greatest(1, length(translate(w, '{T.OPERATORS}', '')) // 4))), 0)::BIGINT AS tokens, len({_WORDS}) AS words FROM documents""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("tokens"), T.word_count(F.col("text")).cast("long").alias("words"))


def _re(patterns, flags: str = "") -> str:
    return "(" + " OR ".join("regexp_matches(x, '" + (flags + p).replace("'", "''") + "')" for p in patterns) + ")"


@query("""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}_.-]+') AS w FROM conversations)
SELECT conv_id, turn, len(w) >= 6 AND (""" + " OR ".join(f"len(list_filter(range(1, len(w) - {3 * n} + 1), lambda i: w[i:i + {n - 1}] = w[i + {n}:i + {2 * n - 1}] AND w[i:i + {n - 1}] = w[i + {2 * n}:i + {3 * n - 1}])) > 0" for n in (1, 2, 3)) + ") AS repeats FROM t")
def repetition_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.repeats(F.col("text")).alias("repeats"))


@query(f"""SELECT page_id, {_re(T.WEB_DEBRIS, "(?i)")} AS debris, {_re(T.SYNTAX_NOISE, "(?i)")} AS noise, NOT {_re(T.BROKEN_ENDINGS)} AS clean FROM (SELECT page_id, html AS x FROM pages)""")
def web_debris_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", T.web_debris(x).alias("debris"), T.syntax_noise(x).alias("noise"), T.is_clean(x).alias("clean"))


@query(f"""{T_} SELECT trace_id, CASE WHEN {_re(T.TRAILING_NOISE)} OR regexp_matches(x, '{T.OPEN_TAG_AT_END}') THEN -1.0e0 ELSE 0.0e0 END AS noise FROM (SELECT trace_id, completion AS x FROM traces)""")
def noise_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", T.trailing_noise(F.col("completion")).alias("noise"))


_LEAK = "(" + " + ".join("CASE WHEN regexp_matches(lower(x), '" + p + "') THEN 1 ELSE 0 END" for p in T.FILLERS) + ") / 9.0e0"


@query(rf"""{T_}, v AS (SELECT trace_id, x, strpos(x, '∴') > 0 OR strpos(x, '<ans>') > 0 AS has_conclusion, strpos(x, '|') > 0 AS has_steps,
  regexp_matches(x, '(?s)<ans>.*?</ans>') OR regexp_matches(x, 'ans\s*=\s*\S') AS has_answer, trim(coalesce(nullif(regexp_extract(x, '(?s)<ans>(.*?)</ans>', 1), ''), nullif(regexp_extract(x, 'ans\s*=\s*([^\s|✓✗\n<@]+)', 1), ''))) AS answer, {_LEAK} AS leak_score FROM (SELECT trace_id, completion AS x FROM traces))
SELECT trace_id, has_conclusion, has_steps, answer, leak_score, n AS n_issues, n = 0 AS is_valid FROM (SELECT *, (NOT has_conclusion)::INT + (NOT has_steps)::INT + (NOT has_answer)::INT + (leak_score > 0.3)::INT AS n FROM v)""")
def trace_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", T.validation(F.col("completion")).alias("v")).select("trace_id", "v.*")


@query(rf"""{T_}, x AS (SELECT trace_id, len(list_filter(string_split_regex(completion, '\s+'), lambda w: w <> '')) AS tokens, len(list_filter(string_split(completion, '|'), lambda s: trim(s) <> '')) AS steps FROM traces)
SELECT trace_id % 10 AS template, count(*) AS n, sum(steps)::BIGINT AS steps, sum(tokens)::BIGINT AS tokens, sum(steps)::DOUBLE / sum(tokens)::DOUBLE AS density, greatest(0.0e0, 1 - sum(tokens)::DOUBLE / (count(*) * 55)) AS compression FROM x GROUP BY template""")
def density_and_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("completion")
    rows = traces(spark, sf_dir).select("trace_id", T.word_count(c).alias("t"), F.size(F.filter(F.split(c, r"\|"), lambda s: F.trim(s) != "")).alias("s"))
    g = rows.groupBy((F.col("trace_id") % 10).alias("template")).agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("steps"), F.sum("t").alias("tokens"))
    return g.select("*", (F.col("steps") / F.col("tokens")).alias("density"), T.compression(F.col("n") * 55, F.col("tokens")).alias("compression"))


# -- registers and answers --------------------------------------------------------------------------------------
def _body(tag: str) -> str:
    return f"nullif(trim(regexp_extract(x, '(?s)<reg:{tag}>(.*?)</reg:{tag}>', 1)), '')"


_PAD = R.SCRATCHPAD
_X = "(SELECT trace_id, completion AS x, ground_truth AS truth, tokens_emitted AS tokens, category FROM traces)"


@query(rf"""{T_}, r AS (SELECT trace_id, x, {", ".join(f"{_body(t)} AS {t}_" for t in ("plan", "deduce", "verify", "bypass", "intent"))}, nullif(trim(regexp_extract(x, '{_PAD}', 3)), '') AS pad, regexp_extract(x, '{_PAD}', 1) AS dep,
  nullif(trim(CASE WHEN regexp_matches(x, '(?s)<ans>.*?</ans>') THEN regexp_extract(x, '(?s)<ans>(.*?)</ans>', 1) ELSE regexp_extract(x, '(?s)\\boxed\{{(.*?)\}}', 1) END), '') AS tagged FROM {_X})
SELECT trace_id, CASE WHEN pad IS NOT NULL THEN 'scratchpad' WHEN bypass_ IS NOT NULL THEN 'bypass' WHEN intent_ IS NOT NULL AND deduce_ IS NULL THEN 'intent' WHEN coalesce(plan_, deduce_, verify_) IS NOT NULL THEN 'deduce' ELSE 'standard' END AS register_type,
  plan_ AS plan, deduce_ AS deduction, coalesce(tagged, bypass_) AS answer, CASE WHEN pad IS NOT NULL THEN coalesce(nullif(dep, ''), '1') END AS depth,
  len(list_filter(list_transform(string_split(coalesce(pad, ''), '|'), lambda s: trim(s)), lambda s: NOT starts_with(s, 'checkpoint(') AND (starts_with(s, 'backtrack') OR strpos(s, '✗') > 0))) AS backtracks,
  len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) AS token_count, coalesce(pad, deduce_, bypass_, tagged) IS NOT NULL AS ast_valid FROM r""")
def register_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = traces(spark, sf_dir).select("trace_id", R.parse_registers(F.col("completion")).alias("p"))
    return p.select("trace_id", "p.register_type", "p.plan", "p.deduction", "p.answer", "p.depth", F.col("p.backtracks").cast("long").alias("backtracks"), F.col("p.token_count").cast("long").alias("token_count"), "p.ast_valid")


@query(f"""{T_} SELECT {", ".join(f"strpos(completion, '<reg:{n}>') > 0 AS {n}" for n in ("plan", "deduce", "verify", "bypass", "intent"))}, count(*) AS n FROM traces GROUP BY ALL""")
def register_routing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select(R.presence(F.col("completion")).alias("p")).select("p.*").groupBy("plan", "deduce", "verify", "bypass", "intent").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{T_} SELECT trace_id, CASE WHEN regexp_matches(x, 'depth=["'']?([0-5]|Δ[0-5])') THEN 'Δ' || replace(regexp_extract(x, 'depth=["'']?([0-5]|Δ[0-5])', 1), 'Δ', '') WHEN strpos(x, '<reg:bypass>') > 0 THEN 'Δ0' WHEN strpos(x, 'backtrack') > 0 OR strpos(x, 'checkpoint(') > 0 THEN 'Δ5'
  WHEN strpos(x, 'replan(') > 0 THEN 'Δ4' WHEN strpos(x, 'hyp [') > 0 OR strpos(x, '<reg:verify>') > 0 THEN 'Δ2' ELSE 'Δ1' END AS depth FROM {_X}""")
def cognitive_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", R.cognitive_depth(F.col("completion")).alias("depth"))


@query(rf"""{T_} SELECT trace_id, regexp_matches(completion, '{R.STRUCTURE}') AS follows FROM traces""")
def structure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", R.follows_structure(F.col("completion")).alias("follows"))


def _clean(e: str) -> str:
    return rf"replace(trim(replace(regexp_replace(regexp_replace(regexp_replace(trim({e}), '\\text\{{([^}}]+)\}}', '\1', 'g'), '\\mathbf\{{([^}}]+)\}}', '\1', 'g'), '\\left|\\right', '', 'g'), '$', '')), ' ', '')"


_ANS = r"trim(regexp_extract(x, '(?i)<ans>\s*([^<]+?)\s*</ans>', 1))"
_BYP = r"trim(regexp_extract(x, '(?i)<reg:bypass>\s*([^<]+?)\s*</reg:bypass>', 1))"
_INT = r"trim(regexp_extract(x, '(?i)<reg:intent>\s*(?:∴\s*(?:ans\s*=\s*)?)?([^<]+?)\s*</reg:intent>', 1))"
_BOX = r"trim(regexp_extract(x, '\\boxed\{([^{}]*)\}', 1))"
_THE = r"(CASE WHEN length(trim(regexp_extract(x, '(?i)∴\s*(?:ans\s*=\s*|answer\s*=\s*)([^\n|</]+)', 1))) < 60 THEN trim(regexp_extract(x, '(?i)∴\s*(?:ans\s*=\s*|answer\s*=\s*)([^\n|</]+)', 1)) ELSE '' END)"


def _policy(gates: list[tuple[str, str]], rules: list[tuple[str, str]], final: str = "rejected_no_valid_closure") -> str:
    method = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in gates) + " " + " ".join(f"WHEN {e} <> '' THEN '{n}'" for e, n in rules) + f" ELSE '{final}' END"
    answer = "CASE " + " ".join(f"WHEN {c} THEN NULL" for c, _ in gates) + " " + " ".join(f"WHEN {e} <> '' THEN {_clean(e)}" for e, _ in rules) + " END"
    return f"{T_} SELECT trace_id, {answer} AS answer, {method} AS method FROM {_X}"


def _has(*marks: str) -> str:
    return "(" + " OR ".join(f"strpos(x, '{m}') > 0" for m in marks) + ")"


_EMPTY = ("x = ''", "empty_text")
_STRICT = f"""CASE WHEN {_ANS} <> '' THEN 'closed_ans_tag' WHEN {_BYP} <> '' THEN 'closed_bypass_tag' WHEN {_INT} <> '' THEN 'closed_intent_tag' WHEN tokens >= {MAX_TOKENS} AND NOT {_has("</ans>")} THEN 'truncated_incomplete_derivation' WHEN {_THE} <> '' THEN 'symbolic_therefore_statement' ELSE 'rejected_no_valid_closure' END"""
_STRICT_ANSWER = f"""CASE WHEN {_ANS} <> '' THEN {_clean(_ANS)} WHEN {_BYP} <> '' THEN {_clean(_BYP)} WHEN {_INT} <> '' THEN {_clean(_INT)} WHEN tokens >= {MAX_TOKENS} AND NOT {_has("</ans>")} THEN NULL WHEN {_THE} <> '' THEN {_clean(_THE)} END"""


def _extract(spark, sf_dir, policy) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", policy(F.col("completion"), F.col("tokens_emitted"), F.lit(MAX_TOKENS)).alias("a")).select("trace_id", "a.*")


@query(f"{T_} SELECT trace_id, {_STRICT_ANSWER} AS answer, {_STRICT} AS method FROM {_X}")
def extract_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, A.strict)


_DED = r"trim(regexp_extract(x, '(?s)<reg:deduce>(.*?)(?:</reg:deduce>|</think>|$)', 1))"
_LAST = rf"(CASE WHEN {_has('</reg:deduce>', '</reg:verify>')} THEN coalesce(regexp_extract_all({_DED}, '(?:=\s*|≡\s*)([-+]?\d+(?:\.\d+)?(?:/\d+)?)', 1)[-1], '') ELSE '' END)"


@query(_policy([_EMPTY, (f"tokens >= {MAX_TOKENS} AND NOT {_has('</ans>', chr(92) + 'boxed{', '</reg:bypass>', '</reg:deduce>', '</reg:verify>', '</think>')}", "truncated_incomplete_derivation")],
               [(_ANS, "closed_ans_tag"), (_BYP, "closed_bypass_tag"), (_BOX, "latex_boxed"), (_THE, "symbolic_therefore"), (_LAST, "deduce_equality_rhs")]))
def extract_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, A.robust)


_HEAD = r"regexp_replace(trim(regexp_extract(x, '(?i)(?:Final Answer|Answer):\s*([^\n]+)', 1)), '[*$`]', '', 'g')"


@query(_policy([_EMPTY, (f"tokens >= {MAX_TOKENS} AND NOT {_has('</ans>', chr(92) + 'boxed{', '</reg:bypass>')}", "truncated_incomplete_derivation")],
               [(_ANS, "closed_ans_tag"), (_BYP, "closed_bypass_tag"), (_BOX, "latex_boxed"), (_THE, "symbolic_therefore"), (_HEAD, "explicit_final_answer_header")]))
def extract_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extract(spark, sf_dir, A.ablation)


_AFTER = "CASE WHEN strpos(x, '</think>') > 0 THEN string_split(x, '</think>')[-1] ELSE x END"
_SAME = r"'verify\(\s*(-?\d+(?:\.\d+)?)\s*==\s*(-?\d+(?:\.\d+)?)\s*\)\s*→\s*✓'"
_VERIFIED = f"list_filter(list_zip(regexp_extract_all(x, {_SAME}, 1), regexp_extract_all(x, {_SAME}, 2)), lambda p: p[1] = p[2])[1][1]"
_LENIENT = rf"coalesce(nullif({_ANS}, ''), nullif({_BYP}, ''), nullif({_INT}, ''), nullif(regexp_extract(x, '(?i)∴\s*(?:ans\s*=\s*|answer\s*=\s*)?(-?\d+(?:\.\d+)?)', 1), ''), {_VERIFIED}, regexp_extract_all({_AFTER}, '[-+]?\d+')[-1])"


@query(f"{T_} SELECT trace_id, {_LENIENT} AS answer FROM {_X}")
def extract_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", A.lenient(F.col("completion")).alias("answer"))


_ASSIGN, _LEAD = r"(?:∴\s*)?ans\s*=\s*([^\s|✓✗\n<@]+)", r"^([+-]?\d+(?:\.\d+)?|[Tt]rue|[Ff]alse|[Nn]one)(?:[^0-9a-zA-Z.]|$)"
_GRAMMAR = rf"CASE WHEN regexp_matches(x, '(?s)<ans>.*?</ans>') THEN trim(regexp_extract(x, '(?s)<ans>(.*?)</ans>', 1)) WHEN regexp_matches(x, '(?s)<reg:bypass>.*?</reg:bypass>') THEN trim(regexp_extract(x, '(?s)<reg:bypass>(.*?)</reg:bypass>', 1)) ELSE coalesce(nullif(regexp_extract(x, '{_ASSIGN}', 1), ''), nullif(regexp_extract(trim({_AFTER}), '{_LEAD}', 1), '')) END"


@query(f"{T_} SELECT trace_id, {_GRAMMAR} AS answer FROM {_X}")
def extract_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", A.grammar(F.col("completion")).alias("answer"))


@query()
def extract_base_registers_modern(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("completion")
    return traces(spark, sf_dir).select("trace_id", A.base(c).alias("base"), A.registers(c).alias("registers"), A.modern(c).alias("modern"))


def _num(e: str) -> str:
    return rf"try_cast(CASE WHEN regexp_matches({e}, '{A.NUMBER}') THEN {e} END AS DOUBLE)"


def _digits(e: str) -> str:
    return _num(rf"regexp_replace({e}, '[^\d.\-]', '', 'g')")


_VERIFY = f"""CASE WHEN answer IS NULL OR trim(answer) = '' THEN 'fail' WHEN e = g THEN 'string_exact' WHEN abs({_digits("e")} - {_digits("g")}) < 1e-3 OR ({_digits("g")} <> 0 AND abs({_digits("e")} - {_digits("g")}) / abs({_digits("g")}) < 1e-3) THEN 'float_approx' ELSE 'fail' END"""


@query(f"""{T_}, a AS (SELECT trace_id, truth, category, {_LENIENT} AS old, {_STRICT_ANSWER} AS answer, {_STRICT} AS method FROM {_X}),
b AS (SELECT *, {_clean("lower(answer)")} AS e, {_clean("lower(truth)")} AS g, lower(old) AS oe, lower(truth) AS og FROM a),
c AS (SELECT method, coalesce(oe = og OR abs({_digits("oe")} - {_digits("og")}) < 0.05 OR abs({_digits("oe")} - {_digits("og")}) / nullif(abs({_digits("og")}), 0) < 0.01, false) AS o, {_VERIFY} <> 'fail' AS w FROM b)
SELECT method, count(*) AS n, count(*) FILTER (WHERE o) AS old, count(*) FILTER (WHERE w) AS "new", count(*) FILTER (WHERE o AND NOT w) AS flipped_to_fail, count(*) FILTER (WHERE w AND NOT o) AS flipped_to_pass, count(*) FILTER (WHERE o AND w) AS kept_pass FROM c GROUP BY method""")
def rescoring_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.transitions(receipts.rescored(traces(spark, sf_dir), MAX_TOKENS), "method")


@query(f"""{T_}, a AS (SELECT trace_id, truth, {_GRAMMAR} AS answer FROM {_X}), b AS (SELECT *, {_clean("lower(answer)")} AS e, {_clean("lower(truth)")} AS g FROM a) SELECT trace_id, answer, {_VERIFY} AS method FROM b""")
def verify_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).select("trace_id", A.grammar(F.col("completion")).alias("answer"), "ground_truth")
    return rows.select("trace_id", "answer", A.verify_method(F.col("answer"), F.col("ground_truth")).alias("method"))


# -- trace language -----------------------------------------------------------------------------------------------
_BODYX = f"CASE WHEN regexp_matches(x, '{_PAD}') THEN trim(regexp_extract(x, '{_PAD}', 3)) WHEN regexp_matches(x, '(?s)<reg:deduce>.*?</reg:deduce>') THEN trim(regexp_extract(x, '(?s)<reg:deduce>(.*?)</reg:deduce>', 1)) WHEN regexp_matches(x, '(?s)<think>.*?</think>') THEN trim(regexp_extract(x, '(?s)<think>(.*?)</think>', 1)) ELSE trim(x) END"
_STEPS = f"""s0 AS (SELECT trace_id, list_filter(list_transform(string_split(string_split({_BODYX}, '∴')[1], '|'), lambda s: trim(s)), lambda s: s <> '') AS l FROM {_X}),
s AS (SELECT trace_id, unnest(range(len(l))) AS step_index, unnest(l) AS raw_text FROM s0),
k AS (SELECT *, CASE WHEN regexp_matches(raw_text, '{S.PLAN_START}') THEN 'plan' {" ".join(f"WHEN regexp_matches(raw_text, '{p}') THEN '{n}'" for n, p in S.KINDS)} ELSE 'transform' END AS kind FROM s)"""
_AT = dict(S.KINDS)


@query(f"""{T_}, {_STEPS} SELECT trace_id, step_index, kind, raw_text, CASE WHEN kind = 'declaration' THEN regexp_extract(raw_text, '{_AT["declaration"]}', 1) END AS var_name, CASE WHEN kind = 'declaration' THEN regexp_extract(raw_text, '{_AT["declaration"]}', 2) END AS expression,
  CASE WHEN kind = 'verify' THEN regexp_extract(raw_text, '{_AT["verify"]}', 1) END AS condition, CASE WHEN kind = 'verify' THEN regexp_extract(raw_text, '{_AT["verify"]}', 2) <> '✗' END AS passed,
  CASE WHEN kind = 'transform' THEN trim(string_split(raw_text, '→')[1]) END AS lhs, CASE WHEN kind = 'transform' THEN CASE WHEN strpos(raw_text, '→') > 0 THEN trim(string_split(raw_text, '→')[2]) ELSE raw_text END END AS rhs FROM k""")
def step_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.explode_steps(traces(spark, sf_dir))
    return s.select("trace_id", F.col("step_index").cast("long").alias("step_index"), "kind", "raw_text", "var_name", "expression", "condition", "passed", "lhs", "rhs")


@query(f"{T_}, {_STEPS} SELECT kind, count(*) AS n, count(DISTINCT trace_id) AS traces FROM k GROUP BY kind")
def step_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.explode_steps(traces(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("trace_id").alias("traces"))


@query(rf"""{T_}, p AS (SELECT trace_id, trim(regexp_extract(x, '(?s)<reg:plan>(.*?)</reg:plan>', 1)) AS b FROM {_X} WHERE strpos(x, '<reg:plan>') > 0)
SELECT trace_id, trim(regexp_extract(b, 'concept:([^|]*)', 1)) AS concept, trim(regexp_extract(b, '(?:theorem|identity|recurrence|formula):([^|]*)', 1)) AS theorem, trim(regexp_extract(b, '(?:strategy|method):([^|]*)', 1)) AS strategy, 'level=' || trim(regexp_extract(b, 'level:([^|]*)', 1)) AS metadata FROM p""")
def plan_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).where(F.contains("completion", F.lit("<reg:plan>"))).select("trace_id", S.plan_directive(R.register(F.col("completion"), "plan")).alias("p"))
    return rows.select("trace_id", "p.concept", "p.theorem", "p.strategy", F.array_join(F.transform("p.metadata", lambda m: F.concat(m["key"], F.lit("="), m["value"])), ",").alias("metadata"))


@query(f"""{T_} SELECT trace_id, trim(regexp_extract(x, 'intent: ([^|<]*)', 1)) AS intent, trim(regexp_extract(x, 'strategy:([^|<]*)', 1)) AS strategy, trim(regexp_extract(x, 'tone:([^|<]*)', 1)) AS tone FROM {_X} WHERE strpos(x, '<reg:intent>') > 0""")
def intent_directive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).where(F.contains("completion", F.lit("<reg:intent>")))
    return rows.select("trace_id", S.intent_directive(R.register(F.col("completion"), "intent")).alias("p")).select("trace_id", "p.*")


def _tagged(tag: str) -> str:
    return f"regexp_matches(x, '(?s)<{tag}>.*?</{tag}>')"


_DOCUMENT = f"""body AS (SELECT trace_id, trim(x) AS x, {_BODYX} AS body FROM {_X}),
parts AS (SELECT *, trim(nullif(regexp_extract(x, '(?s)<ans>(.*?)</ans>', 1), '')) AS answer, contains(body, '∴') AS sign, regexp_matches(x, '{_PAD}') AS pad, {_tagged("reg:plan")} AS has_plan,
  list_filter(list_transform(string_split(string_split(body, '∴')[1], '|'), lambda p: trim(p)), lambda p: p <> '') AS steps, trim(substr(body, strpos(body, '∴') + 1)) AS rest FROM body),
kinds AS (SELECT *, CASE WHEN {_tagged("reg:bypass")} THEN 'bypass' WHEN {_tagged("reg:intent")} THEN 'intent' WHEN NOT {_tagged("think")} AND (contains(x, '<think>') OR contains(x, '</think>')) THEN 'malformed'
  WHEN body = '' AND NOT has_plan AND NOT pad THEN 'empty' WHEN contains(body, 'intent:') THEN 'intent' WHEN NOT sign AND len(steps) = 0 THEN 'none' WHEN pad THEN 'scratchpad' WHEN has_plan THEN 'plan_deduce'
  WHEN {_tagged("reg:deduce")} THEN 'deduce' ELSE 'trace' END AS kind FROM parts),
document AS (SELECT *, kind IN ('none', 'scratchpad', 'plan_deduce', 'deduce', 'trace') AS of_trace, CASE WHEN sign THEN coalesce(trim(nullif(regexp_extract(rest, 'ans\\s*=\\s*(.+)', 1), '')), rest) END AS final FROM kinds)"""


@query(f"""{T_}, {_DOCUMENT} SELECT trace_id, kind AS register_type, kind NOT IN ('malformed', 'none') AS is_valid,
  CASE WHEN kind = 'bypass' THEN trim(regexp_extract(x, '(?s)<reg:bypass>(.*?)</reg:bypass>', 1)) WHEN of_trace THEN coalesce(final, answer) ELSE answer END AS extracted,
  list_filter([CASE WHEN kind = 'malformed' THEN 'E101' END, CASE WHEN of_trace AND NOT sign THEN 'E102' END, CASE WHEN kind = 'none' THEN 'E104' END, CASE WHEN of_trace AND kind <> 'none' AND final <> answer THEN 'E203' END,
    {", ".join(f"CASE WHEN of_trace AND contains(lower(body), '{p}') THEN 'E301' END" for p in T.FILLER_PHRASES)}], lambda c: c IS NOT NULL) AS codes FROM document""")
def document_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).select("trace_id", "completion", S.trace_body(F.col("completion")).alias("body"))
    return rows.select("trace_id", S.document(F.col("completion"), F.col("body")).alias("d")).select("trace_id", "d.*")


@query()
def invariant_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps are parsed by expressions; only the check of each trace's array of steps is Python."""
    body = S.raw_steps(S.trace_body(F.col("completion")))
    rows = traces(spark, sf_dir).select("trace_id", F.to_json(F.transform(body, S.parse_step)).alias("steps"))
    return executor.invariant_rows(rows)


@query()
def scratchpad_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executor.scratchpad_steps(traces(spark, sf_dir))


@query()
def scratchpad_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executor.scratchpad_summary(traces(spark, sf_dir)).select("trace_id", "depth", "domain", "n_steps", "answer", "failures", "cycle", "is_valid")


@query(f"""{T_} SELECT trace_id, trace_id % 10 = 3 AND trace_id % 2 = 0 AS is_valid, CAST(NULL AS VARCHAR) AS certified_answer, CASE WHEN trace_id % 10 = 3 AND trace_id % 2 = 0 THEN 'DEDUCING' ELSE 'ROLLBACK' END AS state FROM traces WHERE trace_id % 10 IN (2, 3)""")
def terminal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executor.terminal_audit(traces(spark, sf_dir)).select("trace_id", "is_valid", "certified_answer", "state")


@query()
def decompress_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", S.decompress(F.col("completion")).alias("english"))


@query(rf"""{T_}, f AS (SELECT CASE WHEN regexp_matches(v, '✗|FAIL|(?i:invalid)') THEN 'rejected' WHEN regexp_matches(v, '✓|PASS') THEN 'accepted' ELSE 'indeterminate' END AS signal FROM (SELECT regexp_extract(x, '(?s)<reg:verify>(.*?)</reg:verify>', 1) AS v FROM {_X} WHERE strpos(x, '<reg:deduce>') > 0 AND strpos(x, '<reg:verify>') > 0))
SELECT signal, count(*) AS n FROM f GROUP BY signal""")
def falsification_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("completion")
    rows = traces(spark, sf_dir).where(F.contains(c, F.lit("<reg:deduce>")) & F.contains(c, F.lit("<reg:verify>")))
    return rows.select(R.verification_signal(F.regexp_extract(c, r"(?s)<reg:verify>(.*?)</reg:verify>", 1)).alias("signal")).groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


@query()
def falsification_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deductions with a corrupted equality, audited again: what share a check that looks at the numbers rejects."""
    rows = traces(spark, sf_dir).where(F.contains("completion", F.lit("<reg:deduce>")))
    bad = rows.select("trace_id", F.concat(F.lit("<reg:deduce>"), S.corrupt_last_equality(R.register(F.col("completion"), "deduce")), F.lit("</reg:deduce>")).alias("completion"))
    return executor.terminal_audit(bad).groupBy("is_valid").agg(F.count(F.lit(1)).alias("n"))


# -- summaries ----------------------------------------------------------------------------------------------------
_TIMED = f"{R_}, timed AS (SELECT *, tokens_emitted * (18 + ix) AS latency_ms, ix = 4 AND problem_id % 64 = 0 AS is_estimate FROM receipts)"


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with a latency, and some energies that are estimates."""
    ix = F.col("ix")
    return receipts_view(spark, sf_dir).select("*", (F.col("tokens_emitted") * (ix + 18)).alias("latency_ms"), ((ix == 4) & (F.col("problem_id") % 64 == 0)).alias("is_estimate"))


@query(f"""{_TIMED}, c AS (SELECT budget, arm, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, sum(mj)::BIGINT AS mj, sum(latency_ms)::BIGINT AS ms, sum(tokens_emitted)::BIGINT AS tokens, bool_or(is_estimate) AS is_estimate FROM timed GROUP BY ALL)
SELECT budget, arm, n, correct, correct::DOUBLE / n AS accuracy, mj / 1000.0e0 AS total_joules, mj::DOUBLE / nullif(correct * 1000, 0) AS joules_per_correct, ms::DOUBLE / nullif(correct * 1000, 0) AS latency_per_correct,
  ms::DOUBLE / (n * 1000) AS mean_latency, tokens::DOUBLE / n AS mean_tokens, is_estimate FROM c""")
def valuation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.valuation(timed(spark, sf_dir), ("budget", "arm"))


@query(f"""{_TIMED}, c AS (SELECT arm, count(*) AS n, count(*) FILTER (WHERE is_correct) AS correct, sum(latency_ms)::BIGINT AS ms, sum(tokens_emitted)::BIGINT AS tokens, min(tokens_emitted) AS min_tokens, max(tokens_emitted) AS max_tokens FROM timed GROUP BY arm)
SELECT arm, n, correct, correct::DOUBLE / n AS accuracy, {LO} AS ci_lo, {HI} AS ci_hi, tokens::DOUBLE / n AS mean_tokens, min_tokens, max_tokens, ms::DOUBLE / (n * 1000) AS mean_latency,
  correct::DOUBLE / n * 100.0e0 / (tokens::DOUBLE / n) AS pass_per_token, (SELECT tokens::DOUBLE / n FROM c WHERE arm = 'A') / (tokens::DOUBLE / n) AS compression FROM c""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.ablation(timed(spark, sf_dir))


_CONVERTED = f"{T_}, conv AS (SELECT category AS source, strpos(completion, '∴') > 0 AS converted, octet_length(encode(completion)) AS english_tokens, length(completion) // 2 AS symbolic_tokens, tokens_emitted * 20 AS latency_ms FROM traces)"


def converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("completion")
    return traces(spark, sf_dir).select(F.col("category").alias("source"), F.contains(c, F.lit("∴")).alias("converted"), F.octet_length(c).cast("long").alias("english_tokens"), F.floor(F.length(c) / 2).alias("symbolic_tokens"), (F.col("tokens_emitted") * 20).alias("latency_ms"))


@query(f"""{_CONVERTED}, c AS (SELECT source, count(*) AS processed, count(*) FILTER (WHERE converted) AS converted, sum(round((1 - symbolic_tokens::DOUBLE / greatest(english_tokens, 1)) * 1e9)::BIGINT) FILTER (WHERE converted)::BIGINT AS saved FROM conv GROUP BY source)
SELECT source, processed, converted, processed - converted AS rejected, saved::DOUBLE / nullif(converted, 0) / 1e9 AS mean_compression FROM c""")
def conversion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.conversion(converted(spark, sf_dir))


@query(f"""{_CONVERTED} SELECT sum(english_tokens)::BIGINT AS english_tokens, sum(symbolic_tokens)::BIGINT AS symbolic_tokens, (1 - sum(symbolic_tokens)::DOUBLE / sum(english_tokens)::DOUBLE) * 100.0e0 AS savings, sum(latency_ms) / 1000.0e0 AS seconds FROM conv""")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.token_savings(converted(spark, sf_dir))


def _light(e: str) -> str:
    for junk in ("$", "\\text{", "\\mathrm{", "\\mathbf{", "%", ","):
        e = f"replace({e}, '{junk}', '')"
    return f"trim({e})"


def _written(e: str) -> str:
    """A number written plainly or as a/b."""
    return f"coalesce({_num(e)}, {_num(f"string_split({e}, '/')[1]")} / nullif({_num(f"string_split({e}, '/')[2]")}, 0))"


def _word(e: str) -> str:
    return f"CASE WHEN {e} IN ('true', 'yes', '1') THEN true WHEN {e} IN ('false', 'no', '0') THEN false END"


@query(f"""{T_}, a AS (SELECT lower(trim({_GRAMMAR})) AS a, lower(trim(truth)) AS b, {_light(_GRAMMAR)} AS la, {_light("truth")} AS lb FROM {_X}),
v AS (SELECT *, {_written("la")} AS na, {_written("lb")} AS nb FROM a)
SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(a = b, false) OR coalesce({_word("a")} = {_word("b")}, false) OR coalesce(abs(na - nb) <= greatest(1e-4, 1e-4 * greatest(abs(na), abs(nb))), false) OR coalesce(lower(la) = lower(lb), false)) AS correct,
  correct::DOUBLE / n AS pass_at_1 FROM v""")
def plain_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.plain_pass_rate(traces(spark, sf_dir), A.grammar(F.col("completion")), A.verify_plain)


@query(f"""{R_} SELECT 'arm' AS dimension, arm AS value FROM receipts GROUP BY arm UNION ALL SELECT 'budget', budget::VARCHAR FROM receipts GROUP BY budget UNION ALL SELECT 'category', category FROM receipts GROUP BY category""")
def receipt_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.dimensions(receipts_view(spark, sf_dir), "arm", "budget", "category")


@query(f"""{R_}, s AS (SELECT problem_id, is_correct FROM receipts WHERE arm = 'C' AND budget = 512 AND problem_id % 3 <> 0) SELECT o_orderkey AS problem_id, coalesce(is_correct, false) AS is_correct FROM orders LEFT JOIN s ON problem_id = o_orderkey""")
def audited_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item, with a verdict for those that a run has scored."""
    scored = receipts_view(spark, sf_dir).where("arm = 'C' and budget = 512 and problem_id % 3 <> 0")
    return summaries.audited(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("problem_id")), scored, "problem_id")


@query("""WITH h AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('42:' || p_partkey), p_partkey) AS place FROM part) SELECT p_partkey, place, 'EVAL-200-' || CASE WHEN place < 1000 THEN lpad(place::VARCHAR, 3, '0') ELSE place::VARCHAR END AS label FROM h""")
def numbered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.numbered(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM part QUALIFY place <= 3""")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.first_of_each(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"], 3)


@query("""SELECT p_type, min(p_partkey) AS p_partkey FROM part GROUP BY p_type""")
def vocabulary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.ordered_distinct(table(spark, sf_dir, "part"), "p_type", "p_partkey")


@query(f"""{R_} SELECT category, count(*) AS n FROM receipts GROUP BY category""")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.histogram(receipts_view(spark, sf_dir), "category")


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '-?[0-9]+(?:\.[0-9]+)?')) AS n_numbers, substring(text, 1, 800) AS head, right(text, 120) AS tail FROM documents""")
def text_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.numbers(c)).cast("long").alias("n_numbers"), T.head(c).alias("head"), T.tail(c).alias("tail"))


@query()
def extract_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", A.english(F.col("completion")).alias("answer"))


@query(f"""{T_}, {_STEPS}, c AS (SELECT trace_id, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {n}" for n, k in (("declarations", "declaration"), ("transformations", "transform"), ("verifications", "verify"), ("plans", "plan")))}
  FROM k GROUP BY trace_id)
SELECT t.trace_id, {", ".join(f"coalesce(c.{n}, 0)::INTEGER AS {n}" for n in ("total", "declarations", "transformations", "verifications", "plans"))} FROM traces t LEFT JOIN c USING (trace_id)""")
def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", S.step_counts(S.trace_body(F.col("completion"))).alias("s")).select("trace_id", "s.*")


@query()
def decision_with_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.decision_with_interval(receipts_view(spark, sf_dir), "C", "D")


@query(f"""{T_}, {_DOCUMENT}, q AS (SELECT trace_id, x, kind, CASE WHEN {_tagged("reg:plan")} AND kind NOT IN ('bypass', 'intent', 'malformed') THEN trim(regexp_extract(regexp_extract(x, '(?s)<reg:plan>(.*?)</reg:plan>', 1), 'concept:([^|]*)', 1)) END AS concept FROM document)
SELECT trace_id, CASE WHEN {_re(T.TRAILING_NOISE)} OR regexp_matches(x, '{T.OPEN_TAG_AT_END}') THEN -1.0e0 ELSE 0.0e0 END + CASE WHEN kind NOT IN ('malformed', 'none') THEN 0.5e0 ELSE -0.3e0 END
    + CASE WHEN contains(x, '∴') OR contains(x, '<ans>') THEN 0.2e0 ELSE 0.0e0 END - CASE WHEN {_LEAK} > 0.25 THEN 0.3e0 ELSE 0.0e0 END AS form,
  CASE WHEN concept IS NULL THEN 0.0e0 ELSE 0.3e0 + CASE WHEN contains(lower(concept), 'linear_sum') OR contains('linear_sum', lower(concept)) THEN 0.2e0 ELSE 0.0e0 END END AS concept FROM q""")
def reward_form_and_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("completion")
    rows = traces(spark, sf_dir).withColumn("_body", S.trace_body(c)).select("trace_id", "completion", S.document(c, F.col("_body")).alias("d"))
    concept = S.declared_concept(c, F.col("d.register_type"))
    return rows.select("trace_id", rewards.form_and_noise(c, F.col("d.is_valid")).alias("form"), rewards.concept_alignment(concept, F.lit("linear_sum")).alias("concept"))


# -- rewards ------------------------------------------------------------------------------------------------------
_TOK = rf"coalesce(list_sum(list_transform(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''), lambda w: length(w) - length(translate(w, '{T.OPERATORS}', '')) + greatest(1, length(translate(w, '{T.OPERATORS}', '')) // 4))), 0)::DOUBLE"
_TAIL = "CASE " + " ".join(f"WHEN strpos(x, '{t}') > 0 THEN trim(string_split(x, '{t}')[-1])" for t in R.CLOSING_TAGS) + " ELSE '' END"
_REWARD = rf"""{T_}, w AS (SELECT *, {_TOK} AS tok, {_TAIL} AS tail, {_GRAMMAR} AS answer, CASE WHEN trace_id % 10 = 9 OR (trace_id % 10 = 2 AND truth = '0') THEN 2.5e0 ELSE 0.0e0 END AS omega FROM {_X}),
r AS (SELECT *, coalesce(answer = truth, false) AS good, len(list_filter(string_split_regex(tail, '\s+'), lambda v: v <> '')) AS tt FROM w)"""


@query(f"""{_REWARD} SELECT trace_id, CASE WHEN good THEN 2.5e0 * (0.4e0 + 0.6e0 * (35.0e0 / (35.0e0 + greatest(1.0e0, tok)))) - 0.001e0 * tok - omega + CASE WHEN omega = 0 THEN CASE WHEN tt <= 4 THEN 0.5e0 WHEN tt > 25 THEN -0.5e0 ELSE 0.0e0 END ELSE 0.0e0 END ELSE -1.0e0 - omega END AS reward FROM r""")
def reward_parsimony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", rewards.parsimony(F.col("completion"), F.col("ground_truth")).alias("reward"))


_DL = rewards.DEPTH_LIMITS
_DEPTH = ORACLES["cognitive_depth"].split("SELECT trace_id, ", 1)[1].rsplit(" AS depth FROM", 1)[0]


@query(f"""{_REWARD}, l(depth, free, hard, slope) AS (VALUES {", ".join(f"('{d}', {a}.0e0, {b}.0e0, {c}e0)" for d, (a, b, c) in _DL.items())}), j AS (SELECT r.*, l.* FROM (SELECT *, {_DEPTH} AS dd FROM r) r JOIN l ON l.depth = dd)
SELECT trace_id, CASE WHEN good THEN 2.0e0 * (1.0e0 + 0.5e0 * greatest(0.0e0, (free - tok) / free)) ELSE -0.8e0 END - greatest(0.0e0, tok - hard) * slope - omega + CASE WHEN good AND omega = 0 THEN CASE WHEN tt <= 4 THEN 0.5e0 WHEN tt > 25 THEN -0.5e0 ELSE 0.0e0 END ELSE 0.0e0 END AS reward FROM j""")
def reward_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", rewards.gradient(F.col("completion"), F.col("ground_truth")).alias("reward"))


# Waste is told by its rules, whatever the template: a run of one to three words three times over, and web residue.
_REPEATS = "len(w) >= 6 AND (" + " OR ".join(f"len(list_filter(range(1, len(w) - {3 * n} + 2), lambda i: w[i:i + {n - 1}] = w[i + {n}:i + {2 * n - 1}] AND w[i:i + {n - 1}] = w[i + {2 * n}:i + {3 * n - 1}])) > 0" for n in (1, 2, 3)) + ")"
_MEASURED = rf"""{T_}, m0 AS (SELECT *, {_TOK} AS tok, coalesce({_GRAMMAR} = truth, false) AS good, regexp_extract_all(x, '[\p{{L}}\p{{N}}_.-]+') AS w FROM {_X}),
m AS (SELECT *, CASE WHEN {_REPEATS} THEN 2.5e0 ELSE 0.0e0 END + CASE WHEN {_re(T.WEB_DEBRIS, "(?i)")} THEN 2.0e0 ELSE 0.0e0 END AS omega FROM m0)"""


@query(f"""{_MEASURED}, q AS (SELECT trace_id, tok, omega, good, len(list_filter(string_split_regex(CASE {" ".join(f"WHEN strpos(x, '{t}') > 0 THEN trim(string_split(x, '{t}')[-1])" for t in ("</ans>", "</reg:deduce>", "</reg:bypass>", "</reg:intent>", "</think>"))} ELSE '' END, '\\s+'), lambda v: v <> '')) AS tt FROM m)
SELECT trace_id, CASE WHEN good AND omega = 0 THEN CASE WHEN tt <= 4 THEN 1.2e0 WHEN tt > 20 THEN -1.0e0 ELSE 0.0e0 END ELSE 0.0e0 END - omega
  + CASE WHEN tok > 50 THEN -least(1.5e0, 0.03e0 * (tok - 50)) WHEN good AND omega = 0 THEN 0.5e0 * greatest(0.0e0, (50 - tok) / 50.0e0) ELSE 0.0e0 END AS reward FROM q""")
def reward_stage4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trace_id", rewards.stage4(F.col("completion"), F.col("ground_truth"), F.lit("symbolic_deductive")).alias("reward"))


@query(f"""{_MEASURED}, q AS (SELECT *, length(trim(regexp_extract(x, '(?s)<think>(.*?)</think>', 1))) AS thought FROM m)
SELECT trace_id, CASE WHEN good THEN 1.0e0 ELSE -0.6e0 END AS correctness,
  CASE WHEN {_tagged("reg:bypass")} OR thought = 0 THEN CASE WHEN good THEN 0.9e0 ELSE -0.3e0 END WHEN thought < 20 THEN CASE WHEN good THEN 0.2e0 ELSE -0.2e0 END ELSE -0.8e0 END AS bypass,
  CASE WHEN regexp_matches(x, '(?:<reg:intent>|intent:)\\s*[^|\\n<]+') THEN 0.6e0 ELSE -0.3e0 END AS intent,
  CASE WHEN contains(x, '<reg:bypass>') OR (thought = 0 AND NOT good) THEN -0.8e0 WHEN NOT good THEN 0.0e0 ELSE greatest(0.0e0, least(0.6e0, (60 - tok) / 60.0e0)) * 0.5e0 + CASE WHEN contains(x, '<reg:plan>') THEN 0.25e0 ELSE 0.0e0 END END AS symbolic_deductive FROM q""")
def reward_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("completion"), F.col("ground_truth")
    rows = traces(spark, sf_dir).withColumn("_right", rewards.is_correct(c, t))  # once for all four
    return rows.select("trace_id", F.when(F.col("_right"), 1.0).otherwise(-0.6).alias("correctness"), *[rewards.by_register(c, F.col("_right"), F.lit(r)).alias(r) for r in ("bypass", "intent", "symbolic_deductive")])


@query()
def reward_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return executor.composite_reward(traces(spark, sf_dir))


# -- arithmetic ---------------------------------------------------------------------------------------------------
@query("""SELECT o_orderkey, (SELECT sum(n // CAST(pow(p, k) AS BIGINT))::BIGINT FROM range(1, 13) AS r(k)) AS valuation FROM (SELECT o_orderkey, 50 + o_orderkey % 2451 AS n, [2, 3, 5, 7, 11][1 + o_orderkey % 5] AS p FROM orders)""")
def legendre(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.get(F.array(*map(F.lit, (2, 3, 5, 7, 11))), (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", M.legendre(50 + F.col("o_orderkey") % 2451, p).alias("valuation"))


@query("""SELECT p_partkey, (SELECT min(x) FROM range(77) AS r(x) WHERE x % 7 = p_partkey % 7 AND x % 11 = p_partkey * 3 % 11) AS solution FROM part""")
def crt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pair = lambda r, m: F.struct(r.cast("bigint").alias("r"), F.lit(m).cast("bigint").alias("m"))
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", M.solve_crt(F.array(pair(k % 7, 7), pair(k * 3 % 11, 11))).alias("solution"))


@query("""SELECT p_partkey, list_reduce(list_transform(range(1 + p_partkey % 50), lambda i: (2 + p_partkey % 9) % 97), lambda a, b: a * b % 97)::BIGINT AS power, (SELECT count(*) FROM range(1, 2 + p_partkey % 500) AS r(k) WHERE gcd(k, 1 + p_partkey % 500) = 1) AS phi FROM part""")
def modpow_totient(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", M.power_mod(2 + k % 9, 1 + k % 50, F.lit(97)).alias("power"), M.euler_phi(1 + k % 500).alias("phi"))


@query("""SELECT n, CASE WHEN n = 0 THEN 1 ELSE CAST(round(factorial(n::INTEGER)::DOUBLE / exp(1)) AS BIGINT) END AS d, CAST((n + 3) * (n + 2) * (n + 1) // 6 AS BIGINT) AS c FROM (SELECT DISTINCT p_partkey % 13 AS n FROM part)""")
def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 13).cast("int").alias("n")).distinct().select("n", M.derangements(n).alias("d"), M.choose(n + 3, F.lit(3)).alias("c"))


# -- energy, files, generated data, streams -------------------------------------------------------------------------
_POWER = "s AS (SELECT user_id AS run_id, epoch_us(ts) AS t, floor(value * 1000)::BIGINT AS mw FROM events)"


@query(f"""WITH {_POWER}, w AS (SELECT run_id, greatest(mw - 6750, 0) + lag(greatest(mw - 6750, 0)) OVER o AS q, t - lag(t) OVER o AS dt FROM s WINDOW o AS (PARTITION BY run_id ORDER BY t, mw))
SELECT run_id, count(*) AS n, coalesce(sum(q::HUGEINT * dt)::DOUBLE, 0.0e0) / 2e9 AS joules FROM w GROUP BY run_id""")
def energy_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.trapezoid(power_samples(spark, sf_dir))


@query(f"""WITH {_POWER} SELECT run_id, count(*) AS n, sum(greatest(mw - 6750, 0))::DOUBLE * (max(t) - min(t))::DOUBLE / count(*) / 1e9 AS joules FROM s GROUP BY run_id""")
def energy_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return energy.mean_power(power_samples(spark, sf_dir))


@query("""SELECT doc_id, length(encode(text)) AS bytes, sha256(text) AS sha256 FROM documents""".replace("length(encode(text))", "octet_length(encode(text))"))
def checksum_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query()
def concept_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.concept_curriculum(spark, per_family=100)


@query()
def contrastive_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrast.contrastive(generators.concept_curriculum(spark, per_family=100))


@query()
def depth_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.depth_curriculum(spark)


@query()
def convert_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.convert_solutions(traces(spark, sf_dir).select("trace_id", "completion"))


from . import mechanisms  # noqa: E402, F401  registers its queries
