"""Mixing to target weights by soft membership: a labelled-table classifier, then least squares over document rates.

DataFrame functions only.  The classifier is a naive Bayes model over telling words, a literal array of bounded size.  The rates solve a least-squares problem by projected gradient steps: rates
are nonnegative, without any other bound.  A step needs of all documents only the domains' expected token totals and
the Gram matrix of the posteriors (a few sums), which scales the gradient; a document's rate is a fold over the steps so far.  No state
is kept per document and a lost executor costs nothing but its own rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

#: Domains in order, and the token shares wanted of them.
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.90, "low": 0.095, "toxic": 0.005}
#: Expected tokens of the first domain after mixing, beside those before: the scale of all targets.
GROWTH = 1.005
#: Labelled rows the classifier is fitted on (those of smallest hash), telling words at most, texts and likelihood ratio (twice its
#: logarithm; also for each text fitted on) a word needs to tell at all, and the fixed point of its log odds.  Words that tell
#: little are many and tell the same, so their odds must not be added up.
FIT_ROWS, MOST_WORDS, LEAST_TEXTS, LEAST_RATIO, LEAST_RATIO_A_TEXT, UNIT = 20_000, 1024, 5, 25.0, 0.06, 1000
#: Steps of the descent at most, and the miss of any domain, beside all tokens wanted, at which it stops.
STEPS, CLOSE = 60, 1e-5
BLANKS = " \t\n\x0b\f\r"


def label_domain() -> Column:
    """The domain of a row of the labelled table (quality 0/1, toxic 0/1); null if a label is null."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")


def text_words(text: Column) -> Column:
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(body), r"[\x20\x09-\x0D]+"))


def word_marks(words: Column) -> Column:
    """Hashes of 64 bits, two for each word: of its stem and of its last letter."""
    stems = F.transform(words, lambda w: F.xxhash64(F.btrim(w, F.lit(".,;:!?\"'()"))))
    return F.concat(stems, F.transform(words, lambda w: F.xxhash64(F.lit("last"), F.right(w, F.lit(1)))))


def least_runs(words: Column) -> Column:
    """Three least hashes of a text's runs of three words: near copies are likely to share one."""
    runs = F.zip_with(words, F.zip_with(F.slice(words, 2, 1 << 30), F.slice(words, 3, 1 << 30), lambda b, c: F.xxhash64(b, c)), lambda a, bc: F.xxhash64(a, bc))
    seeded = lambda k: F.array_min(F.transform(runs, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*[seeded(k) for k in range(3)])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[dict[str, float], dict[int, list[int]], list[float]]:
    """(prior of each domain, for each telling mark its log odds against the first domain, log odds of texts that hold
    none) from at most ``fit_rows`` labelled rows.

    Of near copies few count, else what only they share would tell.  A mark tells of a domain if the texts of that domain that
    hold it are so many or few that ``LEAST_RATIO`` speaks against chance.  Priors are counted over all labels.  Without labels all priors are equal and nothing tells.
    """
    named = labels.select(F.col(id_col).alias("_id"), label_domain().alias("_domain")).where("_id is not null and _domain is not null")
    share = {r["_domain"]: r["n"] for r in named.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    priors = {d: (share.get(d, 0) + 1) / (total + len(DOMAINS)) for d in DOMAINS}
    some = named.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    seen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    worded = seen.select("_domain", text_words(F.col("_text")).alias("_w"))
    sample = cut(worded.select("_domain", F.array_distinct(word_marks(F.col("_w"))).alias("_b"), least_runs(F.col("_w")).alias("_m")).select("_domain", "_b", *[F.get("_m", F.lit(k)).alias(f"_m{k}") for k in range(3)]))
    few = sample
    for k in range(3):
        few = few.where(f"_m{k} is null").union(few.where(f"_m{k} is not null").dropDuplicates([f"_m{k}"]))
    held = cut(few.select("_domain", "_b"))
    texts = {d: 0 for d in DOMAINS} | {r["_domain"]: r["n"] for r in held.groupBy("_domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all = max(1, sum(texts.values()))
    counted = held.select("_domain", F.explode("_b").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("here"), *[F.count_if(F.col("_domain") == d).alias(d) for d in DOMAINS]).where(F.col("here") >= LEAST_TEXTS)
    least = max(LEAST_RATIO, LEAST_RATIO_A_TEXT * n_all)

    def ratio(d: str) -> Column:
        chance = F.col("here") * (texts[d] / n_all)
        return 2 * (F.when(F.col(d) > 0, F.col(d) * F.ln(F.col(d) / chance)).otherwise(0.0) - F.col(d) + chance)

    most = F.greatest(*[ratio(d) for d in DOMAINS])
    rows = counted.select("b", "here", *DOMAINS, most.alias("most")).where(F.col("most") >= least).orderBy(F.desc("most"), "b").limit(MOST_WORDS).collect()
    marks, without = {}, [math.log(priors[d] / priors[DOMAINS[0]]) for d in DOMAINS[1:]]
    for r in rows:
        q = r["here"] / n_all
        held_by = [min(1 - 1e-6, (r[d] + q) / (texts[d] + 1)) for d in DOMAINS]
        marks[r["b"]] = [round(UNIT * (math.log(x / (1 - x)) - math.log(held_by[0] / (1 - held_by[0])))) for x in held_by[1:]]
        without = [w + math.log((1 - x) / (1 - held_by[0])) for w, x in zip(without, held_by[1:])]
    return priors, marks, without


def _literal(numbers: list[int]) -> Column:
    return F.from_json(F.lit(str(numbers)), "array<bigint>")


def with_posteriors(docs: DataFrame, model, tokens: str, p: str, *, text_col: str = "text") -> DataFrame:
    """All columns, the number of words ``tokens`` and the domain posteriors ``p`` (array in the order of ``DOMAINS``).

    The telling marks that a text holds count once each, however often it holds them, and so does the lack of each.  A text
    without words has the priors.
    """
    priors, marks, without = model
    base, names = DOMAINS[0], docs.columns
    (mine,) = fresh(docs, "mine")
    told = _literal(list(marks))
    rows = docs.withColumn(mine, text_words(F.col(text_col)))
    rows = rows.select(*names, F.size(mine).cast("long").alias(tokens), F.array_intersect(word_marks(F.col(mine)), told).alias(mine))
    table = lambda k: _literal([odds[k] for odds in marks.values()])
    added = lambda k: F.aggregate(mine, F.lit(0).cast("bigint"), lambda s, b: s + F.get(table(k), (F.array_position(told, b) - 1).cast("int")))
    odds = [F.lit(0.0)] + [F.when(F.col(tokens) == 0, math.log(priors[d] / priors[base])).otherwise(without[k] + added(k) / float(UNIT)) for k, d in enumerate(DOMAINS[1:])]
    rows = rows.select(*names, tokens, F.array(*odds).alias(p))
    rows = rows.select(*names, tokens, F.transform(p, lambda x: F.exp(F.greatest(F.lit(-50.0), x - F.array_max(p)))).alias(p))
    return rows.select(*names, tokens, F.transform(p, lambda e: e / F.aggregate(p, F.lit(0.0), lambda a, x: a + x)).alias(p))


def fold_rate(p: str, steps: list[list[float]]) -> Column:
    """A document's rate after ``steps`` from rates of 1, each followed by the projection on what is not negative."""
    if not steps:
        return F.lit(1.0)

    def step(rate: Column, d: Column) -> Column:
        return F.greatest(F.lit(0.0), rate - sum((F.get(p, F.lit(k)) * F.get(d, F.lit(k)) for k in range(1, len(DOMAINS))), F.get(p, F.lit(0)) * F.get(d, F.lit(0))))

    return F.aggregate(F.lit(steps), F.lit(1.0), step)


def wanted_totals(now: list[float], targets: dict[str, float], ceilings: bool = False) -> list[float]:
    """Token totals of the domains: their target shares, on the scale at which the first domain has ``GROWTH`` of its tokens.

    With ``ceilings`` a domain that has less than its target keeps what it has.
    """
    wanted = [now[0] * GROWTH * targets[d] / targets[DOMAINS[0]] for d in DOMAINS]
    return [min(w, x * GROWTH) for w, x in zip(wanted, now)] if ceilings else wanted


def descend(scored: DataFrame, targets: dict[str, float], tokens: str, p: str, ceilings: bool = False) -> tuple[list[list[float]], list[float]]:
    """(steps, miss of each domain beside all tokens wanted): the miss is what the targets ask beyond any nonnegative rates.

    The gradient of a rate is the document's posteriors times the misses.  Misses are scaled by the inverse Gram matrix of the
    posteriors, weighted by tokens, of the documents that are free to move; its diagonal is raised until a step comes closer.
    """
    small = cut(scored.where(F.col(tokens) > 0).select(tokens, F.transform(p, lambda x: F.round(x, 9)).alias(p)).groupBy(p).agg(F.sum(tokens).alias(tokens)))
    each = range(len(DOMAINS))
    (rate,) = fresh(small, "rate")
    part = [F.get(p, F.lit(k)) for k in each]

    def sums(steps: list[list[float]], terms: list[Column]) -> np.ndarray:
        row = small.withColumn(rate, fold_rate(p, steps)).agg(*[F.sum(F.col(tokens) * x) for x in terms]).first()
        return np.array([x or 0.0 for x in row])

    def totals(steps: list[list[float]]) -> np.ndarray:
        return sums(steps, [F.col(rate) * x for x in part])

    def gram(steps: list[list[float]], miss: np.ndarray) -> np.ndarray:
        free = (F.col(rate) > 0) | (sum(x * float(m) for x, m in zip(part, miss)) < 0)
        return sums(steps, [F.when(free, x * y).otherwise(0.0) for x in part for y in part]).reshape(len(each), -1)

    now = totals([])
    if not now.sum():
        return [], [0.0 for _ in each]
    goal = np.array(wanted_totals(list(now), targets, ceilings))
    miss, raised, steps = (now - goal) / goal.sum(), 1e-6, []
    matrix = gram(steps, miss) / goal.sum()
    for _ in range(STEPS):
        if np.abs(miss).max() < CLOSE or raised > 1e4:
            break
        step = np.linalg.solve(matrix + np.eye(len(each)) * (raised * np.trace(matrix) + 1e-12), miss)
        tried = [*steps, [float(x) for x in step]]
        there = (totals(tried) - goal) / goal.sum()
        closer = 1 - np.linalg.norm(there) / np.linalg.norm(miss)
        if closer <= 0:
            raised = max(30 * raised, 1e-4)
            continue
        steps, miss, raised = tried, there, max(1e-9, raised / 10)
        if closer < 1e-4:
            break
        matrix = gram(steps, miss) / goal.sum()
    return steps, [float(x) for x in miss]


def with_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], names: list[str], *, id_col: str, text_col: str, keep: list[str], ceilings: bool = False) -> DataFrame:
    """The columns ``keep``, then words, posteriors, rate and copies (how often the row is taken) under ``names``, for every row.

    Copies are the rate rounded down or up by a hash of id and text, so they are the same at each run and
    repeated rows share their fate.  Null and empty texts have no tokens and the rate of the priors.  The scored
    rows are written once; the descent reads two of their columns.
    """
    tokens, p, rate, copies = names
    scored = with_posteriors(docs, fit(docs, labels, id_col=id_col, text_col=text_col), tokens, p, text_col=text_col)
    draw = F.pmod(F.xxhash64(F.lit("mix"), id_col, text_col), F.lit(1 << 20)) / float(1 << 20)
    scored = cut(scored.select(*keep, tokens, p, draw.alias(copies)))
    steps, _ = descend(scored, targets, tokens, p, ceilings)
    rated = scored.withColumn(rate, F.round(fold_rate(p, steps), 6))
    return rated.select(*keep, tokens, p, rate, F.floor(F.col(rate) + F.col(copies)).cast("int").alias(copies))


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, *, id_col: str = "doc_id", text_col: str = "text", ceilings: bool = False) -> DataFrame:
    """The rows drawn at their rates, with their own columns (of any names); a row with a rate above 1 may come several times.

    Targets are met as given, if need be by many copies of the few texts of a scarce domain and by fewer of all others; with
    ``ceilings`` a domain that has less than its target keeps what it has.
    """
    names = fresh(docs, "tokens", "p", "rate", "copies", "again")
    rated = with_rates(docs, labels, targets, names[:4], id_col=id_col, text_col=text_col, keep=docs.columns, ceilings=ceilings).where(F.col(names[3]) > 0)
    return rated.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(names[3]))).alias(names[4])).select(*docs.columns)


def rate_table(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, p_<domain>..., rate, copies) for every row; text is not carried and other columns are not read."""
    own = docs.select(id_col, text_col)
    names = fresh(own, "tokens", "p", "rate", "copies")
    rated = with_rates(own, labels, targets, names, id_col=id_col, text_col=text_col, keep=[id_col])
    tokens, p, rate, copies = names
    return rated.select(id_col, F.col(tokens).alias("n_tokens"), *[F.round(F.get(p, F.lit(k)), 6).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], F.col(rate).alias("rate"), F.col(copies).alias("copies"))
