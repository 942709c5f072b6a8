"""Markdown reports: small aggregates rendered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, receipts, rollups, stats, summaries


def markdown_table(df: DataFrame, limit: int = 500) -> str:
    """Rows of an aggregate as a table; aggregates here have a row per arm, budget or category."""
    rows = df.limit(limit).collect()
    show = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def evaluation_report(rows: DataFrame, base: str = "A", arm: str = "C", control: str = "D") -> str:
    """Grid, overthinking, effects, categories, contamination and decision of one set of receipts."""
    parts = [
        ("Arms by budget", metrics.cell_summary(rows).orderBy("arm", "budget")),
        ("Overthinking", metrics.overthinking(rows).orderBy("arm", "budget")),
        ("Budget choke", metrics.budget_choke_factor(rows).orderBy("arm")),
        (f"Effect size {arm} against {base}", stats.cohen_d(rows, arm, base).orderBy("budget")),
        (f"P({arm} below {base})", stats.common_language(rows, arm, base).orderBy("budget")),
        ("Categories", metrics.category_accuracy(rows).orderBy("budget", "category", "arm")),
        ("Contamination", metrics.contamination_gap(rows).orderBy("arm", "budget")),
        (f"Saved energy of {arm} against {control}", stats.paired_bootstrap(rows, arm, control).orderBy("budget")),
        (f"Decision {arm} against {control}", stats.decision(rows, arm, control).orderBy("budget")),
    ]
    if "verification_method" in rows.columns:  # answers that only the symbolic layer accepted
        parts.insert(1, ("All and clean receipts", rollups.slices(rows).orderBy("scope", F.asc_nulls_first("arm"), F.asc_nulls_first("budget"))))
    return "# Evaluation\n\n" + "\n\n".join(f"## {title}\n\n{markdown_table(df)}" for title, df in parts) + "\n"


def rescoring_report(traces: DataFrame, limit: int = 512) -> str:
    scored = receipts.rescored(traces, limit).cache()
    try:
        return "# Rescoring\n\n" + "\n\n".join(f"## By {k}\n\n{markdown_table(receipts.transitions(scored, k).orderBy(k))}" for k in ("method", "category")) + "\n"
    finally:
        scored.unpersist()


def efficiency_report(rows: DataFrame) -> str:
    return f"# Efficiency\n\n{markdown_table(metrics.information_efficiency(rows).orderBy('budget', 'arm'))}\n\n{markdown_table(metrics.ock_score(rows).orderBy('arm'))}\n"


def _sections(title: str, parts) -> str:
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n\n{text}" for name, text in parts) + "\n"


def latex_table(df: DataFrame, caption: str, limit: int = 500) -> str:
    """An aggregate as a LaTeX table."""
    safe = lambda v: ("-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)).replace("_", r"\_").replace("%", r"\%")
    line = lambda cells: " & ".join(safe(c) for c in cells) + r" \\"
    rows = [line(r) for r in df.limit(limit).collect()]
    return "\n".join([r"\begin{table}[h]", r"\centering", rf"\caption{{{caption}}}", r"\begin{tabular}{l" + "c" * (len(df.columns) - 1) + "}", r"\hline", line(df.columns), r"\hline", *rows, r"\hline", r"\end{tabular}", r"\end{table}"])


def valuation_report(rows: DataFrame, arm: str = "C", control: str = "D", reps: int = 10_000) -> str:
    """Energy and latency by arm, the same by budget, and the test of an arm against its control."""
    return _sections("Valuation", [
        ("Arms", markdown_table(summaries.valuation(rows).orderBy("arm"))),
        ("Arms by budget", markdown_table(summaries.valuation(rows, ("budget", "arm")).orderBy("budget", "arm"))),
        (f"Test of {arm} against {control}", markdown_table(stats.decision_with_interval(rows, arm, control, reps=reps).orderBy("budget"))),
    ])


def ablation_report(rows: DataFrame, base: str = "A", arm: str = "C", control: str = "D") -> str:
    """Accuracy with intervals, compression against the base arm, and what the control changes."""
    return _sections("Ablation", [
        ("Arms", markdown_table(summaries.ablation(rows, base).orderBy("arm"))),
        (f"Change from {control} to {arm}", markdown_table(stats.decision(rows, arm, control).orderBy("budget"))),
    ])


def comparison_report(rows: DataFrame, base: str = "A") -> str:
    """Arms side by side at each budget, with the same as a LaTeX table."""
    shown = metrics.information_efficiency(rows, base).orderBy("budget", "arm")
    brief = shown.select("budget", "arm", "pass_at_1", (shown["tokens"] / shown["n"]).alias("mean_tokens"), "per_hundred", "traffic")
    return _sections("Comparison", [("Arms", markdown_table(shown)), ("LaTeX", f"```latex\n{latex_table(brief, 'Arms by budget')}\n```")])


def proxy_report(rows: DataFrame) -> str:
    """The grid with stand-in metrics, and joules per correct answer with a column for each budget beside the choke factor."""
    grid = rollups.proxy_grid(rows)
    budgets = sorted(r["budget"] for r in grid.select("budget").distinct().collect())
    energy = grid.groupBy("arm").pivot("budget", budgets).agg(F.first("joules_per_correct")).join(metrics.budget_choke_factor(rows).select("arm", "choke_factor"), "arm")
    return f"# Grid\n\n{markdown_table(grid.orderBy('arm', 'budget'))}\n\n## Joules per correct answer\n\n{markdown_table(energy.orderBy('arm'))}\n"


def yearly_summary(items: DataFrame, fallbacks: dict[int, dict[str, float]] | None = None) -> str:
    """Accuracy and tokens of graded items by year; a year without items shows the figures given for it, marked as given."""
    measured = {r["year"]: r for r in items.where("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("n"), (F.count_if("is_correct") * 100.0 / F.count(F.lit(1))).alias("accuracy"), F.avg("tokens_emitted").alias("mean_tokens")).collect()}
    lines = ["| year | n | accuracy | mean tokens | |", "|---|---|---|---|---|"]
    for year in sorted({*measured, *(fallbacks or {})}):
        r = measured.get(year)
        own = (r["n"], r["accuracy"], r["mean_tokens"], "measured") if r else (0, fallbacks[year]["accuracy"], fallbacks[year]["mean_tokens"], "given")
        lines.append(f"| {year} | {own[0]} | {own[1]:.1f} | {own[2]:.1f} | {own[3]} |")
    return "\n".join(lines) + "\n"


def domain_summary(items: DataFrame, routes: dict[str, str]) -> str:
    """Accuracy, tokens and route of graded items by category; a category without a route is marked so."""
    cells = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"), (F.count_if("is_correct") * 100.0 / F.count(F.lit(1))).alias("accuracy"), F.avg("tokens_emitted").alias("mean_tokens"))
    table = F.create_map(*[F.lit(x) for k, v in routes.items() for x in (k, v)]) if routes else F.create_map().cast("map<string,string>")
    return markdown_table(cells.withColumn("route", F.coalesce(F.try_element_at(table, F.col("category")), F.lit("none"))).orderBy("category")) + "\n"
