"""Execution of traces over tables: scratchpads, audits and invariants, rewards and symbolic equality.

What is sequential within a trace (``scratchpad``, ``deduction``) runs per row in Arrow batches, for rows that have such
a part at all; the rest are expressions.  A failing step is a diagnostic, never an exception.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import registers as R
from ..functions import steps as S
from ..functions import text as T
from .deduction import audit, engine_report, invariants, self_correction
from .evaluator import Refused, Unknown, evaluate
from .scratchpad import Scratchpad, render, unit_step

__all__ = ["Scratchpad", "audit", "composite_reward", "invariant_rows", "invariants", "scratchpad_steps", "scratchpad_summary", "self_correction", "terminal_audit", "unit_step", "verify_symbolic"]


# -- over tables ----------------------------------------------------------------------------------------------
PAD = re.compile(r'<reg:scratchpad(?:\s+depth="(\d+)")?(?:\s+domain="([^"]+)")?>(.*?)</reg:scratchpad>', re.DOTALL)
DEDUCE = re.compile(r"<reg:deduce>(.*?)</reg:deduce>", re.DOTALL)


def _rows(df: DataFrame, id_col: str, text_col: str, make, fields: str) -> DataFrame:
    """One pass in Arrow batches; ``make(text)`` gives the rows of a trace."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col] + [f.strip().split(" ")[0] for f in fields.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [{id_col: i, **r} for i, t in zip(rows[id_col], rows[text_col]) for r in make(t or "")]
            yield pd.DataFrame(out, columns=names)

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, {fields}")


PAD_FIELDS = "step_index int, raw_text string, step_type string, expression string, value string, passed boolean, checkpoint_id string"
SUMMARY_FIELDS = "depth string, domain string, n_steps int, answer string, failures int, cycle boolean, is_valid boolean, n_diagnostics int, env string, rendered string"


def _with(traces: DataFrame, text_col: str, tag: str) -> DataFrame:
    """Only rows that can hold the part, so others never reach a Python worker."""
    return traces.where(F.contains(F.col(text_col), F.lit(f"</reg:{tag}>")))


def scratchpad_steps(traces: DataFrame, id_col: str = "trace_id", text_col: str = "completion") -> DataFrame:
    """A row for each executed step of each scratchpad."""
    make = lambda t: (row for m in [PAD.search(t)] if m for _, row in Scratchpad().rows(m[3]))
    return _rows(_with(traces, text_col, "scratchpad"), id_col, text_col, make, PAD_FIELDS)


def scratchpad_summary(traces: DataFrame, id_col: str = "trace_id", text_col: str = "completion") -> DataFrame:
    """How each scratchpad ends, with its canonical form."""

    def make(t: str):
        if m := PAD.search(t):
            depth, domain = m[1] or "1", m[2] or "general"
            end, said = Scratchpad(), []
            for end, row in end.rows(m[3]):
                said.append(row["raw_text"])
            env = str(sorted((k, str(v)) for k, v in end.env.items()))
            yield {"depth": depth, "domain": domain, "n_steps": end.n_steps, "answer": end.answer, "failures": end.failures, "cycle": end.cycle, "is_valid": end.valid, "n_diagnostics": len(end.diagnostics), "env": env, "rendered": render(depth, domain, said, end.answer)}

    return _rows(_with(traces, text_col, "scratchpad"), id_col, text_col, make, SUMMARY_FIELDS)


def terminal_audit(traces: DataFrame, id_col: str = "trace_id", text_col: str = "completion") -> DataFrame:
    """The audit of each deduction, the engine's end state and, behind a contradiction, the prompt to resume from."""

    def make(t: str):
        if m := DEDUCE.search(t):
            plan = re.search(r"(?s)<reg:plan>(.*?)</reg:plan>", t)
            found = audit(m[1])
            yield found | engine_report(found, plan[1].strip() if plan else None, "<reg:bypass>" in t)

    return _rows(_with(traces, text_col, "deduce"), id_col, text_col, make, "is_valid boolean, certified_answer string, n_steps int, error_context string, state string, rollbacks int, recovery_prompt string")


def invariant_rows(traces: DataFrame, id_col: str = "trace_id", steps_col: str = "steps") -> DataFrame:
    """(id, n_steps, codes) from steps parsed to JSON."""
    make = lambda t: [{"n_steps": len(s := json.loads(t) if t else []), "codes": ",".join(invariants(s))}]
    return _rows(traces, id_col, steps_col, make, "n_steps int, codes string")


#: Weights of the composite reward's terms.
WEIGHTS = {"correctness": 1.0, "efficiency": 0.4, "format": 0.2, "invariant": 0.3, "concept": 0.4, "length": 0.001, "leak": 0.3}
BASELINE_TOKENS = 55


def composite_reward(traces: DataFrame, id_col: str = "trace_id", text_col: str = "completion", truth_col: str = "ground_truth", multi_step: bool = True, concept_col: str | None = None) -> DataFrame:
    """(id, total and the ten terms).  All terms are expressions but the two that execute the trace.

    With ``concept_col``, a plan that names the expected concept is worth more.
    """
    c = F.col(text_col)
    think = r"(?s)<think>(.*?)</think>"
    expected = F.col(concept_col) if concept_col else F.lit(None).cast("string")
    rows = traces.withColumn("_body", S.trace_body(c)).select(id_col, c, expected.alias("_expected"), "_body", F.when(c.rlike(think), T.stripped(F.regexp_extract(c, think, 1))).otherwise(T.stripped(c)).alias("_trace"), A.answers_match(A.grammar(c), F.col(truth_col)).alias("_ok"), S.document(c, F.col("_body")).alias("_doc"), F.to_json(F.transform(S.raw_steps(F.col("_body")), S.parse_step)).alias("_steps"))
    kind = traces.schema[id_col].dataType.simpleString()

    def executed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["_corrected"] = [self_correction(t or "", bool(ok)) for t, ok in zip(part[text_col], part["_ok"])]
            part["_broken"] = [bool(invariants(json.loads(s) if s else [])) for s in part["_steps"]]
            yield part[[id_col, text_col, "_trace", "_ok", "_kind", "_valid", "_n", "_match", "_corrected", "_broken"]]

    flat = rows.select(id_col, text_col, "_trace", "_ok", F.col("_doc.register_type").alias("_kind"), F.col("_doc.is_valid").alias("_valid"), F.size(S.raw_steps(F.col("_body"))).alias("_n"), S.concept_matches(F.col("_expected"), S.declared_concept(c, F.col("_doc.register_type"))).alias("_match"), "_steps")
    done = flat.mapInPandas(executed, f"{id_col} {kind}, {text_col} string, _trace string, _ok boolean, _kind string, _valid boolean, _n int, _match boolean, _corrected double, _broken boolean")
    done, tokens = done.withColumn("_tokens", T.token_estimate(F.col("_trace"))), F.col("_tokens")
    plan = F.contains(c, F.lit("<reg:plan>")) & ~F.col("_kind").isin("bypass", "intent")
    has_tree = ~F.col("_kind").isin("bypass", "malformed", "none", "empty")
    terms = {
        "correctness": F.when(F.col("_ok"), 1.0).otherwise(-0.5) * WEIGHTS["correctness"],
        "efficiency": F.when(F.col("_ok"), F.greatest(F.lit(0.0), F.least(F.lit(0.5), 1.0 - tokens / float(BASELINE_TOKENS)))).otherwise(0.0) * WEIGHTS["efficiency"],
        "format": F.when(F.col("_valid"), 0.2).otherwise(-0.15) * WEIGHTS["format"],
        "invariant": F.when(~has_tree, 0.0).when(F.col("_broken"), -0.3).otherwise(0.3) * WEIGHTS["invariant"],
        "concept": (F.when(plan, 0.25).otherwise(0.0) + F.when(plan & F.col("_match"), 0.2).otherwise(0.0)) * WEIGHTS["concept"],
        "anti_guess": F.when(F.lit(multi_step) & (((tokens <= 5) & ~plan & (F.col("_n") <= 1)) | F.contains(c, F.lit("<reg:bypass>"))), -0.8).otherwise(0.0),
        "length": tokens * -WEIGHTS["length"],
        "leak": T.filler_score(F.col("_trace")) * -WEIGHTS["leak"],
        "noise": T.trailing_noise(c),
        "self_correction": F.col("_corrected"),
    }
    out = done.select(id_col, *[v.alias(k) for k, v in terms.items()])
    return out.withColumn("total", sum((F.col(k) for k in list(terms)[1:]), F.col("correctness")))


def verify_symbolic(answers: DataFrame, id_col: str = "trace_id", answer_col: str = "answer", truth_col: str = "ground_truth") -> DataFrame:
    """(id, method): the expression layer first; only what it fails is compared as polynomials."""
    rows = answers.select(id_col, A.verify_method(F.col(answer_col), F.col(truth_col)).alias("method"), A.clean_math(F.lower(F.col(answer_col))).alias("a"), A.clean_math(F.lower(F.col(truth_col))).alias("b"))
    kind = answers.schema[id_col].dataType.simpleString()

    def equal(a: str, b: str) -> bool:
        try:
            x, y = (evaluate(t.replace("^", "**")) for t in (a, b))
            return not isinstance(x, bool) and not isinstance(y, bool) and x == y
        except (Refused, Unknown):
            return False

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["method"] = [m if m != "fail" or not a or not b or not equal(a, b) else "symbolic" for m, a, b in zip(part["method"], part["a"], part["b"])]
            yield part[[id_col, "method"]]

    return rows.mapInPandas(compared, f"{id_col} {kind}, method string")
