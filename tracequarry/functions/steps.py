"""The trace language: documents, steps and directives as structs of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registers import SCRATCHPAD
from .text import FILLER_PHRASES, bound, found, stripped

#: Step kinds in the order in which they are tried, with the anchored pattern of each.
KINDS = (
    ("declaration", r"^let\s*\(\s*([a-zA-Z0-9_]+)\s*=\s*(.+?)\s*\)$"), ("hypothesis", r"^hyp\s*\(\s*(.+?)\s*\)$"), ("verify", r"^verify\s*\(\s*(.+?)\s*\)\s*([✓✗])?$"), ("state", r"^state\s*\((.*?)\)$"),
    ("checkpoint", r"^checkpoint\s*\(\s*(.+?)\s*\)$"), ("backtrack", r"^backtrack(?:\s*\(\s*(.+?)\s*\))?$"), ("replan", r"^replan\s*\(\s*(.+?)\s*\)$"),
)
PLAN_START = r"<reg:plan>|^plan\(|^concept:"


def step_kind(s: Column) -> Column:
    out = F.when(s.rlike(PLAN_START), "plan")
    for kind, pattern in KINDS:
        out = out.when(s.rlike(pattern), kind)
    return out.otherwise("transform")


def parse_step(s: Column) -> Column:
    """One typed step; every step has a kind, `transform` is what is left."""
    return bound(step_kind(s), lambda kind: _typed(s, kind))


def _typed(s: Column, kind: Column) -> Column:
    at = dict(KINDS)
    split = F.split(s, "→", 2)
    arrow = F.contains(s, F.lit("→"))
    rhs = F.when(arrow, stripped(F.get(split, F.lit(1)))).otherwise(s)
    return F.struct(
        kind.alias("kind"), s.alias("raw_text"), F.when(kind == "declaration", found(s, at["declaration"], 1)).alias("var_name"),
        F.when(kind == "declaration", found(s, at["declaration"], 2)).when(kind == "hypothesis", found(s, at["hypothesis"], 1)).alias("expression"),
        F.when(kind == "verify", found(s, at["verify"], 1)).alias("condition"), F.when(kind == "verify", F.regexp_extract(s, at["verify"], 2) != "✗").alias("passed"),
        F.when(kind == "checkpoint", found(s, at["checkpoint"], 1)).when(kind == "backtrack", found(s, at["backtrack"], 1)).alias("checkpoint_id"), F.when(kind == "replan", found(s, at["replan"], 1)).alias("strategy"),
        F.when(kind == "transform", stripped(F.get(split, F.lit(0)))).alias("lhs"), F.when(kind == "transform", rhs).alias("rhs"), F.when((kind == "transform") & arrow & F.contains(rhs, F.lit("=")), stripped(F.substring_index(rhs, "=", 1))).alias("target_var"),
    )


def trace_body(c: Column) -> Column:
    """The part of a completion that holds steps: scratchpad, else deduction, else thought, else all."""
    pad, deduce, think = (stripped(F.regexp_extract(c, p, g)) for p, g in ((SCRATCHPAD, 3), (r"(?s)<reg:deduce>(.*?)</reg:deduce>", 1), (r"(?s)<think>(.*?)</think>", 1)))
    return F.when(c.rlike(SCRATCHPAD), pad).when(c.rlike(r"(?s)<reg:deduce>.*?</reg:deduce>"), deduce).when(c.rlike(r"(?s)<think>.*?</think>"), think).otherwise(stripped(c))


def raw_steps(body: Column) -> Column:
    """Steps before the first therefore sign, split at bars, without empty ones."""
    return F.filter(F.transform(F.split(F.substring_index(body, "∴", 1), r"\|"), stripped), lambda s: s != "")


def conclusion(body: Column) -> Column:
    tail = stripped(F.get(F.split(body, "∴", 2), F.lit(1)))
    return F.coalesce(stripped(found(tail, r"ans\s*=\s*(.+)")), tail)


def explode_steps(traces: DataFrame, id_col: str = "trace_id", text_col: str = "completion") -> DataFrame:
    """A row for each step: (id, step_index, kind and the fields of that kind)."""
    rows = traces.select(id_col, F.posexplode(raw_steps(trace_body(F.col(text_col)))).alias("step_index", "_s"))
    return rows.select(id_col, "step_index", parse_step(F.col("_s")).alias("_p")).select(id_col, "step_index", "_p.*")


def plan_directive(body: Column) -> Column:
    """struct(concept, theorem, strategy, metadata) of a plan; of repeated keys the last wins."""
    parts = F.filter(F.transform(F.split(body, r"\|"), stripped), lambda p: F.contains(p, F.lit(":")) | F.contains(p, F.lit("=")))

    def pair(p: Column) -> Column:
        mark = F.when(F.contains(p, F.lit(":")), ":").otherwise("=")
        at = F.instr(p, F.lit(":"))
        at = F.when(at > 0, at).otherwise(F.instr(p, F.lit("=")))
        return F.struct(stripped(F.substring(p, F.lit(1), at - 1)).alias("k"), stripped(F.substring(p, at + 1, F.length(p))).alias("v"), mark.alias("mark"))

    pairs = F.transform(parts, pair)

    def last(*names: str) -> Column:
        own = F.filter(pairs, lambda x: (x["mark"] == ":") & F.lower(x["k"]).isin(*names))
        return F.get(F.reverse(F.transform(own, lambda x: x["v"])), F.lit(0))

    known = ("concept", "theorem", "identity", "recurrence", "formula", "strategy", "method")
    rest = F.filter(pairs, lambda x: (x["mark"] == "=") | ~F.lower(x["k"]).isin(*known))
    return F.struct(F.coalesce(F.nullif(last("concept"), F.lit("")), body).alias("concept"), last("theorem", "identity", "recurrence", "formula").alias("theorem"), last("strategy", "method").alias("strategy"), F.transform(rest, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))).alias("metadata"))


def intent_directive(body: Column) -> Column:
    parts = F.transform(F.split(body, r"\|"), stripped)
    last = lambda name: F.get(F.reverse(F.transform(F.filter(parts, lambda p: F.startswith(p, F.lit(name + ":"))), lambda p: stripped(F.replace(p, F.lit(name + ":"), F.lit(""))))), F.lit(0))
    return F.struct(F.coalesce(last("intent"), F.lit("")).alias("intent"), last("strategy").alias("strategy"), last("tone").alias("tone"))


def document(c: Column, body: Column | None = None) -> Column:
    """struct(register_type, is_valid, extracted, codes) of a whole completion, by the order of precedence of its parts.

    ``body`` is its ``trace_body`` where a column holds that already; it is used many times.
    """
    body = trace_body(c) if body is None else body
    return bound(F.struct(stripped(c).alias("c"), body.alias("body")), lambda x: _document(x["c"], x["body"]))


def _document(c: Column, body: Column) -> Column:
    """The document of a stripped completion; its kind and its conclusion are computed once, only what is asked for."""
    has = lambda tag: c.rlike(rf"(?s)<{tag}>.*?</{tag}>")
    unclosed = (F.contains(c, F.lit("<think>")) | F.contains(c, F.lit("</think>"))) & ~has("think")
    pad, plan = c.rlike(SCRATCHPAD), has("reg:plan")
    empty = (body == "") & ~plan & ~pad
    talk = F.contains(body, F.lit("intent:"))
    sign = F.contains(body, F.lit("∴"))
    lost = ~sign & (F.size(raw_steps(body)) == 0)
    kind = F.when(has("reg:bypass"), "bypass").when(has("reg:intent"), "intent").when(unclosed, "malformed").when(empty, "empty").when(talk, "intent").when(lost, "none").when(pad, "scratchpad").when(plan, "plan_deduce").when(has("reg:deduce"), "deduce").otherwise("trace")
    of_trace = lambda k: k.isin("none", "scratchpad", "plan_deduce", "deduce", "trace")
    answer = stripped(found(c, r"(?s)<ans>(.*?)</ans>"))

    def parts(k: Column) -> Column:
        return F.struct(k.alias("kind"), of_trace(k).alias("is_trace"), F.when(of_trace(k) & sign, conclusion(body)).alias("end"), answer.alias("answer"))

    def told(p: Column) -> Column:
        kind, is_trace, end, answer = p["kind"], p["is_trace"], p["end"], p["answer"]
        fillers = bound(F.lower(body), lambda low: F.array(*[F.when(F.contains(low, F.lit(x)), "E301") for x in FILLER_PHRASES]))
        codes = F.array_compact(F.concat(F.array(F.when(kind == "malformed", "E101"), F.when(is_trace & ~sign, "E102"), F.when(kind == "none", "E104"), F.when(is_trace & (kind != "none") & (end != answer), "E203")), F.when(is_trace, fillers).otherwise(F.array().cast("array<string>"))))
        bypass = stripped(F.regexp_extract(c, r"(?s)<reg:bypass>(.*?)</reg:bypass>", 1))
        return F.struct(kind.alias("register_type"), (~kind.isin("malformed", "none")).alias("is_valid"), F.when(kind == "bypass", bypass).when(is_trace, F.coalesce(end, answer)).otherwise(answer).alias("extracted"), codes.alias("codes"))

    return bound(bound(kind, parts), told)


def step_sentence(s: Column) -> Column:
    """A step in English; the first rule that fits."""
    let, hyp, check = r"^let\(([^=]+)=([^\)]+)\)", r"^hyp\(([^\)]+)\)", r"verify\(([^\)]+)\)✓"
    parts = F.split(s, "→")
    return (
        F.when(s == "", "").when(s.rlike(let), F.concat(F.lit("Initialize variable "), F.regexp_extract(s, let, 1), F.lit(" to "), F.regexp_extract(s, let, 2), F.lit(".")))
        .when(s.rlike(hyp), F.concat(F.lit("Given hypothesis: "), F.regexp_extract(s, hyp, 1), F.lit("."))).when(s.rlike(check), F.concat(F.lit("Verified that "), F.regexp_extract(s, check, 1), F.lit(" holds true.")))
        .when(F.contains(s, F.lit("→")), F.concat(F.lit("Compute "), stripped(F.get(parts, F.lit(0))), F.lit(", yielding "), stripped(F.get(parts, F.lit(1))), F.lit(".")))
        .when(F.contains(s, F.lit("∂")), F.concat(F.lit("Differentiate: "), s, F.lit("."))).when(F.contains(s, F.lit("∴")), F.concat(F.lit("Therefore, conclude "), stripped(F.replace(s, F.lit("∴"), F.lit(""))), F.lit(".")))
        .otherwise(F.concat(F.lit("Step: "), s, F.lit(".")))
    )


def decompress(c: Column) -> Column:
    """A whole trace as numbered English lines; empty steps keep their number but give no line."""
    steps = F.split(stripped(F.regexp_replace(c, "</?think>", "")), r"\|")
    lines = F.transform(steps, lambda s, i: F.struct((i + 1).cast("string").alias("n"), step_sentence(stripped(s)).alias("t")))
    return F.array_join(F.transform(F.filter(lines, lambda x: x["t"] != ""), lambda x: F.concat(x["n"], F.lit(". "), x["t"])), "\n")


def corrupt_last_equality(c: Column) -> Column:
    """The text with 7 added to the number behind its last equality sign; without one a false equality is appended."""
    last = r"(?s)^(.*=\s*)([0-9]+(?:\.[0-9]+)?)(.*)$"
    value = F.regexp_extract(c, last, 2)
    return F.when(~c.rlike(r"=\s*[0-9]"), F.concat(c, F.lit(" + 7 = 999"))).otherwise(
        F.concat(F.regexp_extract(c, last, 1), F.when(F.contains(value, F.lit(".")), F.format_string("%.2f", value.try_cast("double") + 7)).otherwise((value.try_cast("bigint") + 7).cast("string")), F.regexp_extract(c, last, 3))
    )


def step_counts(body: Column) -> Column:
    """struct(total, declarations, transformations, verifications, plans) of a trace's steps."""
    names = {"declarations": "declaration", "transformations": "transform", "verifications": "verify", "plans": "plan"}

    def counted(kinds: Column) -> Column:
        of = lambda kind: F.size(F.filter(kinds, lambda k: k == kind))
        return F.struct(F.size(kinds).alias("total"), *[of(kind).alias(name) for name, kind in names.items()])

    return bound(F.transform(raw_steps(body), step_kind), counted)


def concept_matches(expected: Column, found: Column) -> Column:
    """Whether either concept's name holds the other; no expectation matches nothing."""
    a, b = F.lower(expected), F.lower(found)
    return F.coalesce((a != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def declared_concept(c: Column, kind: Column) -> Column:
    """The concept of a completion's plan; null where its register keeps no plan."""
    plan = r"(?s)<reg:plan>(.*?)</reg:plan>"
    concept = plan_directive(stripped(F.regexp_extract(c, plan, 1)))["concept"]
    return F.when(c.rlike(plan) & ~kind.isin("bypass", "intent", "malformed"), concept)
