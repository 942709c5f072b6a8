"""Register tags of a completion: parsing, flags, depth and verification signal as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found, stripped, word_count

SCRATCHPAD = r'(?s)<reg:scratchpad(?:\s+depth="(\d+)")?(?:\s+domain="([^"]+)")?>(.*?)</reg:scratchpad>'
#: Answer tags in the order in which their tails are looked for.
CLOSING_TAGS = ("</ans>", "</reg:scratchpad>", "</reg:deduce>", "</reg:bypass>", "</reg:intent>", "</think>")
STRUCTURE = r"(?s)^\s*<think>\s*(<reg:bypass>.*?</reg:bypass>|<reg:plan>.*?</reg:plan>\s*<reg:deduce>.*?</reg:deduce>\s*(<reg:verify>.*?</reg:verify>)?)\s*</think>\s*<ans>.*?</ans>\s*$"


def register(c: Column, name: str) -> Column:
    return F.nullif(stripped(F.regexp_extract(c, rf"(?s)<reg:{name}>(.*?)</reg:{name}>", 1)), F.lit(""))


def parse_registers(c: Column) -> Column:
    """struct of all registers, the dominant one, answer, depth, checkpoints, steps, backtracks and word count.

    An empty register counts as absent.
    """
    c = stripped(c)
    body = {n: register(c, n) for n in ("plan", "deduce", "verify", "bypass", "intent")}
    pad = F.nullif(stripped(F.regexp_extract(c, SCRATCHPAD, 3)), F.lit(""))
    steps = F.filter(F.transform(F.split(F.coalesce(pad, F.lit("")), r"\|"), stripped), lambda p: p != "")
    is_point = lambda p: F.startswith(p, F.lit("checkpoint("))
    points = F.transform(F.filter(steps, lambda p: p.rlike(r"^checkpoint\(.*?\)")), lambda p: stripped(F.regexp_extract(p, r"^checkpoint\((.*?)\)", 1)))
    back = F.size(F.filter(steps, lambda p: ~is_point(p) & (F.startswith(p, F.lit("backtrack")) | F.contains(p, F.lit("✗")))))
    dominant = F.when(pad.isNotNull(), "scratchpad").when(body["bypass"].isNotNull(), "bypass").when(body["intent"].isNotNull() & body["deduce"].isNull(), "intent").when(F.coalesce(body["plan"], body["deduce"], body["verify"]).isNotNull(), "deduce").otherwise("standard")
    tagged = r"(?s)<ans>(.*?)</ans>"
    answer = F.coalesce(F.nullif(stripped(F.when(c.rlike(tagged), F.regexp_extract(c, tagged, 1)).otherwise(F.regexp_extract(c, r"(?s)\\boxed\{(.*?)\}", 1))), F.lit("")), body["bypass"])
    depth = F.when(c.rlike(SCRATCHPAD), F.coalesce(found(c, SCRATCHPAD, 1), F.lit("1")))
    valid = F.coalesce(pad, body["deduce"], body["bypass"], answer).isNotNull()
    return F.struct(
        dominant.alias("register_type"), body["plan"].alias("plan"), body["deduce"].alias("deduction"), body["verify"].alias("verification"), pad.alias("scratchpad"), body["bypass"].alias("bypass"), body["intent"].alias("intent"),
        answer.alias("answer"), depth.alias("depth"), back.alias("backtracks"), points.alias("checkpoints"), steps.alias("unit_steps"), word_count(c).alias("token_count"), valid.alias("ast_valid"), (word_count(c) < 50).alias("is_compact"),
    )


def presence(c: Column) -> Column:
    return F.struct(*[F.contains(c, F.lit(f"<reg:{n}>")).alias(n) for n in ("plan", "deduce", "verify", "bypass", "intent")])


def follows_structure(c: Column) -> Column:
    return c.rlike(STRUCTURE)


def cognitive_depth(c: Column, default: str = "Δ1") -> Column:
    given = F.replace(F.regexp_extract(c, "(?i)depth=[\"']?([0-5]|Δ[0-5])", 1), F.lit("Δ"), F.lit(""))
    has = lambda *marks: F.expr("false") if not marks else _any(c, marks)
    return (
        F.when(given != "", F.concat(F.lit("Δ"), given)).when(has("<reg:bypass>"), "Δ0").when(has("backtrack", "checkpoint("), "Δ5").when(has("replan("), "Δ4")
        .when(has("hyp [", "<reg:verify>"), "Δ2").when(has("<reg:plan>", "<reg:deduce>", "<reg:intent>"), "Δ1").otherwise(default)
    )


def _any(c: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(c, F.lit(m))
    return out


def verification_signal(c: Column) -> Column:
    return F.when(c.rlike(r"✗|FAIL|(?i:invalid)"), "rejected").when(c.rlike("✓|PASS"), "accepted").otherwise("indeterminate")


def verify_pairs(c: Column) -> Column:
    """Conditions and marks (null where missing) of all verify(...) calls."""
    pattern = F.lit(r"verify\((.*?)\)\s*([✓✗])?")
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("condition"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("mark"))
    return F.transform(pairs, lambda p: F.struct(stripped(p["condition"]).alias("condition"), F.nullif(p["mark"], F.lit("")).alias("mark")))


def answer_tail(c: Column, tags=CLOSING_TAGS) -> Column:
    """What follows the last closing tag of the first kind present; empty without any."""
    out = None
    for t in tags:
        value = stripped(F.substring_index(c, t, -1))
        out = F.when(F.contains(c, F.lit(t)), value) if out is None else out.when(F.contains(c, F.lit(t)), value)
    return out.otherwise("")


def assistant_text(messages: Column) -> Column:
    return F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "assistant"), lambda m: m["content"]), " ")
