"""Reward functions of completions as column expressions; constants are parameters with their usual values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import registers as R
from ..functions import steps as S
from ..functions import text as T

#: Scale, free and hard length and slope of each depth.
DEPTH_SCALE = {"Δ0": 15.0, "Δ1": 35.0, "Δ2": 65.0, "Δ3": 110.0, "Δ4": 180.0, "Δ5": 300.0}
DEPTH_LIMITS = {"Δ0": (10, 15, 0.08), "Δ1": (30, 45, 0.04), "Δ2": (55, 80, 0.03), "Δ3": (90, 150, 0.02), "Δ4": (160, 250, 0.015), "Δ5": (260, 450, 0.01)}


def is_correct(c: Column, truth: Column) -> Column:
    return T.bound(A.grammar(c), lambda answer: A.answers_match(answer, truth))


def waste(c: Column) -> Column:
    """Penalty for loops and web residue."""
    return F.when(T.repeats(c), 2.5).otherwise(0.0) + F.when(T.web_debris(c), 2.0).otherwise(0.0)


def by_depth(depth: Column, values: dict, part: int | None = None) -> Column:
    pick = lambda v: float(v if part is None else v[part])
    table = F.create_map(*[F.lit(x) for d, v in values.items() for x in (d, pick(v))])
    return F.coalesce(F.try_element_at(table, depth), F.lit(pick(values["Δ1"])))


def closure(c: Column, long: int, bonus: float, malus: float, tags=R.CLOSING_TAGS) -> Column:
    return T.bound(T.word_count(R.answer_tail(c, tags)), lambda tail: F.when(tail <= 4, bonus).when(tail > long, malus).otherwise(0.0))


def measured(c: Column, truth: Column, body) -> Column:
    """``body(tokens, waste, right)``; each measure reads the completion once."""
    measures = F.struct(T.token_estimate(c).cast("double").alias("tokens"), waste(c).alias("waste"), is_correct(c, truth).alias("right"))
    return T.bound(measures, lambda m: body(m["tokens"], m["waste"], m["right"]))


def parsimony(c: Column, truth: Column, depth: Column | None = None, base: float = 2.5, scale: float = 35.0, floor: float = 0.4, friction: float = 0.001) -> Column:
    """Falls smoothly with length and never below the floor; a wrong answer is -1 less waste."""
    k = F.lit(scale) if depth is None else by_depth(depth, DEPTH_SCALE)

    def value(tokens: Column, omega: Column, right: Column) -> Column:
        smooth = base * (floor + (1 - floor) * (k / (k + F.greatest(F.lit(1.0), tokens)))) - friction * tokens - omega
        return F.when(right, smooth + F.when(omega == 0, closure(c, 25, 0.5, -0.5)).otherwise(0.0)).otherwise(-1.0 - omega)

    return measured(c, truth, value)


def parsimony_scalar(tokens: Column, correct: Column, depth: Column, closed: Column, base: float = 2.5, floor: float = 0.4, friction: float = 0.001) -> Column:
    k = by_depth(depth, DEPTH_SCALE)
    return F.when(correct, base * (floor + (1 - floor) * (k / (k + F.greatest(F.lit(1.0), tokens.cast("double"))))) - friction * tokens + F.when(closed, 0.5).otherwise(0.0)).otherwise(-1.0)


def gradient(c: Column, truth: Column, depth: Column | None = None) -> Column:
    """Economy below the free length, a linear penalty above the hard one, by depth."""
    depth = R.cognitive_depth(c) if depth is None else depth

    def value(tokens: Column, omega: Column, right: Column) -> Column:
        def of(limits: Column) -> Column:
            economy = F.when(right, 2.0 * (1.0 + 0.5 * F.greatest(F.lit(0.0), (limits["free"] - tokens) / limits["free"]))).otherwise(-0.8)
            return economy - F.greatest(F.lit(0.0), tokens - limits["hard"]) * limits["slope"] - omega + F.when(right & (omega == 0), closure(c, 25, 0.5, -0.5)).otherwise(0.0)

        return T.bound(depth, lambda d: T.bound(F.struct(*[by_depth(d, DEPTH_LIMITS, i).alias(name) for i, name in enumerate(("free", "hard", "slope"))]), of))

    return measured(c, truth, value)


def stage4(c: Column, truth: Column, register: Column) -> Column:
    """Token economy and a clean end, with a target length by register."""
    target = F.when(register.isin("factual_bypass", "bypass"), 15.0).when(register.isin("intent_dialogue", "intent"), 75.0).otherwise(50.0)
    tags = ("</ans>", "</reg:deduce>", "</reg:bypass>", "</reg:intent>", "</think>")

    def value(tokens: Column, omega: Column, right: Column) -> Column:
        good = right & (omega == 0)
        length = F.when(tokens > target, -F.least(F.lit(1.5), 0.03 * (tokens - target))).when(good, 0.5 * F.greatest(F.lit(0.0), (target - tokens) / target)).otherwise(0.0)
        return F.when(good, closure(c, 20, 1.2, -1.0, tags)).otherwise(0.0) - omega + length

    return measured(c, truth, value)


def correctness(c: Column, truth: Column) -> Column:
    return F.when(is_correct(c, truth), 1.0).otherwise(-0.6)


def efficiency_and_bypass(c: Column, truth: Column, register: Column) -> Column:
    return T.bound(is_correct(c, truth), lambda right: by_register(c, right, register))


def by_register(c: Column, right: Column, register: Column) -> Column:
    tag = F.contains(c, F.lit("<reg:bypass>"))
    closed = c.rlike(r"(?s)<reg:bypass>.*?</reg:bypass>")
    thought = F.length(T.stripped(F.regexp_extract(c, r"(?s)<think>(.*?)</think>", 1)))
    fact = F.when(closed | (thought == 0), F.when(right, 0.9).otherwise(-0.3)).when(thought < 20, F.when(right, 0.2).otherwise(-0.2)).otherwise(-0.8)
    talk = F.when(c.rlike(r"(?:<reg:intent>|intent:)\s*[^|\n<]+"), 0.6).otherwise(-0.3)
    saved = F.greatest(F.lit(0.0), F.least(F.lit(0.6), (60 - T.token_estimate(c)) / 60.0))
    proof = F.when(tag | ((thought == 0) & ~right), -0.8).when(~right, 0.0).otherwise(saved * 0.5 + F.when(F.contains(c, F.lit("<reg:plan>")), 0.25).otherwise(0.0))
    return F.when(register.isin("factual_bypass", "bypass"), fact).when(register.isin("intent_dialogue", "intent"), talk).otherwise(proof)


def form_and_noise(c: Column, valid: Column) -> Column:
    """Trailing noise, a valid document (``valid`` as parsed), a conclusion and few fillers."""
    concluded = F.contains(c, F.lit("∴")) | F.contains(c, F.lit("<ans>"))
    return T.trailing_noise(c) + F.when(valid, 0.5).otherwise(-0.3) + F.when(concluded, 0.2).otherwise(0.0) - F.when(T.filler_score(c) > 0.25, 0.3).otherwise(0.0)


def concept_alignment(concept: Column, expected: Column) -> Column:
    """A declared concept, more so the expected one."""
    return T.bound(concept, lambda own: F.when(own.isNull(), 0.0).otherwise(F.lit(0.3) + F.when(S.concept_matches(expected, own), 0.2).otherwise(0.0)))
