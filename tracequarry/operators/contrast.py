"""Contrastive traces: a plausible first guess that fails its check, the way back, and the right deduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import found

#: A guess, the check it fails, and why, for concepts whose guess does not depend on the prompt; the last is for all others.
GUESSES = {
    "linear_algebra": ("drop the constant term", "both sides are equal", "the constant is not zero"),
    "physics": ("speed stays as it was", "the acceleration is used", "the acceleration is not zero"),
    "combinatorics": ("count ordered picks", "order makes no difference", "each pick is counted more than once"),
    "sequences": ("terms differ by 1", "the given terms follow", "the step is another one"),
    "word_problems": ("add the rates", "each rate applies to what is left", "the base has changed"),
    "modular_power": ("use the exponent unreduced by the cycle", "the cycle divides what was dropped", "the cycle is another one"),
    "counting": ("count all arrangements", "the restriction holds", "some arrangements break it"),
    "inradius": ("halve the product of perimeter and radius twice", "area = radius * half the perimeter", "halved once too often"),
    "squares_and_rates": ("take every divisor, or add the hours", "parity and rates agree", "the condition was left out"),
    "": ("first idea", "the conditions hold", "one of them does not"),
}


def _square(prompt: Column) -> tuple[Column, Column, Column]:
    """x^2 + 1/x^2 guessed as the square of x + 1/x; 6 where the prompt names no value."""
    u = F.coalesce(found(prompt, r"x \+ 1/x = (\d+)").try_cast("bigint"), F.lit(6).cast("bigint"))
    wrong = (u * u).cast("string")
    return F.concat(F.lit("x^2 + 1/x^2 = "), wrong), F.concat(wrong, F.lit(" == "), u.cast("string"), F.lit("^2 - 2")), F.lit("the cross term 2 is missing")


def _congruence(prompt: Column) -> tuple[Column, Column, Column]:
    """The first remainder and modulus added up, and the modulus once more if that happens to be right."""
    pair = r"(\d+)\s*\(?mod (\d+)"
    of = lambda group, k: F.try_element_at(F.regexp_extract_all(prompt, F.lit(pair), F.lit(group)), F.lit(k)).try_cast("bigint")
    r, m, s, n = of(1, 1), of(2, 1), of(1, 2), of(2, 2)
    first = r + m
    guess = F.when(F.try_mod(first, n) == s, first + m).otherwise(first)
    text = lambda c: c.cast("string")
    known = guess.isNotNull() & F.try_mod(guess, n).isNotNull()
    return (
        F.when(known, F.concat(F.lit("n = "), text(guess))).otherwise("add the remainders"),
        F.when(known, F.concat(text(guess), F.lit(" % "), text(n), F.lit(" == "), text(s))).otherwise("every congruence holds"),
        F.when(known, F.concat(text(F.try_mod(guess, n)), F.lit(" is not "), text(s))).otherwise("one of them does not"),
    )


def _valuation(prompt: Column) -> tuple[Column, Column, Column]:
    """Only the first term of the sum."""
    n = found(prompt, r"(\d+)!").try_cast("bigint")
    p = F.coalesce(found(prompt, r"prime (\d+)"), found(prompt, r"(\d+) (?:that divides|divide|in) \d+!")).try_cast("bigint")
    term = F.call_function("div", n, F.nullif(p, F.lit(0).cast("bigint")))
    hypothesis = F.concat(F.lit("v = "), n.cast("string"), F.lit(" // "), p.cast("string"), F.lit(" = "), term.cast("string"))
    return F.coalesce(hypothesis, F.lit("v is the first term")), F.lit("all powers are counted"), F.coalesce(F.concat(F.lit("powers of "), p.cast("string"), F.lit(" from the second on are missing")), F.lit("higher powers are missing"))


READ_FROM_PROMPT = {"polynomial_invariant": _square, "chinese_remainder": _congruence, "legendre_valuation": _valuation}


def failed_guess(concept: Column, prompt: Column) -> Column:
    """struct(hypothesis, condition, reason) for a concept."""
    names = ("hypothesis", "condition", "reason")
    shaped = lambda parts: F.struct(*[(F.lit(p) if isinstance(p, str) else p).alias(n) for n, p in zip(names, parts)])
    made = {k: read(prompt) for k, read in READ_FROM_PROMPT.items()} | {k: v for k, v in GUESSES.items() if k}
    out = F.when(F.lit(False), shaped(GUESSES[""]))
    for name, parts in made.items():
        out = out.when(concept == name, shaped(parts))
    return out.otherwise(shaped(GUESSES[""]))


def contrastive(samples: DataFrame, exempt=("factual_bypass", "intent_dialogue"), place: str = "place") -> DataFrame:
    """Every third row by ``place``, outside the exempt concepts, begins with a guess that fails; others stay.

    Expects ``concept``, ``prompt``, ``canonical_deduce``, ``ground_truth`` and ``full_target``.
    """
    chosen = F.coalesce((F.col(place) % 3 == 0) & ~F.col("concept").isin(*exempt) & F.contains(F.col("full_target"), F.lit("<think>")), F.lit(False))
    g = F.col("_guess")
    plan = F.coalesce(F.concat(found(F.col("full_target"), r"(?s)(<reg:plan>.*?</reg:plan>)"), F.lit("\n")), F.lit(""))
    truth = F.coalesce("ground_truth", F.lit(""))
    text = F.concat(
        F.lit("<think>\n"), plan, F.lit("<checkpoint:CP1>\n<reg:deduce>hyp ["), g["hypothesis"], F.lit("]</reg:deduce>\n<reg:verify>verify("), g["condition"], F.lit(")✗ ["), g["reason"],
        F.lit("]</reg:verify>\n<backtrack:CP1>\n<reg:deduce>replan: "), F.coalesce("canonical_deduce", F.lit("")), F.lit("</reg:deduce>\n<reg:verify>verify(ans == "), truth, F.lit(")✓</reg:verify>\n</think>\n<ans>"), truth, F.lit("</ans>"),
    )
    rows = samples.withColumn("is_contrastive_negative", chosen).withColumn("_guess", F.when(chosen, failed_guess(F.col("concept"), F.col("prompt"))))
    return rows.withColumn("full_target", F.when(chosen, text).otherwise(F.col("full_target"))).drop("_guess")
