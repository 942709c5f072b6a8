"""Prompts of evaluation arms from templates, with a looked-up prefix where an arm starts from a given plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def choose_arms(arms: list[str], wanted: list[str]) -> list[str]:
    """Arms whose name holds one of the wanted words; no words choose all."""
    return [a for a in arms if not wanted or any(w.lower() in a.lower() for w in wanted)]


def prompt_for(arm: Column, prompt: Column, templates: dict[str, str]) -> Column:
    """The arm's template with ``{prompt}`` filled in; an arm without one gets the bare prompt."""
    table = F.create_map(*[F.lit(x) for k, v in templates.items() for x in (k, v)])
    return F.coalesce(F.replace(F.try_element_at(table, arm), F.lit("{prompt}"), prompt), prompt)


def plan_prefix(category: Column, plans: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in plans.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, category), F.lit(default))


def is_atomic(category: Column) -> Column:
    return category == "atomic_scientific_fact"


def valuation_prompt(arm: Column, prompt: Column, category: Column, templates: dict[str, str]) -> Column:
    """struct(template, prompt, bypass) of a valuation arm.

    ``templates`` has ``plain``, ``answer_only``, ``registers``, ``bypass`` and ``sandbox``.  Arms are told by the letter behind ``Arm``.  The router arm D takes the
    bypass template for atomic facts and the plain one otherwise; C keeps its registers and only marks atomic facts.  Another arm is an error.
    """
    letter, atomic = F.regexp_extract(arm, r"^Arm ([A-E])\b", 1), F.coalesce(is_atomic(category), F.lit(False))
    name = (
        F.when(letter == "A", "plain").when(letter == "B", "answer_only").when(letter == "C", "registers").when(letter == "E", "sandbox")
        .when(letter == "D", F.when(atomic, "bypass").otherwise("plain")).otherwise(F.raise_error(F.concat(F.lit("unknown arm: "), F.coalesce(arm, F.lit("null")))).cast("string"))
    )
    return F.struct(name.alias("template"), prompt_for(name, prompt, templates).alias("prompt"), (letter.isin("C", "D") & atomic).alias("bypass"))
