"""Answer extraction policies, normalisers and verifiers as column expressions.

The policies differ on purpose and are kept apart: each is an ordered list of rules, the first that yields a text wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, found, stripped

BOXED = "\\boxed{"
THEREFORE = r"(?i)∴\s*(?:ans\s*=\s*|answer\s*=\s*)([^\n|</]+)"
ASSIGNED = r"(?:∴\s*)?ans\s*=\s*([^\s|✓✗\n<@]+)"
LEADING = r"^([+-]?\d+(?:\.\d+)?|[Tt]rue|[Ff]alse|[Nn]one)(?:[^0-9a-zA-Z.]|$)"


def clean_math(c: Column) -> Column:
    """LaTeX wrappers, sizing commands, dollar signs and blanks taken out."""
    c = stripped(c)
    c = F.regexp_replace(c, r"\\text\{([^}]+)\}", "$1")
    c = F.regexp_replace(c, r"\\mathbf\{([^}]+)\}", "$1")
    c = F.regexp_replace(c, r"\\left|\\right", "")
    return F.replace(stripped(F.replace(c, F.lit("$"), F.lit(""))), F.lit(" "), F.lit(""))


def clean_light(c: Column) -> Column:
    for junk in ("$", "\\text{", "\\mathrm{", "\\mathbf{", "%", ","):
        c = F.replace(c, F.lit(junk), F.lit(""))
    return stripped(c)


def tag_body(c: Column, tag: str) -> Column:
    return stripped(found(c, rf"(?i)<{tag}>\s*([^<]+?)\s*</{tag}>"))


def intent_body(c: Column) -> Column:
    return stripped(found(c, r"(?i)<reg:intent>\s*(?:∴\s*(?:ans\s*=\s*)?)?([^<]+?)\s*</reg:intent>"))


def boxed(c: Column) -> Column:
    """Body of the last ``\\boxed{...}`` with balanced braces, else null; one pass over the text behind it."""
    rest = F.when(F.contains(c, F.lit(BOXED)), F.substring_index(c, BOXED, -1))

    def step(state: Column, letter: Column) -> Column:
        depth = state["depth"] + F.when(letter == "{", 1).when(letter == "}", -1).otherwise(0)
        open_ = state["depth"] > 0
        return F.struct(F.when(open_, depth).otherwise(F.lit(0)).alias("depth"), (state["at"] + F.when(open_, 1).otherwise(0)).alias("at"))

    end = F.aggregate(F.split(rest, ""), F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at")), step)
    return F.when(end["depth"] == 0, stripped(F.substring(rest, F.lit(1), end["at"] - 1)))


def after_last(c: Column, tag: str) -> Column:
    return F.when(F.contains(c, F.lit(tag)), F.substring_index(c, tag, -1)).otherwise(c)


def _short(c: Column, limit: int) -> Column:
    return bound(stripped(c), lambda s: F.when((s != "") & (F.length(s) < limit), s))


def _ruled(rules: list[tuple[Column, str]], gates: list[tuple[Column, str]], last: str = "rejected_no_valid_closure") -> Column:
    """struct(answer, method): gates refuse first, then the first rule with a text wins."""
    refusal = lambda name: F.struct(F.lit(None).cast("string").alias("answer"), F.lit(name).alias("method"))
    hit = lambda value, name: bound(value, lambda v: F.when(v != "", F.struct(clean_math(v).alias("answer"), F.lit(name).alias("method"))))
    found_by = F.coalesce(*[hit(value, name) for value, name in rules], refusal(last))  # a value is computed once, and only if those before it gave none
    out = None
    for cond, name in gates:
        out = F.when(cond, refusal(name)) if out is None else out.when(cond, refusal(name))
    return found_by if out is None else out.otherwise(found_by)


def _empty(c: Column) -> tuple[Column, str]:
    return c.isNull() | (c == ""), "empty_text"


def strict(c: Column, tokens: Column, limit: Column) -> Column:
    """Tags first, then the truncation gate, then a therefore statement."""
    cut = (tokens >= limit) & ~F.contains(c, F.lit("</ans>"))
    refused = F.struct(F.lit(None).cast("string").alias("answer"), F.lit("truncated_incomplete_derivation").alias("method"))
    tags = [(tag_body(c, "ans"), "closed_ans_tag"), (tag_body(c, "reg:bypass"), "closed_bypass_tag"), (intent_body(c), "closed_intent_tag")]
    then = _ruled([(_short(found(c, THEREFORE), 60), "symbolic_therefore_statement")], [_empty(c)])
    return bound(_ruled(tags, [_empty(c)]), lambda first: F.when(first["method"] != "rejected_no_valid_closure", first).when(cut, refused).otherwise(then))


def _closed(c: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(c, F.lit(m))
    return out


def robust(c: Column, tokens: Column, limit: Column) -> Column:
    """The truncation gate with six closure marks comes first; the last rule reads the last equality of a closed deduction."""
    gate = (tokens >= limit) & ~_closed(c, ("</ans>", BOXED, "</reg:bypass>", "</reg:deduce>", "</reg:verify>", "</think>"))
    closed = _closed(c, ("</reg:deduce>", "</reg:verify>"))
    body = stripped(found(c, r"(?s)<reg:deduce>(.*?)(?:</reg:deduce>|</think>|$)"))
    equal = F.get(F.reverse(F.regexp_extract_all(body, F.lit(r"(?:=\s*|≡\s*)([-+]?\d+(?:\.\d+)?(?:/\d+)?)"), F.lit(1))), F.lit(0))
    rules = [
        (tag_body(c, "ans"), "closed_ans_tag"), (tag_body(c, "reg:bypass"), "closed_bypass_tag"), (boxed(c), "latex_boxed"), (_short(found(c, THEREFORE), 60), "symbolic_therefore"),
        (F.when(closed, _short(found(body, THEREFORE), 60)), "deduce_therefore"), (F.when(closed, _short(equal, 60)), "deduce_equality_rhs"),
    ]
    return _ruled(rules, [_empty(c), (gate, "truncated_incomplete_derivation")])


def ablation(c: Column, tokens: Column, limit: Column) -> Column:
    gate = (tokens >= limit) & ~_closed(c, ("</ans>", BOXED, "</reg:bypass>"))
    header = _short(F.regexp_replace(found(c, r"(?i)(?:Final Answer|Answer):\s*([^\n]+)"), "[*$`]", ""), 40)
    rules = [(tag_body(c, "ans"), "closed_ans_tag"), (tag_body(c, "reg:bypass"), "closed_bypass_tag"), (boxed(c), "latex_boxed"), (_short(found(c, THEREFORE), 60), "symbolic_therefore"), (header, "explicit_final_answer_header")]
    return _ruled(rules, [_empty(c), (gate, "truncated_incomplete_derivation")])


def lenient(c: Column) -> Column:
    """The permissive policy: down to the last whole number behind the thought."""
    rules = [
        tag_body(c, "ans"), tag_body(c, "reg:bypass"), intent_body(c), found(c, r"(?i)∴\s*(?:ans\s*=\s*|answer\s*=\s*)?(-?\d+(?:\.\d+)?)"),
        found(c, r"verify\(\s*(-?\d+(?:\.\d+)?)\s*==\s*\1\s*\)\s*→\s*✓"),
    ]
    numbers = F.regexp_extract_all(after_last(c, "</think>"), F.lit(r"[-+]?\d+"), F.lit(0))
    return F.coalesce(*rules, F.get(F.reverse(numbers), F.lit(0)))


def grammar(c: Column) -> Column:
    ans, bypass = r"(?s)<ans>(.*?)</ans>", r"(?s)<reg:bypass>(.*?)</reg:bypass>"
    tail = stripped(after_last(stripped(c), "</think>"))
    scalar = found(tail, LEADING)
    return F.when(c.rlike(ans), stripped(F.regexp_extract(c, ans, 1))).when(c.rlike(bypass), stripped(F.regexp_extract(c, bypass, 1))).otherwise(F.coalesce(found(c, ASSIGNED), found(after_last(tail, "</reg:deduce>"), ASSIGNED), scalar))


def base(c: Column) -> Column:
    """For plain prose: boxed, then a phrase, then the last number of the last line."""
    tail = after_last(c, "</think>")
    phrase = _short(found(tail, r"(?i)(?:answer is|equals|is equal to|\ban\s*=\s*|:\s*)\s*([^\n.$]+)"), 40)
    lines = F.filter(F.transform(F.split(tail, r"\r\n|\r|\n"), stripped), lambda x: x != "")
    numbers = F.regexp_extract_all(F.get(F.reverse(lines), F.lit(0)), F.lit(r"[-+]?\d+(?:/\d+)?(?:\.\d+)?"), F.lit(0))
    return F.coalesce(clean_math(boxed(c)), clean_math(phrase), F.get(F.reverse(numbers), F.lit(0)))


def registers(c: Column) -> Column:
    ans = r"(?s)<ans>(.*?)</ans>"
    therefore = found(c, r"(?i)∴\s*(?:ans\s*=\s*|answer\s*=\s*)?([^\n|</]+)")
    check = found(c, r"verify\(\s*([^=]+)\s*==\s*\1\s*\)\s*[→]?\s*✓")
    return F.when(c.rlike(ans), clean_math(stripped(F.regexp_extract(c, ans, 1)))).otherwise(F.coalesce(clean_math(therefore), clean_math(check), base(c)))


def modern(c: Column) -> Column:
    ans = r"(?s)<ans>(.*?)</ans>"
    return F.when(c.rlike(ans), stripped(F.regexp_extract(c, ans, 1))).otherwise(F.coalesce(found(c, ASSIGNED), found(stripped(after_last(c, "</think>")), LEADING), grammar(c)))


# -- verifiers ----------------------------------------------------------------------------------------------
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number(c: Column) -> Column:
    """A plain decimal number as double, else null (suffixes that some casts accept are not numbers)."""
    return F.when(c.rlike(NUMBER), F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double"))


def fraction(c: Column) -> Column:
    parts = F.split(c, "/")
    return F.try_divide(number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1))))


def digits(c: Column) -> Column:
    return number(F.regexp_replace(c, r"[^\d.\-]", ""))


def _near(a: Column, b: Column, absolute: float, relative: float) -> Column:
    def near(x: Column) -> Column:
        a, b = x["a"], x["b"]
        return F.coalesce((F.abs(a - b) < absolute) | ((b != 0) & (F.abs(a - b) / F.nullif(F.abs(b), F.lit(0.0)) < relative)), F.lit(False))

    return bound(F.struct(a.alias("a"), b.alias("b")), near)


def verify_method(answer: Column, truth: Column) -> Column:
    """How an answer matches: string_exact, fraction_approx, float_approx or fail."""
    blank = answer.isNull() | (stripped(answer) == "")

    def told(x: Column) -> Column:
        ext, gt = x["ext"], x["gt"]
        slash = F.contains(gt, F.lit("/")) & F.contains(ext, F.lit("/"))
        parts = slash & F.coalesce(F.abs(fraction(gt) - fraction(ext)) < 1e-4, F.lit(False))
        return F.when(ext == gt, "string_exact").when(parts, "fraction_approx").when(_near(digits(ext), digits(gt), 1e-3, 1e-3), "float_approx").otherwise("fail")

    both = F.struct(clean_math(F.lower(stripped(answer))).alias("ext"), clean_math(F.lower(stripped(truth))).alias("gt"))
    return F.when(blank, "fail").otherwise(bound(both, told))


def verify_strict(answer: Column, truth: Column) -> Column:
    return verify_method(answer, truth) != "fail"


def verify_lenient(answer: Column, truth: Column, category: Column) -> Column:
    def told(x: Column) -> Column:
        ext, gt = x["ext"], x["gt"]
        slash = F.contains(gt, F.lit("/")) & F.contains(ext, F.lit("/"))
        parts = slash & F.coalesce(F.abs(fraction(gt) - fraction(ext)) < 1e-4, F.lit(False))
        inside = category.rlike("Factual|Retrieval|Science") & (F.contains(ext, gt) | F.contains(gt, ext))
        talk = category.rlike("Dialogue|Intent|Pragmatics") & (F.length(ext) > 15)
        return F.coalesce((ext == gt) | parts | _near(digits(ext), digits(gt), 0.05, 0.01) | inside | talk, F.lit(False))

    return bound(F.struct(F.lower(stripped(answer)).alias("ext"), F.lower(stripped(truth)).alias("gt")), told)


def reward_form(c: Column) -> Column:
    """Form in which rewards compare answers: fractions and numbers as six-place numbers, words in lower case."""

    def form(c: Column) -> Column:
        value = F.when(F.contains(c, F.lit("/")), fraction(c)).otherwise(number(F.replace(c, F.lit(","), F.lit(""))))
        word = bound(F.lower(c), lambda low: F.when(low.isin("true", "yes", "correct"), "true").when(low.isin("false", "no", "incorrect"), "false").otherwise(low))
        return F.coalesce(F.round(value, 6).cast("string"), word)

    return bound(stripped(c), form)


def answers_match(answer: Column, truth: Column) -> Column:
    return F.coalesce(reward_form(answer) == reward_form(truth), F.lit(False))


def numeric(c: Column) -> Column:
    """A number written plainly, as ``\\frac{a}{b}`` or as ``a/b``."""
    latex = r"^\\frac\{([^{}]+)\}\{([^{}]+)\}$"
    return F.coalesce(number(c), F.try_divide(number(F.regexp_extract(c, latex, 1)), number(F.regexp_extract(c, latex, 2))), fraction(c))


def verify_plain(answer: Column, truth: Column, tolerance: float = 1e-4) -> Column:
    """Equal but for case, equal as yes/no words, close as numbers, or equal once cleaned."""
    a, b = F.lower(stripped(answer)), F.lower(stripped(truth))
    flag = lambda x: F.when(x.isin("true", "yes", "1"), True).when(x.isin("false", "no", "0"), False)
    x, y = numeric(clean_light(answer)), numeric(clean_light(truth))
    close = F.abs(x - y) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(x), F.abs(y)))
    no = F.lit(False)
    return F.coalesce(a == b, no) | F.coalesce(flag(a) == flag(b), no) | F.coalesce(close, no) | F.coalesce(F.lower(clean_light(answer)) == F.lower(clean_light(truth)), no)


def equivalent(answer: Column, truth: Column) -> Column:
    """Equal once cleaned, close as numbers, or close where either is a fraction."""
    a, b = F.lower(clean_math(answer)), F.lower(clean_math(truth))
    slash = F.contains(a, F.lit("/")) | F.contains(b, F.lit("/"))
    either = lambda c: F.coalesce(number(c), fraction(c))
    parts = slash & F.coalesce(F.abs(either(a) - either(b)) < 1e-4, F.lit(False))
    return F.coalesce((a != "") & (b != "") & ((a == b) | _near(number(a), number(b), 1e-4, 1e-3) | parts), F.lit(False))


#: Where English solutions name their result, in order.
ENGLISH_RESULTS = tuple(rf"(?id){words}(-?\d+(?:\.\d+)?){end}" for words, end in ((r"answer is[:\s]+", ""), ("= ", r"[\.\s]*$"), ("total.*?", r"[\.\s]*$"), ("result.*?", r"[\.\s]*$"), ("so.*?", r"[\.\s]*$")))


def english(c: Column) -> Column:
    """The number that an English solution names as its result, else its last one."""
    named = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in ENGLISH_RESULTS]
    return F.coalesce(*named, F.try_element_at(F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), F.lit(-1)))


def cut_off(tokens: Column, limit: Column, c: Column, closure: str = "\\boxed") -> Column:
    """Whether a completion ran into its budget without the mark that closes it."""
    return (tokens >= limit) & ~F.contains(c, F.lit(closure))
