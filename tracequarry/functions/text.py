"""Text measures as column expressions: normalising, shingles, token estimates, repetition and residue flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The operator letters that count as one token each.
OPERATORS = "→∴∵∧∨¬⊕≡≠≤≥∈∉⊂⊃∀∃∄∩∪∅✓✗↑↓~∞"
#: Residue of web pages.
WEB_DEBRIS = (r"\bendphp\b", r"\bIconModule\b", r"\btatto\b", r"<\?php", r"\bimport\s+react\b", "<!DOCTYPE", r"<\s*/?div\s*>", "__init__", r"typedef\s+", r"public\s+static\s+void")
#: Residue of templates.
SYNTAX_NOISE = ("endphp", "IconModule", "MatButtonModule", "PickerController", "TextInputType", "@endsection", "tatto:", r"\bphp\b", r"\bLaravel\b")
#: Broken endings (cleanliness is their absence).
BROKEN_ENDINGS = (r"=\{\.\.\.", r'\?>"', r"<\?xml", r"\{\{[^}]*$", r"\[\[[^\]]*$", r"\bundefined\b", r"\bnull\b\s*$")
#: Trailing noise, and a tag left open at the end (in a form that every dialect reads).
TRAILING_NOISE = (r"=\{`?\$\{?", "\\?>[\"']", r"<\s*/\s*<\s*\|", r"[<{]{3,}", r"\$\{[^}]*\}", "\\d+\\s*[?=>\"'}{]{2,}")
OPEN_TAG_AT_END = r"</?[a-zA-Z0-9_\-]+(?:[^\p{L}\p{N}_>][^>]*)?$"
#: Conversational fillers (looked for in lower-case text).
FILLERS = (r"\blet me\b", r"\bi need to\b", r"\bfirst\b.*\bthen\b", r"\bstep by step\b", r"\btherefore\b", r"\bthus\b", r"\bwe can see\b", r"\bnotice that\b", r"\bsince\b.*\bwe\b")
FILLER_PHRASES = ("let me think", "first I need to", "step by step", "therefore we see", "in order to")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def normal_words(c: Column) -> Column:
    """Words in lower case of letters, digits and underscores only."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")


def normalised(c: Column) -> Column:
    return F.array_join(normal_words(c), " ")


def shingles(c: Column, n: int = 8) -> Column:
    """Distinct runs of ``n`` words of a normalised text; a shorter text is one run, an empty text none."""
    w = F.split(c, " ")
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return F.when(c == "", F.array().cast("array<string>")).when(F.size(w) < n, F.array(c)).otherwise(F.array_distinct(runs))


def token_estimate(c: Column) -> Column:
    """Per word: each operator letter, and a quarter of the others but at least one."""

    def of_word(total: Column, w: Column) -> Column:
        rest = F.length(F.translate(w, OPERATORS, ""))
        return total + (F.length(w) - rest) + F.greatest(F.lit(1), F.floor(rest / 4).cast("int"))

    return F.aggregate(words(c), F.lit(0), of_word)


def matches_any(c: Column, patterns, flags: str = "") -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(flags + p)
    return out


def web_debris(c: Column) -> Column:
    return matches_any(c, WEB_DEBRIS, "(?i)")


def syntax_noise(c: Column) -> Column:
    return matches_any(c, SYNTAX_NOISE, "(?i)")


def is_clean(c: Column) -> Column:
    return ~matches_any(c, BROKEN_ENDINGS)


def trailing_noise(c: Column) -> Column:
    return F.when(matches_any(c, TRAILING_NOISE) | c.rlike(OPEN_TAG_AT_END), F.lit(-1.0)).otherwise(F.lit(0.0))


def bound(value: Column, body) -> Column:
    """``body(x)`` for x = value, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeats(c: Column) -> Column:
    """Whether one to three words come three times in a row.  The last possible place is not looked at, as defined."""

    def in_words(w: Column) -> Column:
        def at(i: Column) -> Column:
            out = F.lit(False)
            for n in (1, 2, 3):
                same = i < F.size(w) - 3 * n
                for k in range(2 * n):
                    same = same & (F.get(w, i + k) == F.get(w, i + (k + n)))
                out = out | same
            return out

        return (F.size(w) >= 6) & F.exists(F.sequence(F.lit(0), F.greatest(F.size(w) - 4, F.lit(0))), at)

    return F.coalesce(bound(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_.-]+"), F.lit(0)), in_words), F.lit(False))


def filler_score(c: Column) -> Column:
    def share(low: Column) -> Column:
        hits = F.lit(0)
        for p in FILLERS:
            hits = hits + low.rlike(p).cast("int")
        return hits / F.lit(len(FILLERS))

    return bound(F.lower(c), share)


def validation(c: Column) -> Column:
    """struct(has_conclusion, has_steps, answer, leak_score, n_issues, is_valid) of a trace."""
    conclusion = F.contains(c, F.lit("∴")) | F.contains(c, F.lit("<ans>"))
    steps = F.contains(c, F.lit("|"))
    has_answer = c.rlike(r"(?s)<ans>.*?</ans>") | c.rlike(r"ans\s*=\s*\S")
    answer = stripped(F.coalesce(found(c, r"(?s)<ans>(.*?)</ans>"), found(c, r"ans\s*=\s*([^\s|✓✗\n<@]+)")))
    leak = filler_score(c)
    issues = (~conclusion).cast("int") + (~steps).cast("int") + (~has_answer).cast("int") + (leak > 0.3).cast("int")
    return F.struct(conclusion.alias("has_conclusion"), steps.alias("has_steps"), answer.alias("answer"), leak.alias("leak_score"), issues.alias("n_issues"), (issues == 0).alias("is_valid"))


def compression(english: Column, symbolic: Column) -> Column:
    return F.when(english == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - symbolic / english))


def head(c: Column, n: int = 800) -> Column:
    """What is stored of a text."""
    return F.substring(c, 1, n)


def tail(c: Column, n: int = 120) -> Column:
    return F.right(c, F.lit(n))


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))


def code_blocks(c: Column) -> Column:
    """Bodies of Python fences; they are only ever read."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?s)```python\s*(.*?)```"), F.lit(1)), stripped)


#: Families by a part of the tokenizer's name, first match first.
FAMILIES = (("qwen", "Qwen"), ("llama", "LLaMA"), ("gemma", "Gemma"), ("mistral", "Mistral"))


def model_family(name: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(part)), family) for part, family in FAMILIES], F.lit("Universal CausalLM"))
