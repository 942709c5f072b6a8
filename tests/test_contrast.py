import re

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import contrast, generators


@pytest.mark.parametrize("concept,prompt,want", [
    ("polynomial_invariant", "If x + 1/x = 5, find", ("x^2 + 1/x^2 = 25", "25 == 5^2 - 2")), ("polynomial_invariant", "no value", ("x^2 + 1/x^2 = 36", "36 == 6^2 - 2")),
    ("chinese_remainder", "n ≡ 4 (mod 7) and n ≡ 9 (mod 11)", ("n = 11", "11 % 11 == 9")), ("chinese_remainder", "x = 1 mod 7 and x = 8 mod 11", ("n = 15", "15 % 11 == 8")), ("chinese_remainder", "x = 1 mod 7 and x = 2 mod 0", ("add the remainders", "every congruence holds")),
    ("legendre_valuation", "How often does 3 divide 200!?", ("v = 200 // 3 = 66", "all powers are counted")), ("legendre_valuation", "valuation of 50! at prime 7", ("v = 50 // 7 = 7", "all powers are counted")), ("legendre_valuation", None, ("v is the first term", "all powers are counted")),
    ("physics", "", ("speed stays as it was", "the acceleration is used")), ("unheard", "", ("first idea", "the conditions hold")), (None, None, ("first idea", "the conditions hold")),
])
def test_guesses(one, concept, prompt, want):
    got = one(lambda c: contrast.failed_guess(F.lit(concept).cast("string"), c), prompt)
    assert (got.hypothesis, got.condition) == want and got.reason


def test_contrastive_rows(spark):
    before = {r.id: r for r in generators.concept_curriculum(spark, 20).collect()}
    rows = contrast.contrastive(generators.concept_curriculum(spark, 20)).collect()
    assert {r.id for r in rows} == set(before) and 50 < sum(r.is_contrastive_negative for r in rows) <= 93
    for r in rows:
        old = before[r.id]
        assert r.is_contrastive_negative == (r.place % 3 == 0 and r.concept not in ("factual_bypass", "intent_dialogue"))
        if not r.is_contrastive_negative:
            assert r.full_target == old.full_target
            continue
        assert r.full_target.endswith(f"<ans>{r.ground_truth}</ans>") and f"replan: {r.canonical_deduce}" in r.full_target and "<reg:plan>" in r.full_target
        if r.concept == "chinese_remainder":
            guess, m, s = map(int, re.search(r"verify\((\d+) % (\d+) == (\d+)\)✗", r.full_target).groups())
            assert guess % m != s
