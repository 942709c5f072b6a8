import pytest

from tracequarry.functions import answers as A
from tracequarry.functions import registers as R
from tracequarry.functions import steps as S
from tracequarry.functions import text as T
from tracequarry.operators.evaluator import Refused, check_equality, evaluate, grounded, terminal_value
from tracequarry.operators.executor import Scratchpad, audit, invariants, self_correction, unit_step


@pytest.mark.parametrize("text,tokens,want", [
    ("<think>some thoughts</think>\n<ans>42</ans>", 50, ("42", "closed_ans_tag")), ("<reg:bypass>6</reg:bypass>", 3, ("6", "closed_bypass_tag")), ("Therefore the result is \\boxed{295}.", 80, ("295", "latex_boxed")),
    ("<reg:plan>invariants</reg:plan>\n<reg:deduce>step 1 | ∴ ans = 169</reg:deduce>", 45, ("169", "symbolic_therefore")), ("<reg:deduce>price=123*(1+50%)-15=184-15=169 z</reg:deduce><reg:verify>x</reg:verify>", 256, ("169", "deduce_equality_rhs")),
    ("<reg:deduce>price=123*5", 256, (None, "truncated_incomplete_derivation")), ("", 0, (None, "empty_text")), ("\\boxed{\\frac{1}{2}} then \\boxed{a{b}c}", 1, ("a{b}c", "latex_boxed")),
])
def test_robust_policy(one, text, tokens, want):
    from pyspark.sql import functions as F

    assert tuple(one(lambda c: A.robust(c, F.lit(tokens), F.lit(256)), text)) == want


def test_policies_differ(one):
    assert one(A.lenient, "no tags, 12 and 15") == "15"
    assert one(A.grammar, "115@x") == "115" and one(A.grammar, "no tags, 12") is None
    assert one(A.base, "so the answer is 7\nlast 9") == "7" and one(A.registers, "<ans> 3 </ans>") == "3"


@pytest.mark.parametrize("a,b,want", [("1/2", "0.5/1", "fraction_approx"), ("3.0001", "3", "float_approx"), ("x", "x", "string_exact"), ("4", "5", "fail"), (None, "5", "fail")])
def test_verifier(one, a, b, want):
    assert one(A.verify_method, a, b) == want


def test_reward_form(one):
    assert one(A.answers_match, "1,000", "1000") and one(A.answers_match, "Yes", "true") and one(A.answers_match, "1/2", "0.5") and not one(A.answers_match, None, "1")


def test_text_flags(one):
    assert one(T.repeats, "the answer is 527 527 527 527 527") and not one(T.repeats, "a clean proof of five words here")
    assert one(T.web_debris, "some reasoning endphp IconModule tatto") and not one(T.web_debris, "clean")
    assert one(T.token_estimate, "a→b abcdefgh") == 1 + 1 + 2
    assert one(T.normalised, "Étre, über_x!") == "étre über_x"


@pytest.mark.parametrize("text,depth", [('<reg:scratchpad depth="2">', "Δ2"), ("<reg:bypass>6</reg:bypass>", "Δ0"), ("hyp [x]", "Δ2"), ("<reg:deduce>", "Δ1"), ("backtrack", "Δ5"), ("replan(x)", "Δ4"), ("plain", "Δ1")])
def test_depth(one, text, depth):
    assert one(R.cognitive_depth, text) == depth


def test_registers(one):
    pad = one(R.parse_registers, '<reg:scratchpad depth="4" domain="n">checkpoint(CP1) | verify(x)✗ | backtrack(CP1) | replan(b) | ∴ ans=53</reg:scratchpad><ans>53</ans>')
    assert (pad.register_type, pad.depth, pad.checkpoints, pad.answer) == ("scratchpad", "4", ["CP1"], "53") and pad.backtracks >= 1
    assert one(R.parse_registers, "<reg:bypass>6</reg:bypass>").answer == "6"


def test_documents(one):
    doc = lambda t: one(S.document, t)
    assert doc("<think>let(tot=16) | eat-=3→13 ∴ ans=18</think><ans>18</ans>").extracted == "18"
    assert doc("<think>x").codes == ["E101"] and not doc("<think>x").is_valid
    assert doc("<think>a→b ∴ ans=1</think><ans>2</ans>").codes == ["E203"]
    assert doc("<think></think>\nLima").register_type == "empty"
    assert doc("intent: calm | tone: warm").register_type == "intent"


def test_step_kinds(one):
    kinds = {"let(x=1)": "declaration", "hyp(x)": "hypothesis", "verify(a==b)✗": "verify", "state(a=1)": "state", "checkpoint(A)": "checkpoint", "backtrack": "backtrack", "replan(x)": "replan", "concept: x": "plan", "3x": "transform"}
    for text, kind in kinds.items():
        assert one(S.step_kind, text) == kind
    assert one(S.corrupt_last_equality, "a=1 | b=45") == "a=1 | b=52"
    assert one(S.decompress, "let(x=3) | x+1→4 ∴ ans=4").startswith("1. Initialize variable x to 3.\n2. Compute x+1")


def test_evaluator():
    assert terminal_value("2**10 + 5", {}) == (True, 1029, None) and terminal_value("abs(-42)", {})[1] == 42 and terminal_value("7 mod 4", {})[1] == 3
    for attack in ("__import__('os').system('x')", "open('f')", "[x for x in y]", "(1).__class__", "lambda: 1"):
        assert not terminal_value(attack, {})[0]
    with pytest.raises(Refused):
        evaluate("'text'")
    assert check_equality("15 * 24", "350", {})["repair"] == "hyp [15 * 24 = 360]" and check_equality("(a+b)**2", "a**2 + 2*a*b + b**2", {})["valid"]
    assert grounded("x % 7 == 4 and x % 11 == 9", {"x": 53}) == (True, "verified") and not grounded("x % 7 == 4", {"x": 25 + 1})[0]
    assert grounded("66 > 0", {})[1] == "rejected_trivial_tautology" and grounded("1/0 == 1", {})[1].startswith("eval_error")


def test_unit_steps():
    assert unit_step("inv_mod(7, 11)", {})[0] == 8 and unit_step("legendre(200, 3)", {})[0] == 97
    env = unit_step("let(u = 6)", {})[1]
    assert unit_step("u^2 - 2", env)[0] == 34


def test_scratchpad_rolls_back():
    s = Scratchpad().run("checkpoint(A) | guess=18 | verify(guess == 53)✗ | backtrack(A) | replan(x) | x=53 | verify(x % 7 == 4)✓ | ∴ ans=53")
    assert s.valid and "guess" not in s.env and s.failures == 1 and s.answer == "53"
    s = Scratchpad().run("a=1 | " + " | ".join(["verify(a == 2)✗"] * 3) + " | ans=1")
    assert s.cycle and not s.valid
    s = Scratchpad().run("backtrack(NONE) | verify(1/0 == 1)✗ | x=20 | ans=20")
    assert s.answer == "20" and s.diagnostics


def test_audit():
    assert audit("k=1\nn=3*k+2\nn=5\n∴ ans=5") == {"is_valid": True, "certified_answer": "5", "n_steps": 4, "error_context": None}
    bad = audit("k=1 | n=3*k+2 | n=8")
    assert not bad["is_valid"] and "Contradiction" in bad["error_context"] and bad["error_context"].startswith("[TINY_TERMINAL_ERR]")


def test_invariants():
    let = {"kind": "declaration", "var_name": "tot", "expression": "16"}
    move = lambda lhs, rhs: {"kind": "transform", "lhs": lhs, "rhs": rhs}
    assert invariants([let, move("eat-=3", "13"), move("bake-=4", "9"), move("sell(9*2)", "18")]) == []
    assert invariants([let, move("10-3", "8")]) == ["E201"]
    assert invariants([move("5x-15", "3x+25=5x-15"), move("-3x", "2x-15=25"), move("+15", "2x=40"), move("/2", "x=20")]) == []
    assert invariants([{"kind": "verify", "condition": "2+2 == 5", "passed": True}]) == ["E202"]


def test_self_correction():
    assert self_correction("verify(2+2 == 5)✓ ∴", True) == -0.4 and self_correction("verify(2+2 == 4)✓ ∴", True) == 0.4
    assert self_correction("verify(66 > 0)✓ ∴ ans", True) == 0.0 and self_correction("✗ backtrack ∴ ans=1", True) == 0.4


def test_audit_over_tables(spark):
    from tracequarry.operators import executor

    df = spark.createDataFrame([(1, "<reg:plan>sum</reg:plan><reg:deduce>n=1 | n=2</reg:deduce>"), (2, "<reg:deduce>n=1 ∴ ans=1</reg:deduce>"), (3, None), (4, "<reg:bypass>6</reg:bypass><reg:deduce>n=1</reg:deduce>"), (5, "</reg:deduce>")], "trace_id long, completion string")
    got = {r.trace_id: r for r in executor.terminal_audit(df).collect()}
    assert sorted(got) == [1, 2, 4] and (got[1].state, got[1].rollbacks, got[1].error_context) == ("ROLLBACK", 1, "[TINY_TERMINAL_ERR] step 2, n=2: Contradiction: n is 1, not 2; try hyp [n = 1]")
    assert got[1].recovery_prompt == f"\n{got[1].error_context}\n<think>\n<reg:plan>sum</reg:plan>\n<reg:deduce>"
    assert (got[2].state, got[2].certified_answer, got[2].recovery_prompt, got[4].state) == ("VERIFIED", "1", None, "BYPASS")
    pads = spark.createDataFrame([(1, '<reg:scratchpad depth="2">a=1 | | state(b=x+1) |ans = 1</reg:scratchpad>'), (2, "none")], "trace_id long, completion string")
    end = executor.scratchpad_summary(pads).collect()
    assert [(r.trace_id, r.depth, r.domain, r.n_steps, r.answer, r.is_valid) for r in end] == [(1, "2", "general", 3, "1", True)]
    assert end[0].rendered == '<reg:scratchpad depth="2" domain="general">\n  a=1\n  | state(b=x+1)\n  | ans = 1\n</reg:scratchpad>\n<ans>1</ans>'
    assert [r.value for r in executor.scratchpad_steps(pads).orderBy("step_index").collect()] == ["1", "{'a': 1, 'b': 'x + 1'}", "1"]


def test_failures_count_by_checkpoint():
    s = Scratchpad().run("a=1 | verify(a == 2)✗ | verify(a == 2)✗ | checkpoint(A) | verify(a == 2)✗ | ans=1")
    assert (s.failures, s.cycle, s.valid) == (3, False, True)
    assert invariants([{"kind": "transform", "lhs": "/2", "rhs": "x=20"}, {"kind": "transform", "lhs": "eat-=3", "rhs": "13"}]) == []
