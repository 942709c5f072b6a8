"""The answer grammar against plain patterns; stopping rules in batch and stream against a loop over the tokens."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import grammar
from tracequarry.operators import stopping
from tracequarry.streaming.stopping import box_is_closed, stop_stream

WHOLE = re.compile("<think>\n(<reg:bypass>[^<]+</reg:bypass>|<reg:plan>[^<]+</reg:plan>\n<reg:deduce>[^<]+</reg:deduce>(\n<reg:verify>[^<]+</reg:verify>)?)\n</think>\n<ans>[^<]+</ans>")
GOOD = "<think>\n<reg:plan>a\nb</reg:plan>\n<reg:deduce>c</reg:deduce>\n<reg:verify>d ✓</reg:verify>\n</think>\n<ans>12</ans>"


def walk(table, text):
    """Whether the table accepts ``text``, in plain Python."""
    state = 0
    for atom in re.findall(grammar.ATOM, text):
        number = table.atoms.index(atom) + 1 if atom in table.atoms else 0
        state = -1 if number == 0 and atom[0] == "<" else table.go[state * table.width + number]
        if state < 0:
            return False
    return table.accepting[state]


def variants():
    rng = random.Random(5)
    parts = re.findall(grammar.ATOM, GOOD)
    texts = ["", GOOD, GOOD + "\n", GOOD.replace("12", ""), "<think>\n<reg:bypass>x</reg:bypass>\n</think>\n<ans>1</ans>", GOOD.replace("\n<reg:verify>d ✓</reg:verify>", ""), GOOD.replace("d ✓", "a < b"), "<b>" + GOOD]
    for _ in range(150):
        own = list(parts)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(own))
            own[k : k + rng.randrange(2)] = [rng.choice(parts + ["<", "<b>", "\n", "x"])] * rng.randrange(2)
        texts.append("".join(own))
    return texts + [GOOD[:k] for k in range(0, len(GOOD), 3)] + [texts[4][:k] for k in range(0, 40)]


def test_grammar_accepts_what_the_pattern_accepts(spark):
    texts = variants()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.p for r in rows.select("i", grammar.parsed(F.col("t")).alias("p")).collect()}
    table = grammar.compile_rules()
    for i, t in enumerate(texts):
        assert got[i].accepted == bool(WHOLE.fullmatch(t)) == walk(table, t), t
        assert not got[i].accepted or got[i].read == len(t)
    assert 20 < sum(p.accepted for p in got.values()) < len(texts) and not got[-1].accepted
    # Each state of the table is one where some text stops, and what is awaited there really takes it on.
    assert {p.expects for p in got.values()} == {" ".join(["text"] * (table.go[s * table.width] >= 0) + [a.replace("\n", "\\n") for k, a in enumerate(table.atoms, 1) if table.go[s * table.width + k] >= 0]) for s in range(len(table.accepting))}
    stuck = got[texts.index(GOOD.replace("d ✓", "a < b"))]
    assert stuck.open_rules == "root/think/register_sequence/reasoning_branch/verify_block" and "</reg:verify>" in stuck.expects


def test_other_rules_compile():
    table = grammar.compile_rules('root ::= "<a>" ( item | "\\n" )* tail?\nitem ::= "<b>" [^<\\n]+\ntail ::= "</a>"\n')
    for text, want in (("<a>", True), ("<a><b>x<b>y\n</a>", True), ("<a></a>", True), ("<a><b></a>", False), ("", False), ("<a></a></a>", False)):
        assert walk(table, text) == want, text
    with pytest.raises(ValueError):
        grammar.compile_rules('root ::= "<a>" root? "</a>"\n')


def test_rules_are_written_as_text(spark, tmp_path):
    grammar.export_rules(spark, str(tmp_path / "deep" / "rules.gbnf"))
    text = (tmp_path / "deep" / "rules.gbnf").read_text()
    assert text == grammar.RULES and "root ::= think answer" in text and "<reg:plan>" in text


def brute_stop(tokens, rule, arm=None):
    for k in range(rule.least, len(tokens) + 1):
        tail = "".join(tokens[max(0, k - rule.window) : k])
        for c in rule.closers:
            if c in tail:
                return k, c
        if rule.balanced and box_is_closed(tail):
            return k, "boxed"
        for c in rule.by_arm.get(arm, ()):
            if c in tail:
                return k, c


TEXTS = {
    (1, "A"): "abc</ans>def and more text behind it", (2, "A"): "no closure here at all", (3, "C"): "x</reg:verify> then </ans>", (4, "A"): "x</reg:verify> then </ans>",
    (5, "A"): r"so \boxed{a{b}c} and on", (6, "A"): r"\boxed{never closed and long enough to leave the window of tokens </ans>", (7, "A"): "</ans>" + "z" * 200, (8, "B"): "", (9, "A"): r"\boxed{1} \boxed{2 open",
}


@pytest.mark.parametrize("rule", [stopping.ROBUST, stopping.COMPARING, stopping.MIXED, stopping.Rule(3, 1, ("</ans>", "z"))])
def test_batch_stops(spark, rule):
    rows = spark.createDataFrame([(i, a, t) for (i, a), t in TEXTS.items()], "gen long, arm string, text string")
    got = {(r.gen, r.arm): (r.pos, r.reason) for r in stopping.stop_points(stopping.pieces(rows, "text"), ["gen", "arm"], rule, arm_col="arm").collect()}
    assert got == {k: s for k, t in TEXTS.items() if (s := brute_stop([t[i : i + 4] for i in range(0, len(t), 4)], rule, k[1]))}


def test_stream_agrees_with_batch_on_conversations(spark, tmp_path):
    """Three files, each a part of every text; the stream is started anew from its checkpoint behind each."""
    rule = stopping.Rule(10, 4, (". ", "\n"), True)
    texts = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "text").where("conv_id < 10")
    tokens = stopping.pieces(texts, "text").cache()
    most = tokens.agg(F.max("pos")).first()[0]
    for k in range(3):
        tokens.where((F.col("pos") > most * k // 3) & (F.col("pos") <= most * (k + 1) // 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = stop_stream(source, ["conv_id", "turn"], rule).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert run.awaitTermination(60)
    got = {(r.conv_id, r.turn): (r.pos, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.conv_id, r.turn): (r.pos, r.reason) for r in stopping.stop_points(tokens, ["conv_id", "turn"], rule).collect()}
    assert got == want and len(want) > 20 and max(p for p, _ in want.values()) > 20


def test_stops_of_whole_texts_need_no_shuffle(spark):
    rng = random.Random(9)
    parts = ["</ans>", "</reg:verify>", "\\boxed{", "}", "{", "ab", "→", "\n", "x" * 40, "😀", "</reg:bypass>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(300)] + [None, "</ans>", "a</ans>bc" + "z" * 90 + "</ans>"]
    rows = spark.createDataFrame([(i, "CA"[i % 2], t) for i, t in enumerate(texts)], "i int, arm string, t string")
    for rule in (stopping.ROBUST, stopping.COMPARING, stopping.Rule(2, 1, ("ab",), True)):
        arm = "arm" if rule.by_arm else None
        got = stopping.stop_points_of(rows, "t", ["i", "arm"], rule, arm_col=arm)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        want = stopping.stop_points(stopping.pieces(rows, "t"), ["i", "arm"], rule, arm_col=arm)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
