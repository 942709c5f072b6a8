"""Generated curricula and converted solutions: rows of ``spark.range`` with hashed parameters and formula columns."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mathx as M
from ..functions.text import bound, stripped
from .summaries import numbered


def draw(name: str, low: int, high: int, seed: int = 42) -> Column:
    """A whole number in [low, high] from a hash of the row's id: the same wherever and whenever the row is made."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "i"), F.lit(high - low + 1)) + low).cast("bigint")


def pick(name: str, values) -> Column:
    return F.get(F.array(*map(F.lit, values)), draw(name, 0, len(values) - 1).cast("int"))


def hashed(name: str, below: Column, seed: int = 42) -> Column:
    """A whole number in [0, below) where the bound is a column."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "i"), below).cast("bigint")


def _sample(spark: SparkSession, n: int, family: str, depth: str, params: dict, prompt: list, steps: list, answer: Column, target: int, keep: Column | None = None) -> DataFrame:
    """Text parts may be strings or columns of the drawn parameters; ``keep`` says which of the n rows are of this kind."""
    rows = spark.range(n).withColumnRenamed("id", "i")
    rows = rows if keep is None else rows.where(keep)
    for k, v in params.items():
        rows = rows.withColumn(k, v)
    text = lambda parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    rows = rows.withColumn("ground_truth", answer.cast("string"))
    deduce = F.concat(text(steps), F.lit(" ∴ ans = "), F.col("ground_truth"))
    target_text = F.concat(F.lit(f"<think><reg:plan>concept: {family}</reg:plan><reg:deduce>"), deduce, F.lit("</reg:deduce></think><ans>"), F.col("ground_truth"), F.lit("</ans>"))
    return rows.select(F.concat(F.lit(f"{family}_"), F.col("i").cast("string")).alias("id"), F.lit(family).alias("concept"), F.lit(depth).alias("depth"), text(prompt).alias("prompt"), "ground_truth", deduce.alias("canonical_deduce"), target_text.alias("full_target"), F.lit(target).alias("target_tokens"))


c = F.col
#: Right triangles, coprime moduli, powers, odd numbers, facts and dialogue openers that rows are made of.
TRIPLES = ((3, 4, 5), (5, 12, 13), (8, 15, 17), (7, 24, 25), (9, 40, 41), (6, 8, 10), (10, 24, 26), (15, 20, 25), (12, 16, 20), (18, 24, 30))
MODULI = ((7, 11), (5, 13), (9, 11), (8, 15), (11, 13), (7, 17))
DEEP_MODULI = ((7, 11), (5, 9), (8, 13), (7, 13), (9, 11))
POWERS = tuple((b, m) for b in (2, 3, 5, 7) for m in (10, 13, 17, 19, 25, 100) if math.gcd(b, m) == 1)
ODD_NUMBERS = (45, 77, 105, 117, 135, 165, 189, 225)
FACTS = (("chemical symbol of potassium", "K"), ("number of sides of a hexagon", "6"), ("freezing point of water in kelvin", "273"), ("number of bits in a byte", "8"))
TALK = (("I failed my exam today", "validate"), ("My code finally works", "celebrate"), ("I cannot decide between two jobs", "explore"))


def _row_of(name: str, fields: str, rows) -> Column:
    return F.get(F.array(*[F.struct(*[F.lit(x).cast("bigint").alias(k) for k, x in zip(fields, r)]) for r in rows]), draw(name, 0, len(rows) - 1).cast("int"))


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _power(base: Column, exponent: Column) -> Column:
    return F.round(F.pow(base, exponent)).cast("bigint")


def _signed(x: Column) -> Column:
    return F.concat(F.when(x < 0, "- ").otherwise("+ "), F.abs(x).cast("string"))


def _congruences(moduli) -> tuple:
    """Parameters, prompt, steps and answer of two congruences whose solution is drawn from all but zero."""
    pair = lambda r, m: F.struct(r.cast("bigint").alias("r"), m.cast("bigint").alias("m"))
    p, q, r, s = c("m.p"), c("m.q"), c("r"), c("s")
    params = {"m": _row_of("mod", "pq", moduli), "x": hashed("cx", p * q - 1) + 1, "r": F.pmod(c("x"), p), "s": F.pmod(c("x"), q)}
    return params, ["Find the least x with x = ", r, " mod ", p, " and x = ", s, " mod ", q, "."], ["x ≡ ", r, " mod ", p, " | x ≡ ", s, " mod ", q], M.solve_crt(F.array(pair(r, p), pair(s, q)))


def _kinds() -> dict[str, list[tuple]]:
    """Family to (share, depth, parameters, prompt, steps, answer, target tokens) of each kind of its rows."""
    a, b, d, k, n, p, s, t, u, v, x, y = (c(name) for name in "abdknpstuvxy")
    tri = _row_of("tri", "abh", TRIPLES)
    perimeter = c("t.a") + c("t.b") + c("t.h")
    radius = _div(_div(c("t.a") * c("t.b"), 2), _div(perimeter, 2))
    divisors = F.filter(F.sequence(F.lit(1).cast("bigint"), n), lambda z: (n % z == 0) & (z * z <= n) & (z % 2 == _div(n, z) % 2))
    hours = 1 + (a - 1) * b / (a + b)
    det = a * d - b * c("e")
    lucas = F.aggregate(F.sequence(F.lit(1).cast("bigint"), n), F.struct(F.lit(2).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b")), lambda z, _: F.struct(z["b"].alias("a"), (z["a"] + z["b"]).alias("b")), lambda z: z["a"])
    pushes = F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint")), lambda z: (v * v - u * u) % (z * 2) == 0)
    return {
        "polynomial_invariant": [(1, "Δ2", {"k": draw("pk", 3, 9), "p": draw("pp", 2, 5)}, ["If x + 1/x = ", k, ", find x^", p, " + 1/x^", p, "."], ["let(u=", k, ") | T_n = u*T_(n-1) - T_(n-2)"], M.power_sum(k, p), 50)],
        "chinese_remainder": [(1, "Δ3", *_congruences(MODULI), 85)],
        "modular_power": [(1, "Δ2", {"m": _row_of("mm", "bm", POWERS), "k": pick("me", (500, 1000, 2024, 2025, 2026, 2027)), "p": M.euler_phi(c("m.m"))}, ["Find ", c("m.b"), "^", k, " mod ", c("m.m"), "."], ["φ=", p, " | e=", F.pmod(k, p)], M.power_mod(c("m.b"), k, c("m.m")), 50)],
        "legendre_valuation": [(1, "Δ1", {"n": draw("ln", 50, 2500), "p": pick("lp", (2, 3, 5, 7, 11))}, ["How often does ", p, " divide ", n, "!?"], [F.array_join(F.transform(M.legendre_terms(n, p), lambda z: z.cast("string")), " | ")], M.legendre(n, p), 30)],
        "counting": [
            (3, "Δ2", {"n": draw("dn", 3, 7)}, ["How many derangements of ", n, " letters are there?"], ["D_n = (n-1)*(D_(n-1) + D_(n-2))"], M.derangements(n.cast("int")), 55),
            (2, "Δ2", {"t": draw("st", 10, 20), "k": draw("sk", 3, 4), "d": draw("sl", 1, 2)}, ["Place ", t, " coins in ", k, " boxes with at least ", d, " in each."], ["rest=", t - k * d], M.choose((t - k * d + k - 1).cast("int"), (k - 1).cast("int")), 55),
        ],
        "inradius": [(1, "Δ2", {"t": tri}, ["A right triangle has inradius ", radius, " and perimeter ", perimeter, ". Find its area."], ["s=", _div(perimeter, 2), " | A=r*s"], radius * _div(perimeter, 2), 50)],
        "squares_and_rates": [
            (1, "Δ2", {"n": pick("qn", ODD_NUMBERS).cast("bigint")}, ["How many pairs of whole numbers, x > 0 and y not below 0, have x^2 - y^2 = ", n, "?"], ["(x-y)*(x+y)=", n, " | d=", F.array_join(F.transform(divisors, lambda z: z.cast("string")), ",")], F.size(divisors), 40),
            (1, "Δ2", {"a": pick("wa", (4, 6, 8)), "b": pick("wb", (6, 8, 12))}, ["Pump A fills a tank in ", a, " hours, pump B in ", b, ". A runs alone for 1 hour, then both run. How many hours does it take?"], ["rest=1-1/", a, " | rate=1/", a, "+1/", b], F.when((a - 1) * b % (a + b) == 0, F.round(hours).cast("bigint").cast("string")).otherwise(F.round(hours, 2).cast("string")), 45),
        ],
        "linear_algebra": [
            (1, "Δ1", {"a": draw("ea", 2, 9), "v": draw("ex", 0, 39) - 15, "x": v + F.when(v >= 0, 1).otherwise(0), "b": draw("eb", -30, 30)}, ["Solve ", a, "x ", _signed(b), " = ", a * x + b, "."], [a, "x=", a * x, " | x=", x], x, 30),
            (1, "Δ2", {"x": draw("lx", 1, 12), "y": draw("ly", 1, 12), "a": draw("la", 1, 5), "b": draw("lb", 1, 5), "d": draw("ld", 1, 5), "v": draw("le", 1, 5), "u": F.when(a * v == b * d, v % 5 + 1).otherwise(v), "t": pick("lt", ("x", "y", "x+y"))}, ["Given ", a, "x + ", b, "y = ", a * x + b * y, " and ", d, "x + ", c("u"), "y = ", d * x + c("u") * y, ", find ", t, "."], ["x=", x, " | y=", y], F.when(t == "x", x).when(t == "y", y).otherwise(x + y), 45),
            (1, "Δ1", {"a": draw("ma", -5, 9), "b": draw("mb", -5, 9), "e": draw("mc", -5, 9), "d": draw("md", -5, 9)}, ["Find the determinant of [[", a, ", ", b, "], [", c("e"), ", ", d, "]]."], ["a*d=", a * d, " | b*c=", b * c("e")], det, 30),
        ],
        "combinatorics": [
            (1, "Δ1", {"n": draw("bn", 5, 15), "k": hashed("bk", F.least(F.lit(5), n - 1) - 1) + 2}, ["How many ways to choose ", k, " of ", n, "?"], ["C(n,k)"], M.choose(n.cast("int"), k.cast("int")), 30),
            (1, "Δ1", {"n": draw("pn", 4, 10), "k": hashed("pk", F.least(F.lit(4), n - 1) - 1) + 2}, ["How many ways to line up ", k, " of ", n, "?"], ["n!/(n-k)!"], F.aggregate(F.sequence(n - k + 1, n), F.lit(1).cast("bigint"), lambda z, w: z * w), 30),
            (1, "Δ2", {"n": draw("xn", 4, 8), "k": hashed("xk", n - 1) + 1, "a": draw("xa", 2, 3)}, ["Find the coefficient of x^", k, " in (x + ", a, ")^", n, "."], ["C(n,k)*a^(n-k)"], M.choose(n.cast("int"), k.cast("int")) * _power(a, n - k), 35),
        ],
        "sequences": [
            (1, "Δ1", {"a": draw("ta", 1, 20), "d": draw("td", 2, 9), "n": draw("tn", 10, 40)}, ["Find term ", n, " of ", a, ", ", a + d, ", ", a + 2 * d, ", ..."], ["a+(n-1)d"], a + (n - 1) * d, 30),
            (1, "Δ1", {"a": draw("sa", 1, 10), "d": draw("sd", 2, 6), "n": pick("sn", (10, 12, 14, 16, 20)).cast("bigint")}, ["Sum the first ", n, " terms of ", a, ", ", a + d, ", ..."], ["n*(2a+(n-1)d)/2"], _div(n * (2 * a + (n - 1) * d), 2), 30),
            (1, "Δ1", {"a": draw("ga", 1, 4), "d": draw("gr", 2, 3), "n": draw("gn", 4, 7)}, ["Find term ", n, " of ", a, ", ", a * d, ", ", a * d * d, ", ..."], ["a*r^(n-1)"], a * _power(d, n - 1), 30),
            (1, "Δ2", {"n": draw("un", 3, 10)}, ["With L_0 = 2, L_1 = 1 and L_n = L_(n-1) + L_(n-2), find L_", n, "."], ["L_n = L_(n-1) + L_(n-2)"], lucas, 40),
        ],
        "word_problems": [
            (1, "Δ1", {"p": pick("wp", (50, 80, 100, 120, 150, 200, 250, 300, 400)), "u": pick("wu", (10, 20, 25, 30, 50)), "v": pick("wv", (10, 20)), "a": _div(p * (100 - u), 100)}, ["A price of ", p, " falls by ", u, " % and then by ", v, " %, rounded down each time."], ["first=", a], _div(a * (100 - v), 100), 40),
            (1, "Δ1", {"s": draw("as", 5, 15), "k": pick("ak", (3, 4, 5)), "t": pick("at", ("father", "son"))}, ["A father is ", k, " times as old as his son; in ", (k - 2) * s, " years twice as old. How old is the ", t, "?"], ["f=", k, "*s | f+y=2*(s+y)"], F.when(t == "father", k * s).otherwise(s), 40),
            (1, "Δ1", {"u": pick("vu", (40, 50, 60, 70)), "v": pick("vv", (50, 60, 80)), "t": draw("vt", 2, 5)}, ["Two trains ", (u + v) * t, " km apart approach each other at ", u, " and ", v, " km/h. After how many hours do they meet?"], ["v=", u + v], t, 35),
        ],
        "physics": [
            (1, "Δ1", {"u": pick("ku", (0, 5, 10, 15, 20)), "a": draw("ka", 2, 8), "t": draw("kt", 3, 12)}, ["u = ", u, " m/s, a = ", a, " m/s^2, t = ", t, " s. Find v."], ["v=u+a*t"], u + a * t, 28),
            (1, "Δ1", {"v": pick("fv", (10, 12, 14, 16, 20, 24)).cast("bigint"), "u": pick("fu", (0, 2, 4, 6)).cast("bigint"), "a": F.get(pushes, hashed("fa", F.size(pushes).cast("bigint")).cast("int")), "s": _div(v * v - u * u, 2 * a)}, ["u = ", u, " m/s, a = ", a, " m/s^2, s = ", s, " m. Find v."], ["v^2=u^2+2*a*s=", v * v], v, 30),
            (1, "Δ1", {"p": pick("em", (2, 4, 6, 8, 10, 12)), "v": pick("ev", (3, 4, 5, 6, 8, 10))}, ["Find the kinetic energy of ", p, " kg at ", v, " m/s."], ["m*v^2/2"], _div(p * v * v, 2), 28),
            (1, "Δ1", {"a": draw("oi", 2, 10), "b": pick("or", (5, 10, 12, 15, 20, 25, 30, 50))}, ["A current of ", a, " A flows through ", b, " ohms. Find the voltage."], ["V=I*R"], a * b, 25),
        ],
    }


def families(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    """n rows of each family; of a family's kinds each row is one, drawn by the kinds' shares."""
    out = {}
    for family, kinds in _kinds().items():
        total, at, parts = sum(kind[0] for kind in kinds), 0, []
        lot = draw(f"kind of {family}", 0, total - 1)
        for share, depth, params, prompt, steps, answer, target in kinds:
            parts.append(_sample(spark, n, family, depth, params, prompt, steps, answer, target, (lot >= at) & (lot < at + share)))
            at += share
        out[family] = reduce(DataFrame.unionByName, parts)
    return out


def _seeded(spark: SparkSession, n: int, kind: str, seeds, prompt: str, target: Column) -> DataFrame:
    row = F.get(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in seeds]), F.pmod(c("i"), F.lit(len(seeds))).cast("int"))
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("s", row)
    return rows.select(F.concat(F.lit(f"{kind}_"), c("i").cast("string")).alias("id"), F.lit(kind).alias("concept"), F.lit("Δ0").alias("depth"), F.concat(F.lit(prompt), c("s.a")).alias("prompt"), c("s.b").alias("ground_truth"), F.lit(None).cast("string").alias("canonical_deduce"), target.alias("full_target"), F.lit(8).alias("target_tokens"))


def _facts(spark: SparkSession, n: int) -> DataFrame:
    return _seeded(spark, n, "factual_bypass", FACTS, "What is the ", F.concat(F.lit("<reg:bypass>"), c("s.b"), F.lit("</reg:bypass>")))


def concept_curriculum(spark: SparkSession, per_family: int = 400, share: float = 0.08, seed: int = 42) -> DataFrame:
    """All families with equal counts, facts and dialogue for a share of the whole; ``place`` is each row's rank in a shuffle."""
    parts = list(families(spark, per_family).values())
    extra = max(1, int(per_family * len(parts) * share))
    talk = F.concat(F.lit("<reg:intent>intent: "), c("s.b"), F.lit(" | tone: warm</reg:intent>"))
    parts += [_facts(spark, extra), _seeded(spark, extra, "intent_dialogue", TALK, "", talk)]
    return numbered(reduce(DataFrame.unionByName, parts), "id", "%d", seed).drop("label")


def depth_curriculum(spark: SparkSession, counts=(("Δ0", 300), ("Δ1", 500), ("Δ2", 450), ("Δ3", 350))) -> DataFrame:
    """Rows by depth: facts, then three kinds for each depth, a third each and the rest for the last."""
    a, b, k, n, p, v = (c(name) for name in "abknpv")
    drop = F.round(v * b / (a + b), 2)
    height = F.round(v * v * 0.25 / 19.6, 2)
    acidity = F.round(4.76 + F.log10(b / a), 2)
    of_depth = {
        "Δ1": [
            ("legendre_valuation", {"n": draw("5n", 30, 250), "p": pick("5p", (2, 3, 5, 7))}, ["What is the highest power of ", p, " in ", n, "!?"], ["v=Σ n//p^k"], M.legendre(n, p), 30),
            ("symmetric_square", {"k": draw("5k", 3, 12)}, ["If x + 1/x = ", k, ", find x^2 + 1/x^2."], ["k^2-2"], k * k - 2, 28),
            ("voltage_divider", {"a": draw("5a", 5, 20), "b": draw("5b", 10, 30), "v": draw("5v", 20, 100)}, [a, " and ", b, " ohms are in series at ", v, " V. Find the voltage over the second, to 2 places."], ["V*R2/(R1+R2)"], drop, 32),
        ],
        "Δ2": [
            ("inradius", {"a": draw("5r", 2, 8), "b": draw("5s", 15, 40)}, ["A right triangle has inradius ", a, " and perimeter ", b * 2, ". Find its area."], ["s=", b, " | A=r*s"], a * b, 50),
            ("derangements", {"n": draw("5d", 3, 7)}, ["How many derangements of ", n, " letters are there?"], ["D_n = (n-1)*(D_(n-1) + D_(n-2))"], M.derangements(n.cast("int")), 55),
            ("posterior", {}, ["2 % of people have a condition; a test finds 90 % of them and is wrong for 5 % of the others. How likely, in per cent, is the condition after a positive test?"], ["hit=0.02*0.90 | all=hit+0.98*0.05"], F.round(F.lit(1.8) / 0.067, 2), 60),
        ],
        "Δ3": [
            ("chinese_remainder", *_congruences(DEEP_MODULI), 85),
            ("projectile", {"v": draw("5h", 20, 60)}, ["A projectile leaves at ", v, " m/s and 30 degrees. How high does it rise (g = 9.8), to 2 places?"], ["vy=v/2 | h=vy^2/(2*9.8)"], height, 90),
            ("buffer", {"b": pick("5x", (0.1, 0.2, 0.3)), "a": pick("5y", (0.05, 0.1, 0.15))}, ["Find the pH of a buffer of ", a, " M acid (pKa 4.76) and ", b, " M salt, to 2 places."], ["pH=pKa+log10(salt/acid)"], acidity, 80),
        ],
    }
    out = []
    for depth, total in counts:
        if depth == "Δ0":
            out.append(_facts(spark, total))
            continue
        sizes = [total // 3, total // 3, total - 2 * (total // 3)]
        out += [_sample(spark, size, family, depth, *rest) for size, (family, *rest) in zip(sizes, of_depth[depth])]
    return reduce(DataFrame.unionByName, out)


#: Words of the four operations of a word problem.
OPERATIONS = (("+", "add|gain|buy|more|earn|receive"), ("-", "lose|give|spend|remove|sell|less"), ("*", "multipl|times|double|triple"), ("/", "divid|half|split"))


def plain_number(x: Column) -> Column:
    return bound(x, lambda x: F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(F.round(x, 4).cast("string")))


def convert_chain(text: Column) -> Column:
    """A word problem as a chain of assignments: the last number of each sentence, the operation by its words."""
    sentences = F.filter(F.transform(F.split(text, r"[.!?]+"), stripped), lambda s: s.rlike(r"\d"))
    numbers = lambda s: F.regexp_extract_all(s, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    start = F.struct(F.lit(None).cast("double").alias("v"), F.lit("").alias("t"))

    def step(a: Column, s: Column) -> Column:
        n = F.element_at(numbers(s), -1).try_cast("double")
        low = F.lower(s)
        first = F.struct(n.alias("v"), F.concat(F.lit("let(x="), plain_number(n), F.lit(")")).alias("t"))
        out = F.when(a["v"].isNull(), first)
        for sign, words in OPERATIONS:
            v = {"+": a["v"] + n, "-": a["v"] - n, "*": a["v"] * n, "/": F.try_divide(a["v"], n)}[sign]
            out = out.when(low.rlike(words), F.struct(v.alias("v"), F.concat(a["t"], F.lit(f" | x{sign}="), plain_number(n), F.lit("→x="), F.coalesce(plain_number(v), F.lit("undefined"))).alias("t")))
        return out.otherwise(F.struct(a["v"].alias("v"), a["t"].alias("t")))

    done = lambda end: F.struct(end["t"].alias("t"), plain_number(end["v"]).alias("v"))
    row = lambda x: F.struct(F.concat(x["t"], F.lit(" ∴ ans="), x["v"]).alias("trace"), x["v"].alias("answer"), F.lit(0.75).alias("confidence"))
    return bound(sentences, lambda s: F.when(F.size(s) > 0, bound(F.aggregate(s, start, step, done), row)))


def convert_algebra(text: Column) -> Column:
    pattern = r"(\d*)([a-z])\s*([+\-])\s*(\d+)\s*=\s*(\d+)"
    g = lambda k: F.regexp_extract(text, pattern, k)
    a = F.coalesce(F.nullif(g(1), F.lit("")).try_cast("double"), F.lit(1.0))
    rest = F.when(g(3) == "+", g(5).try_cast("double") - g(4).try_cast("double")).otherwise(g(5).try_cast("double") + g(4).try_cast("double"))
    x = plain_number(F.try_divide(rest, a))
    trace = F.concat(g(0), F.lit(" | "), plain_number(a), g(2), F.lit("="), plain_number(rest), F.lit(" | "), g(2), F.lit("="), x, F.lit(" ∴ ans="), x)
    return F.when(text.rlike(pattern), F.struct(trace.alias("trace"), x.alias("answer"), F.lit(0.85).alias("confidence")))


def convert_syllogism(text: Column) -> Column:
    low = F.lower(text)
    kind, parent = (F.regexp_extract(low, r"all\s+(\w+?)s?\s+are\s+(\w+?)s?\b", k) for k in (1, 2))
    who = F.call_function("regexp_extract", low, F.concat(F.lit(r"(\w+)\s+is\s+an?\s+"), kind), F.lit(1))
    name = F.upper(F.substring(who, 1, 1))
    fact = lambda p: F.concat(p, F.lit("("), name, F.lit(")"))
    trace = F.concat(F.lit("hyp(∀x: "), kind, F.lit("(x)→"), parent, F.lit("(x)) | hyp("), fact(kind), F.lit(") | "), fact(kind), F.lit("→"), fact(parent), F.lit(" ∴ ans=True"))
    return F.when((kind != "") & (who != ""), F.struct(trace.alias("trace"), F.lit("True").alias("answer"), F.lit(0.8).alias("confidence")))


def convert_solutions(df: DataFrame, id_col: str = "trace_id", text_col: str = "completion", least: float = 0.5) -> DataFrame:
    """The first conversion that fits, algebra before logic before arithmetic; rows that none fits drop out."""
    t = F.col(text_col)
    first = F.coalesce(convert_algebra(t), convert_syllogism(t), convert_chain(t))
    # Exploded, not filtered: a filter would be pushed below and convert every row a second time.
    return df.select(id_col, F.explode(F.filter(F.array(first), lambda r: r["confidence"] >= least)).alias("r")).select(id_col, "r.*")
