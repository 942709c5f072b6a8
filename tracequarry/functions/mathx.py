"""Number theory as column expressions over array folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound


def legendre_terms(n: Column, p: Column) -> Column:
    """The positive terms n // p, n // p^2, ... of the valuation of p in n!."""
    n, p = n.cast("bigint"), p.cast("bigint")
    step = lambda a, _: F.when(F.get(F.reverse(a), F.lit(0)) >= p, F.concat(a, F.array(F.call_function("div", F.get(F.reverse(a), F.lit(0)), p)))).otherwise(a)
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.array(n), step), 2, 63)


def legendre(n: Column, p: Column) -> Column:
    return F.aggregate(legendre_terms(n, p), F.lit(0).cast("bigint"), lambda a, x: a + x)


def power_mod(base: Column, exponent: Column, modulus: Column) -> Column:
    """base^exponent mod modulus by squaring; moduli below 2^31."""
    b, e, m = base.cast("bigint"), exponent.cast("bigint"), modulus.cast("bigint")
    start = F.struct(F.pmod(F.lit(1).cast("bigint"), m).alias("r"), F.pmod(b, m).alias("s"))
    step = lambda a, i: F.struct(F.when(F.call_function("shiftright", e, i).bitwiseAND(F.lit(1)) == 1, F.pmod(a["r"] * a["s"], m)).otherwise(a["r"]).alias("r"), F.pmod(a["s"] * a["s"], m).alias("s"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), start, step, lambda a: a["r"])


def _euclid_steps(b: Column) -> Column:
    """1..n where n steps of Euclid's chain suffice behind a number: 1.45 a bit and a few, at most 92 of 64 bits."""
    return F.sequence(F.lit(1), F.least(F.lit(92), F.length(F.bin(b)) + F.shiftright(F.length(F.bin(b)), 1) + 3))


def inverse_mod(a: Column, m: Column) -> Column:
    """The inverse of a modulo m by Euclid's chain, null where there is none."""
    a, m = a.cast("bigint"), m.cast("bigint")
    start = F.struct(F.pmod(a, m).alias("r0"), m.alias("r1"), F.lit(1).cast("bigint").alias("s0"), F.lit(0).cast("bigint").alias("s1"))

    def step(x: Column, _: Column) -> Column:
        q = F.call_function("div", x["r0"], x["r1"])
        return F.when(x["r1"] == 0, x).otherwise(F.struct(x["r1"].alias("r0"), (x["r0"] - q * x["r1"]).alias("r1"), x["s1"].alias("s0"), (x["s0"] - q * x["s1"]).alias("s1")))

    return F.aggregate(_euclid_steps(m), start, step, lambda x: F.when(x["r0"] == 1, F.pmod(x["s0"], m)))


def gcd(a: Column, b: Column) -> Column:
    start = F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b"))
    step = lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), F.pmod(x["a"], F.nullif(x["b"], F.lit(0))).alias("b")))
    return F.aggregate(_euclid_steps(F.abs(b.cast("bigint"))), start, step, lambda x: x["a"])


def solve_crt(congruences: Column) -> Column:
    """Least x >= 0 with x = remainder mod modulus for all of array<struct<r,m>>; null if they contradict."""
    start = F.struct(F.lit(0).cast("bigint").alias("x"), F.lit(1).cast("bigint").alias("m"))

    def step(s: Column, c: Column) -> Column:
        m = c["m"].cast("bigint")

        def joined(g: Column) -> Column:
            gap = c["r"].cast("bigint") - s["x"]
            part = F.call_function("div", m, g)
            k = F.when(F.pmod(gap, g) == 0, F.pmod(F.call_function("div", gap, g) * F.coalesce(inverse_mod(F.call_function("div", s["m"], g), part), F.lit(0)), part))
            return F.struct((s["x"] + s["m"] * k).alias("x"), (s["m"] * part).alias("m"))

        return bound(gcd(s["m"], m), joined)

    return F.aggregate(congruences, start, step, lambda s: s["x"])


def euler_phi(n: Column) -> Column:
    """Count of 1..n prime to n, by trial division up to 1000 (n below 10^6)."""
    start = F.struct(n.cast("bigint").alias("rest"), n.cast("bigint").alias("phi"))

    def step(s: Column, p: Column) -> Column:
        divides = (p <= s["rest"]) & (F.pmod(s["rest"], p) == 0)
        stripped = F.aggregate(F.sequence(F.lit(1), F.lit(20)), s["rest"], lambda r, _: F.when(F.pmod(r, p) == 0, F.call_function("div", r, p)).otherwise(r))
        return F.when(divides, F.struct(stripped.alias("rest"), (s["phi"] - F.call_function("div", s["phi"], p)).alias("phi"))).otherwise(s)

    bound = F.greatest(F.lit(2), F.floor(F.sqrt(n.cast("double"))).cast("int") + 1)
    return F.aggregate(F.sequence(F.lit(2), bound), start, lambda s, p: step(s, p.cast("bigint")), lambda s: F.when(s["rest"] > 1, s["phi"] - F.call_function("div", s["phi"], s["rest"])).otherwise(s["phi"]))


def derangements(n: Column) -> Column:
    """Permutations of n things (up to 20) without a fixed one."""
    start = F.struct(F.lit(1).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, lambda s, i: F.struct(s["b"].alias("a"), (i * (s["a"] + s["b"])).alias("b")), lambda s: F.when(n == 0, s["a"] * 0 + 1).otherwise(s["a"]))


def power_sum(k: Column, n: Column) -> Column:
    """T_n = k T_(n-1) - T_(n-2) with T_0 = 2, T_1 = k: x^n + x^-n where x + 1/x = k."""
    start = F.struct(F.lit(2).cast("bigint").alias("a"), k.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, lambda s, _: F.struct(s["b"].alias("a"), (k.cast("bigint") * s["b"] - s["a"]).alias("b")), lambda s: F.when(n == 0, F.lit(2).cast("bigint")).otherwise(s["a"]))


def choose(n: Column, k: Column) -> Column:
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), F.lit(1).cast("bigint"), lambda a, i: F.when(k == 0, a).otherwise(F.call_function("div", a * (n - i), (i + 1).cast("bigint")))))
