"""Random numbers fixed by a seed and an index alone: a counter-based generator as column expressions.

Philox 4x32 of 10 rounds turns a counter (index, stream) and a key (seed) into four 32-bit words.  The same index has the same draw on any number
of partitions and on any cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the generator
MULTIPLIERS = (0xD2511F53, 0xCD9E8D57)
STEPS = (0x9E3779B9, 0xBB67AE85)
ROUNDS = 10
MASK = 0xFFFFFFFF


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _product(a: int, b: Column) -> tuple[Column, Column]:
    """High and low word of a 32-bit product; no step passes 2**49."""
    low = b.bitwiseAND(_long(0xFFFF)) * a
    rest = F.shiftright(b, 16) * a + F.shiftright(low, 16)
    return F.shiftright(rest, 16), F.shiftleft(rest.bitwiseAND(_long(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(_long(0xFFFF)))


def words(seed: int, index: Column, stream: int | Column = 0) -> Column:
    """Four 32-bit words, as a struct of longs a, b, c, d."""
    index = index.cast("long")
    stream = _long(stream) if isinstance(stream, int) else stream.cast("long")
    start = F.struct(index.bitwiseAND(_long(MASK)).alias("a"), F.shiftrightunsigned(index, 32).alias("b"), stream.alias("c"), _long(0).alias("d"))
    keys = [((seed & MASK) + r * STEPS[0] & MASK, (seed >> 32 & MASK) + r * STEPS[1] & MASK) for r in range(ROUNDS)]

    def turned(s: Column, k: Column) -> Column:
        (high0, low0), (high1, low1) = _product(MULTIPLIERS[0], s["a"]), _product(MULTIPLIERS[1], s["c"])
        return F.struct(high1.bitwiseXOR(s["b"]).bitwiseXOR(k["x"]).alias("a"), low1.alias("b"), high0.bitwiseXOR(s["d"]).bitwiseXOR(k["y"]).alias("c"), low0.alias("d"))

    return F.aggregate(F.array(*(F.struct(_long(x).alias("x"), _long(y).alias("y")) for x, y in keys)), start, turned)


def _unit(high: Column, low: Column) -> Column:
    """53 bits of two words as a number from 0 to below 1."""
    return (F.shiftright(high, 5) * (1 << 26) + F.shiftright(low, 6)) / float(1 << 53)


def pair(seed: int, index: Column, stream: int | Column = 0) -> Column:
    """Two uniform numbers, as a struct u, v."""
    return F.transform(F.array(words(seed, index, stream)), lambda w: F.struct(_unit(w["a"], w["b"]).alias("u"), _unit(w["c"], w["d"]).alias("v")))[0]


def uniform(seed: int, index: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.lit(float(low)) + pair(seed, index)["u"] * (float(high) - float(low))


def normal(seed: int, index: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """By Box and Muller."""
    z = F.transform(F.array(pair(seed, index)), lambda p: F.sqrt(-2 * F.ln(1 - p["u"])) * F.cos(2 * math.pi * p["v"]))[0]
    return F.lit(float(mean)) + z * float(deviation)


def randint(seed: int, index: Column, low: int, high: int) -> Column:
    """Whole numbers from low to below high, of up to 2**53 values."""
    return F.lit(low).cast("long") + F.floor(pair(seed, index)["u"] * float(high - low)).cast("long")


def exponential(seed: int, index: Column, rate: float = 1.0) -> Column:
    return -F.ln(1 - pair(seed, index)["u"]) / float(rate)


#: Means from which Poisson numbers come by rejection; below, by summing probabilities.
LARGE = 10.0
#: Tries of a rejection: each is taken with a chance of over 0.7.
TRIES = 200


def _log_factorial(k: Column) -> Column:
    """By Stirling's series, and below 10 from the product."""
    small = F.element_at(F.array(*(F.lit(math.lgamma(j + 1)) for j in range(10))), (F.least(k, F.lit(9.0)) + 1).cast("int"))
    large = k * F.ln(k) - k + F.ln(2 * math.pi * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * F.pow(k, F.lit(5.0)))
    return F.when(k < 10, small).otherwise(large)


def poisson(seed: int, index: Column, mean: float) -> Column:
    """Numbers of events.  A large mean costs no more than a small one: a transformed pair of uniform numbers is taken or tried again."""
    if mean < 0 or not math.isfinite(mean):
        raise ValueError("the mean must be 0 or above")
    if mean < LARGE:
        steps = F.sequence(F.lit(1), F.lit(math.ceil(mean + 12 * math.sqrt(mean) + 24)))
        start = F.struct(F.lit(0).cast("long").alias("k"), F.lit(math.exp(-mean)).alias("p"), pair(seed, index)["u"].alias("u"))
        return F.aggregate(steps, start, lambda s, j: F.when(s["u"] < s["p"], s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["p"] * mean / j).alias("p"), (s["u"] - s["p"]).alias("u"))))["k"]
    # the transformed rejection of Hoermann (1993)
    b = 0.931 + 2.53 * math.sqrt(mean)
    a = -0.059 + 0.02483 * b
    inverse, squeeze = 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2)

    def tried(p: Column) -> Column:
        u, v = p["u"] - 0.5, 1 - p["v"]
        us = 0.5 - F.abs(u)
        k = F.floor((2 * a / us + b) * u + mean + 0.43).cast("double")
        at_once = (us >= 0.07) & (v <= squeeze)
        after = ~((k < 0) | ((us < 0.013) & (v > us))) & (F.ln(v * inverse / (a / (us * us) + b)) <= k * math.log(mean) - mean - _log_factorial(F.greatest(k, F.lit(0.0))))
        return F.when(at_once | after, k.cast("long"))

    def step(found: Column, t: Column) -> Column:
        return F.when(found.isNotNull(), found).otherwise(F.transform(F.array(pair(seed, index, t)), tried)[0])

    return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES)), F.lit(None).cast("long"), step)
