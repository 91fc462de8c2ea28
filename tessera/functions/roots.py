"""Roots of polynomials by simultaneous iteration, within the row of Spark."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps at most; a simple root takes about ten.
STEPS = 80


def _z(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _times(a: Column, b: Column) -> tuple[Column, Column]:
    return a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"]


def _let(value: Column, f) -> Column:  # noqa: ANN001
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def _over(a: Column, b: Column) -> Column:
    """a / b of complex numbers; 0 where b is 0."""
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return F.when(size == 0, _z(F.lit(0.0), F.lit(0.0))).otherwise(_z((a["re"] * b["re"] + a["im"] * b["im"]) / size, (a["im"] * b["re"] - a["re"] * b["im"]) / size))


def _value(c: Column, z: Column) -> Column:
    """p(z) and its derivative by Horner's rule, c the coefficients, highest power first."""
    zero = F.lit(0.0)
    start = F.struct(_z(zero, zero).alias("p"), _z(zero, zero).alias("d"))

    def step(s: Column, x: Column) -> Column:
        p, d = _times(s["p"], z), _times(s["d"], z)
        return F.struct(_z(p[0] + x, p[1]).alias("p"), _z(d[0] + s["p"]["re"], d[1] + s["p"]["im"]).alias("d"))

    return F.aggregate(c, start, step)


def _of_two(c: Column) -> Column:
    """The roots of x^2 + b x + c by their formula, the one of larger size first where they are real."""
    b, last = c[1], c[2]

    def of(d: Column) -> Column:
        side = F.sqrt(F.abs(d))
        far = (b + F.when(b < 0, -side).otherwise(side)) / -2
        real = _let(far, lambda q: F.array(_z(q, F.lit(0.0)), _z(F.when(q == 0, 0.0).otherwise(last / q), F.lit(0.0))))
        return F.when(d >= 0, real).otherwise(F.array(_z(b / -2, side / 2), _z(b / -2, side / -2)))

    return _let(b * b - 4 * last, of)


def complex_roots(a: Column) -> Column:
    """All roots, as an array of (re, im), by falling real and then imaginary part; repeated ones as often as they count.

    The method is Aberth's: each estimate takes Newton's step, corrected by its distances to the others, until none moves.  Parts below 1e-9 of the
    size of a root are 0.  The two roots of a square start from their formula.  A constant has no roots, null and null coefficients give null, and a leading coefficient of 0 raises.
    """
    a = a.cast("array<double>")
    lead = F.get(a, F.lit(0))
    c = F.transform(a, lambda x: x / lead)
    n = F.size(a) - 1
    # no root lies further out than twice this
    radius = F.aggregate(F.transform(c, lambda x, k: F.when(k > 0, F.pow(F.abs(x), 1 / F.greatest(k, F.lit(1)))).otherwise(0.0)), F.lit(1e-300), lambda s, x: F.greatest(s, x))

    def iterated(given: Column) -> Column:
        own = given["c"]
        start = F.transform(F.sequence(F.lit(1), given["n"]), lambda k: _let(2 * math.pi * k / given["n"] + 0.4, lambda t: _z(given["r"] * F.cos(t), given["r"] * F.sin(t))))

        def moved(s: Column) -> Column:
            def one(z: Column, i: Column) -> Column:
                def others(w: Column) -> Column:
                    zero = F.lit(0.0)
                    push = F.aggregate(F.transform(s["z"], lambda y, j: F.when(i == j, _z(zero, zero)).otherwise(_over(_z(F.lit(1.0), zero), _z(z["re"] - y["re"], z["im"] - y["im"])))), _z(zero, zero), lambda t, y: _z(t["re"] + y["re"], t["im"] + y["im"]))
                    return _let(push, lambda q: _over(w, _z(1 - _times(w, q)[0], -_times(w, q)[1])))

                return _let(_let(_let(_value(own, z), lambda v: _over(v["p"], v["d"])), others), lambda w: F.struct((z["re"] - w["re"]).alias("re"), (z["im"] - w["im"]).alias("im"), (F.hypot(w["re"], w["im"]) / F.greatest(F.hypot(z["re"], z["im"]), F.lit(1e-300))).alias("by")))

            new = F.transform(s["z"], one)
            return _let(new, lambda x: F.struct(F.transform(x, lambda y: _z(y["re"], y["im"])).alias("z"), F.array_max(F.transform(x, lambda y: y["by"])).alias("by")))

        # two roots start from their formula, if it stays within range, and take a step or two
        square = F.abs(own[1]) < 1e150
        start = F.when((given["n"] == 2) & square & (F.abs(own[2]) < 1e300), _of_two(own)).otherwise(start)
        state = F.struct(start.alias("z"), F.lit(1.0).alias("by"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, lambda s, _: F.when(s["by"] < 1e-15, s).otherwise(moved(s)))["z"]

    found = _let(F.struct(c.alias("c"), n.alias("n"), radius.alias("r")), iterated)
    small = lambda x, size: F.when(F.abs(x) <= 1e-9 * size, 0.0).otherwise(x)
    clean = F.transform(found, lambda z: _let(F.hypot(z["re"], z["im"]), lambda s: _z(small(z["re"], s), small(z["im"], s))))
    # real parts that differ by rounding alone are one, so that pairs come in order
    scaled = lambda zs: _let(F.aggregate(zs, F.lit(1e-300), lambda s, z: F.greatest(s, F.abs(z["re"]))), lambda top: F.transform(zs, lambda z: F.struct(F.round(z["re"] / top * 1e9).alias("k"), z["im"].alias("im"), z["re"].alias("re"))))
    ordered = F.transform(F.reverse(F.array_sort(_let(clean, scaled))), lambda z: _z(z["re"], z["im"]))
    none = F.array().cast("array<struct<re:double,im:double>>")
    return F.when(a.isNull() | F.exists(a, lambda x: x.isNull()), F.lit(None).cast("array<struct<re:double,im:double>>")).when(F.size(a) == 0, none).when(
        lead == 0, F.raise_error(F.lit("SingularMatrix: leading coefficient is 0")).cast("array<struct<re:double,im:double>>")
    ).when(n < 1, none).otherwise(ordered)


def roots(a: Column) -> Column:
    """The real roots, largest first."""
    return F.transform(F.filter(complex_roots(a), lambda z: z["im"] == 0), lambda z: z["re"])
