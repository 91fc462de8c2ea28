"""Elementwise operations with IEEE rules: columns in, a column out, all within whole-stage code generation.

NULL propagates.  Where Spark differs from IEEE (division by zero, logarithms, comparisons and extremes with nan) the
expressions restore the IEEE result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import draws

NAN, INF = float("nan"), float("inf")


def _d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _nan(x: Column) -> Column:
    """Whether a number is nan; the numbers themselves keep their types, so longs are compared as longs."""
    return F.isnan(x.cast("double"))


def add(a: Column, b: Column) -> Column:
    return a + b


def sub(a: Column, b: Column) -> Column:
    return a - b


def mul(a: Column, b: Column) -> Column:
    return a * b


def div(a: Column, b: Column) -> Column:
    a, b = _d(a), _d(b)
    below = b.cast("string") == "-0.0"  # other functions take both zeros for 0.0
    zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when((a > 0) != below, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def pow_(a: Column, b: Column | float) -> Column:
    return F.pow(a, b)


def _log(f, x: Column) -> Column:  # noqa: ANN001
    x = _d(x)
    return F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(f(x))


def log(x: Column) -> Column:
    return _log(F.ln, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


#: One-argument functions whose Spark form already follows IEEE.
exp, sqrt, sin, cos, tan, arcsin, arccos, arctan, sinh, cosh, tanh = F.exp, F.sqrt, F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.sinh, F.cosh, F.tanh


def neg(x: Column) -> Column:
    return -x


def abs_(x: Column) -> Column:
    return F.abs(x)


def round_(x: Column) -> Column:
    """Half away from zero."""
    return F.round(x)


def _cut(x: Column) -> tuple[Column, Column]:
    """Whether x is whole because of its size, or not finite; and x without its fraction.  Both keep the type of x."""
    large = F.lit(1 << 53)
    return (x >= large) | (x <= -large), x - x % F.lit(1)


def floor(x: Column) -> Column:
    large, t = _cut(x)
    return F.when(large, x).otherwise(F.when(t > x, t - 1).otherwise(t))


def ceil(x: Column) -> Column:
    large, t = _cut(x)
    return F.when(large, x).otherwise(F.when(t < x, t + 1).otherwise(t))


def sign(x: Column) -> Column:
    x = _d(x)
    return F.when(F.isnan(x), 0.0).otherwise(F.signum(x + 0.0))


def maximum(a: Column, b: Column) -> Column:
    """The number where one side is nan."""
    return F.when(_nan(a), b).when(_nan(b), a).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)))


def minimum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds without a fraction keep the type of whole numbers."""
    lo, hi = (F.lit(int(z) if float(z).is_integer() and abs(z) < 2**63 else float(z)) for z in (low, high))
    return F.when(_nan(x) | x.isNull(), x).otherwise(F.greatest(F.least(x, hi), lo))


def equal(a: Column, b: Column) -> Column:
    return (a == b) & ~_nan(a)


def not_equal(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def greater(a: Column, b: Column) -> Column:
    return (a > b) & ~_nan(a)


def greater_equal(a: Column, b: Column) -> Column:
    return (a >= b) & ~_nan(a) & ~_nan(b)


def less(a: Column, b: Column) -> Column:
    return greater(b, a)


def less_equal(a: Column, b: Column) -> Column:
    return greater_equal(b, a)


def logical_and(a: Column, b: Column) -> Column:
    return a & b


def logical_or(a: Column, b: Column) -> Column:
    return a | b


def logical_xor(a: Column, b: Column) -> Column:
    return a != b


def logical_not(a: Column) -> Column:
    return ~a


def bitwise_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bitwise_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bitwise_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def astype(x: Column, to: str) -> Column:
    """Truncates towards zero from float to integer; null for what the type cannot hold, nan and infinities among it."""
    return x.try_cast(to)


def where(condition: Column, x: Column, y: Column) -> Column:
    return F.when(condition, x).otherwise(y)


def replace_where(x: Column, predicate: Column, value: Column | float) -> Column:
    return F.when(predicate, value).otherwise(x)


def replace(x: Column, old: float, new: float) -> Column:
    return F.when(equal(x, F.lit(old)), F.lit(new)).otherwise(x)


def dropout(x: Column, rate: float, seed: int, index: Column | None = None) -> Column:
    """0 by the chance `rate`, else scaled so that the mean stays; for training only.  With an index the outcome depends on seed and index alone."""
    drawn = F.rand(seed) if index is None else draws.uniform(seed, index)
    return F.when(drawn > rate, x / F.lit(1.0 - rate)).otherwise(F.lit(0.0)) if rate < 1 else F.lit(0.0)


# complex numbers: struct<re: double, im: double>


def complex_(re: Column, im: Column) -> Column:
    return F.struct(_d(re).alias("re"), _d(im).alias("im"))


def real(c: Column) -> Column:
    return c["re"]


def imag(c: Column) -> Column:
    return c["im"]


def conj(c: Column) -> Column:
    return complex_(c["re"], -c["im"])


def angle(c: Column) -> Column:
    return F.atan2(c["im"], c["re"])


def magnitude(c: Column) -> Column:
    return F.hypot(c["re"], c["im"])


def complex_add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def complex_sub(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def complex_div(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_(div(a["re"] * b["re"] + a["im"] * b["im"], size), div(a["im"] * b["re"] - a["re"] * b["im"], size))


def complex_mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


# activations


def relu(x: Column) -> Column:
    x = _d(x)
    return F.when((x > 0) & ~F.isnan(x), x).otherwise(F.lit(0.0))


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    x = _d(x)
    return F.when(x > 0, x).otherwise(F.lit(alpha) * x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-_d(x)))


def softplus(x: Column) -> Column:
    """ln(1 + e^x), in the form that does not overflow."""
    x = _d(x)
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def polyval(coefficients: list[float], x: Column) -> Column:
    """Horner's rule, highest power first; 0 without coefficients."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out
