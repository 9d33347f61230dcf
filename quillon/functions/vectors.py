"""Vector functions over array columns, computed in double precision inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once: within a function over an array, an expression is worked out for each element."""
    return F.transform(F.array(value), f)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v over sqrt(max(sum of squares, 1e-12))."""
    return bind(F.sqrt(F.greatest(dot(v, v), F.lit(1e-12))), lambda scale: F.transform(v, lambda x: x.cast("double") / scale))


def truncate(v: Column, dim: int) -> Column:
    """The first dim components, normalised again; dim outside (0, length) keeps all."""
    return l2_normalize(F.when((F.lit(dim) > 0) & (F.lit(dim) < F.size(v)), F.slice(v, 1, dim)).otherwise(v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def softmax(v: Column) -> Column:
    powers = bind(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x.cast("double") - top)))
    return bind(powers, lambda e: bind(total(e), lambda s: F.transform(e, lambda x: x / s)))


def mean(v: Column) -> Column:
    return total(F.transform(v, lambda x: x.cast("double"))) / F.size(v)


def layer_norm(v: Column, weight: float = 1.0, bias: float = 0.0, eps: float = 1e-5) -> Column:
    centred = bind(mean(v), lambda m: F.transform(v, lambda x: x.cast("double") - m))
    return bind(centred, lambda c: bind(F.sqrt(dot(c, c) / F.size(c) + eps), lambda d: F.transform(c, lambda x: x / d * weight + bias)))


def rms_norm(v: Column, weight: float = 1.0, eps: float = 1e-6) -> Column:
    return bind(F.sqrt(dot(v, v) / F.size(v) + eps), lambda d: F.transform(v, lambda x: x.cast("double") / d * weight))


def linear(v: Column, rows: Column, bias: Column | None = None) -> Column:
    """rows: the weight matrix as an array of arrays."""
    y = F.transform(rows, lambda r: dot(r, v))
    return y if bias is None else F.zip_with(y, bias, lambda a, b: a + b)


def gelu_tanh(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x)))


#: Coefficients of the error function's series, 2 / sqrt(pi) (-1)^k / (k! (2 k + 1)).
_SERIES = [2 / math.sqrt(math.pi) * (-1) ** k / (math.factorial(k) * (2 * k + 1)) for k in range(50)]


def erf(x: Column) -> Column:
    """The error function: its series up to 3, beyond which it is 1 to within 2.3e-5 and its sign is taken."""
    square, total_ = x * x, F.lit(_SERIES[-1])
    for c in reversed(_SERIES[:-1]):
        total_ = total_ * square + c
    return F.when(F.abs(x) < 3, x * total_).otherwise(F.signum(x))


def gelu_erf(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x * 0.7071067811865476))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def relu6(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(6.0))


def hard_swish(x: Column) -> Column:
    return x * relu6(x + 3) / 6


def length_bucket(n: Column) -> Column:
    """n rounded up to a power of two from 8 to 512; longer ones stay."""
    out = n
    for p in (512, 256, 128, 64, 32, 16, 8):
        out = F.when(n <= p, F.lit(p)).otherwise(out)
    return out


def relative_bucket(delta: Column, buckets: int = 32, max_distance: int = 128) -> Column:
    """Half of the buckets for each sign; small distances have their own, larger ones share by logarithm."""
    half, exact = buckets // 2, buckets // 4
    n = F.abs(delta)
    far = exact + F.floor(F.log(n / float(exact)) / F.log(F.lit(max_distance / exact)) * (half - exact))
    return F.when(delta > 0, F.lit(half)).otherwise(F.lit(0)) + F.when(n < exact, n).otherwise(F.least(far, F.lit(half - 1)))


def quantize_blocks(v: Column, width: int = 32) -> Column:
    """Blocks of width components as (scale, q): whole numbers of eight bits, times the scale about what they were."""

    def one(b: Column) -> Column:
        whole = lambda part, scale: F.transform(part, lambda x: F.when(scale == 0, 0).otherwise(F.round(x / scale)).cast("int"))
        part = F.transform(F.slice(v, b * width + 1, width), lambda x: x.cast("double"))
        return bind(part, lambda p: bind(F.array_max(F.transform(p, lambda x: F.abs(x))) / 127, lambda s: F.struct(s.alias("scale"), whole(p, s).alias("q"))))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) + width - 1) / width).cast("int") - 1), one)


def classifier(first: Column, weights: Column, bias: Column, out: Column, out_bias: float) -> Column:
    """A score of a first token's vector: a dense layer, tanh, layer norm, and an output row."""
    hidden = F.transform(linear(first, weights, bias), F.tanh)
    return dot(layer_norm(hidden), out) + out_bias
