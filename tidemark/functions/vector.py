"""Vector functions as Catalyst expressions.  Sums are in double precision, stored values in float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v over its norm, in double; null where the norm is zero."""
    return let(norm(v), lambda size: F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the dot product; unit vectors are assumed."""
    return F.lit(1.0) - dot(a, b)


def _float(x: Column) -> Column:
    return x.cast("float")


def quantize_int8(v: Column) -> Column:
    """struct(scale float, q array<tinyint>): the largest magnitude becomes 127; halves round away from zero.

    Every intermediate is a float, as in single precision arithmetic.  A vector of zeros has scale 1.
    """
    most = F.array_max(F.transform(v, lambda x: F.abs(x)))
    scale = F.when(most > 0, _float(most / F.lit(127.0))).otherwise(_float(F.lit(1.0)))

    def quantized(scale: Column, inverse: Column) -> Column:
        def q(x: Column) -> Column:
            y = _float(x * inverse).cast("double")
            # ROUND of a double is half up by its decimal form, which is away from zero on both sides
            return F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(y, 0))).cast("tinyint")

        return F.struct(scale.alias("scale"), F.transform(v, q).alias("q"))

    return let(scale, lambda s: let(_float(F.lit(1.0) / s), lambda inverse: quantized(s, inverse)))


def dequantize_int8(z: Column) -> Column:
    return let(z, lambda own: F.transform(own["q"], lambda x: _float(x.cast("float") * own["scale"])))


def dot_int8(query: Column, z: Column) -> Column:
    """The scale times the dot product with the integers."""
    return z["scale"].cast("double") * dot(query, z["q"])


def float16(v: Column) -> Column:
    """Each element at the nearest half-precision value, ties to even, as a float."""

    def one(x: Column) -> Column:
        y = x.cast("double")
        exponent = F.floor(F.log2(F.abs(y))).cast("double")
        # log2 may land just beside a power of two: settle it by comparing
        exponent = F.when(F.pow(F.lit(2.0), exponent) > F.abs(y), exponent - 1).when(F.pow(F.lit(2.0), exponent + 1) <= F.abs(y), exponent + 1).otherwise(exponent)
        ulp = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-14.0)) - 10)
        return F.when(y == 0, x.cast("float")).otherwise((F.rint(y / ulp) * ulp).cast("float"))

    return F.transform(v, one)


def perturb(v: Column, i: Column) -> Column:
    """A query near v: element j moves by ((7j + i) mod 17 - 8) * 1e-5, then v is normalised again."""
    return unit(F.transform(v, lambda x, j: x.cast("double") + ((j.cast("long") * 7 + i.cast("long")) % 17 - 8).cast("double") * 1e-5))


def finite(v: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return ~F.exists(v, bad)
