"""Vector kernels as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vector(values) -> Column:
    """A literal vector, folded once by the optimizer."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def whole_numbers(values) -> Column:
    """A literal array of whole numbers."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<long>")


def matrix(rows) -> Column:
    return F.array(*[vector(r) for r in rows])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(squared_distance(x, y))


def argmin(values: Column) -> Column:
    """Position of the first least value, from 0; -1 if there is none. NaN never wins over a number."""
    return let(values, lambda v: (F.array_position(v, F.array_min(v)) - 1).cast("int"))


def argmax(values: Column) -> Column:
    """Position of the first largest value, from 0; NaN counts as the largest."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def memberships(d: Column, m: float = 1.1) -> Column:
    """Fuzzy memberships, raised to m, from the distances to all centres: relative to the least distance, so that
    no power overflows. A distance of zero has NaN, the others beside it 0."""
    e = F.lit(2.0 / (m - 1.0))

    def of(b: Column) -> Column:
        whole = total(F.transform(b["d"], lambda a: F.pow(b["least"] / a, e)))
        each = let(whole, lambda s: F.transform(b["d"], lambda a: F.pow(F.lit(1.0) / (F.pow(a / b["least"], e) * s), F.lit(m))))
        return F.when(b["least"] == 0, F.transform(b["d"], lambda a: F.when(a == 0, F.lit(float("nan"))).otherwise(0.0))).otherwise(each)

    return let(d, lambda d: let(F.struct(d.alias("d"), F.array_min(d).alias("least")), of))


def log_density(x: Column, mean, variance) -> Column:
    """Log density of a normal distribution with a diagonal covariance."""
    import math

    const = -0.5 * (len(mean) * math.log(2 * math.pi) + sum(math.log(v) if v > 0 else float("nan") for v in variance))
    terms = F.zip_with(F.zip_with(x, vector(mean), lambda a, b: (a - b) * (a - b)), vector(variance), lambda a, v: a / v)
    return F.lit(const) - F.lit(0.5) * total(terms)


def log_sum_exp(values: Column) -> Column:
    return let(values, lambda v: let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda a: F.exp(a - top))))))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def safe_log(v: Column) -> Column:
    """Natural logarithm with minus infinity at 0."""
    return F.when(v == 0, F.lit(float("-inf"))).otherwise(F.log(v))


def log_loss(p: Column, y: Column) -> Column:
    """Unclipped."""
    left = F.when(y == 0, F.lit(0.0)).otherwise(y * safe_log(p))
    right = F.when(y == 1, F.lit(0.0)).otherwise((F.lit(1.0) - y) * safe_log(F.lit(1.0) - p))
    return -(left + right)


def times_matrix(x: Column, columns) -> Column:
    """Row vector times a matrix that is given by its columns."""
    return F.transform(matrix(columns), lambda c: dot(x, c))
