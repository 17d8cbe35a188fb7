"""Rounding, ratios, scales and order-preserving value buckets."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

_WIDE = "decimal(38,6)"
_PER_LAKH = Decimal("0.00001")
_CENT = Decimal("0.01")

# Value buckets: amounts below 2**_BITS cents have a bucket each, larger ones share
# one with those that agree in their leading bits; the cut moves in steps of _STEP.
_BITS = 17
_STEP = 6
_LONG_BITS = 63


def half_up(c: Column, digits: int) -> Column:
    """Round half away from zero through DECIMAL, so that 1.005 gives 1.01."""
    return F.round(c.cast(_WIDE), digits).cast("double")


def exact(c: Column, digits: int) -> Column:
    """As :func:`half_up` but stays DECIMAL, for comparisons with a threshold."""
    return F.round(c.cast(_WIDE), digits)


def as_double(c: Column) -> Column:
    return c.cast("double")


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as DOUBLE, NULL when ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double") * 100.0, b.cast("double"))


def lakhs_exact(c: Column, digits: int = 2) -> Column:
    """Amount in units of 100,000, DECIMAL all the way."""
    return F.round(c.cast("decimal(28,2)") * F.lit(_PER_LAKH), digits)


def lakhs(c: Column, digits: int = 2) -> Column:
    return lakhs_exact(c, digits).cast("double")


def cents(amount: Column) -> Column:
    return (amount * 100).cast("bigint")


def whole_cents(x: Column) -> Column:
    """A DOUBLE with two decimals as BIGINT cents (or percent)."""
    return F.rint(x * 100.0).cast("bigint")


def percent_of(amount_cents: Column, pct: Column | int) -> Column:
    """Part of an amount in cents (not negative), rounded half up, in BIGINT."""
    return F.call_function("div", amount_cents * pct + 50, F.lit(100))


def from_cents(c: Column) -> Column:
    """BIGINT cents as money. Keeping line arithmetic in cents until here avoids
    a wide DECIMAL per step, which costs several times as much per row."""
    return (c.cast("decimal(18,0)") * F.lit(_CENT)).cast("decimal(18,2)")


def value_bucket(amount: Column) -> Column:
    """Order-preserving bucket of a money amount: ``a <= b`` implies
    ``value_bucket(a) <= value_bucket(b)``.

    Integer arithmetic on the cents (leading bits plus their position), so every
    executor computes the same bucket. At least 11 leading bits count, so a bucket
    spans less than a thousandth of its amount; there are at most about a million
    buckets, whatever the data.
    """
    v = cents(amount)
    magnitude = F.abs(v)

    def key(shift: int) -> Column:
        # a multiple of 2**(_BITS + 1) keeps the ranges of two shifts apart
        return (F.shiftright(magnitude, shift) + shift * 2 ** (_BITS + 1)).cast("int")

    shifts = list(range(0, _LONG_BITS - _BITS + _STEP, _STEP))
    bucket = F.when(magnitude < 2**_BITS, key(0))
    for s in shifts[1:-1]:
        bucket = bucket.when(magnitude < 2 ** (_BITS + s), key(s))
    bucket = bucket.otherwise(key(shifts[-1]))
    return F.when(v < 0, -bucket - 1).otherwise(bucket)


def band(c: Column, edges: tuple, scores: tuple) -> Column:
    """Right-closed bands; NULL outside them. A last edge of None is no bound."""
    out = F.lit(None).cast("int")
    for low, high, score in reversed(list(zip(edges, edges[1:], scores))):
        inside = c > low if high is None else (c > low) & (c <= high)
        out = F.when(inside, F.lit(score)).otherwise(out)
    return out
