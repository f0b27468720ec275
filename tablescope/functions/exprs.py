"""Null-, NaN- and ANSI-safe expression builders shared by the operators.

Means and standard deviations of exact numeric columns (integers, decimals) are
computed from exact decimal sums, so the result does not depend on the order
in which partitions are merged (a double sum does). Float columns use Spark's
own streaming ``avg`` / ``stddev_samp``.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import is_exact_numeric

#: Text codes that a cast to double would accept as numbers: Java type suffixes (1D, 2f) and hexadecimals.
CODE_PATTERN = r"[0-9.][dDfF]\s*$|[xX]"

# The characters Python's str.strip() removes (str.isspace()).
WHITESPACE_CLASS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EDGE_WHITESPACE = rf"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (ANSI-safe; no inf)."""
    return F.try_divide(num, den)


def pct(part: Column, whole: Column, digits: int | None = None) -> Column:
    """100 * part / whole, NULL when whole is 0; rounded half-up when ``digits`` is given."""
    v = safe_div(part.cast("double") * F.lit(100.0), whole.cast("double"))
    return F.round(v, digits) if digits is not None else v


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace (tabs and newlines too); NULL stays NULL."""
    return F.regexp_replace(c, EDGE_WHITESPACE, "")


def _exact(c: Column, dt: T.DataType) -> Column:
    if isinstance(dt, T.DecimalType):
        return c
    return c.cast(T.DecimalType(38, 0))


def sum_of(c: Column, dt: T.DataType) -> Column:
    """Sum that is 0 (not NULL) over no values, as pandas groupby sum."""
    return F.coalesce(F.sum(c), F.lit(0).cast(dt))


#: Bits of a limb: 2**40 rows of limbs add up inside a long.
LIMB = 21


def _as_long(c: Column, dt: T.DataType) -> tuple[Column, int] | None:
    """(the unscaled value as a long, its scale) of integers and short decimals."""
    if not isinstance(dt, T.DecimalType):
        return c.cast("long"), 0
    if dt.precision > 18 or dt.scale > 3:
        return None
    return (c * F.lit(Decimal(10 ** dt.scale)) if dt.scale else c).cast("long"), dt.scale


def _added(limbs: list[Column]) -> Column:
    """The exact sum of numbers given as limbs, lowest first; NULL outside DECIMAL(38)."""
    out = F.sum(limbs[0]).cast("decimal(38,0)")
    for k, limb in enumerate(limbs[1:], 1):
        out = F.try_add(out, F.try_multiply(F.sum(limb).cast("decimal(20,0)"), F.lit(Decimal(2 ** (LIMB * k)))).cast("decimal(38,0)")).cast("decimal(38,0)")
    return out


def _scaled(c: Column, scale: int) -> Column:
    return F.try_multiply(c, F.lit(Decimal(1).scaleb(-scale))).cast("double") if scale else c.cast("double")


def _limbs(x: Column) -> list[Column]:
    low = F.lit((1 << LIMB) - 1)
    return [x.bitwiseAND(low), F.shiftright(x, LIMB).bitwiseAND(low), F.shiftright(x, 2 * LIMB)]


def _square_limbs(x: Column) -> list[Column]:
    """The limbs of x * x, computed in longs without overflow."""
    c, b, a = _limbs(x)
    out, carry = [], None
    for t in (c * c, F.lit(2) * b * c, F.lit(2) * a * c + b * b, F.lit(2) * a * b, a * a):
        t = t if carry is None else t + carry
        out.append(t.bitwiseAND(F.lit((1 << LIMB) - 1)))
        carry = F.shiftright(t, LIMB)
    return [*out, carry]


def mean_of(c: Column, dt: T.DataType) -> Column:
    """Mean as double; exact numerics: exact sum / count (order independent), or
    Spark's average of doubles where the exact sum leaves DECIMAL(38)."""
    if is_exact_numeric(dt):
        whole = _as_long(c, dt)
        total = F.try_sum(_exact(c, dt)).cast("double") if whole is None else _scaled(_added(_limbs(whole[0])), whole[1])
        return F.coalesce(safe_div(total, F.count(c).cast("double")), F.avg(c.cast("double")))
    return F.avg(c)


def _all_of(terms: Column, n: Column) -> Column:
    """The exact sum of ``terms``, NULL when the sum or any of the ``n`` terms overflowed."""
    return F.when(F.count(terms) == n, F.try_sum(terms))


def std_of(c: Column, dt: T.DataType) -> Column:
    """Sample standard deviation (n-1), NULL for fewer than 2 values.

    Exact numerics: sqrt((n*sum(x^2) - sum(x)^2) / (n*(n-1))) with the numerator
    in exact decimal arithmetic; when any term or sum leaves DECIMAL(38), Spark's
    centred ``stddev_samp`` of the doubles.
    """
    if is_exact_numeric(dt):
        n, whole = F.count(c), _as_long(c, dt)
        if whole is None:
            x = _exact(c, dt)
            sx, sxx, scale = F.try_sum(x), _all_of(F.try_multiply(x, x), n), 0
        else:
            sx, sxx, scale = _added(_limbs(whole[0])), _added(_square_limbs(whole[0])), 2 * whole[1]
        num = F.try_subtract(F.try_multiply(n, sxx), F.try_multiply(sx, sx))
        den = (n * (n - F.lit(1))).cast("double")
        exact = F.sqrt(safe_div(_scaled(num, scale), den))
        return F.when(n < 2, F.lit(None).cast("double")).otherwise(
            F.coalesce(exact, F.stddev_samp(c.cast("double"))))
    return F.stddev_samp(c)


def corr_of(x: Column, y: Column, dx: T.DataType, dy: T.DataType) -> Column:
    """Pearson r over rows where both are present; NULL when either side is constant.

    Spark's ``corr`` raises under ANSI for a constant column (SURVEY D8); this form
    does not. Exact numerics use exact decimal co-moments; when any of those leaves
    DECIMAL(38), Spark's centred co-moments of the doubles.
    """
    both = x.isNotNull() & y.isNotNull()
    xp = F.when(both, x)
    yp = F.when(both, y)
    xd, yd = xp.cast("double"), yp.cast("double")
    centred = safe_div(F.covar_samp(xd, yd), F.stddev_samp(xd) * F.stddev_samp(yd))
    if is_exact_numeric(dx) and is_exact_numeric(dy):
        ex, ey = _exact(xp, dx), _exact(yp, dy)
        n = F.count(xp)
        sx, sy = F.try_sum(ex), F.try_sum(ey)

        def comoment(a, b, sa, sb):
            return F.try_subtract(F.try_multiply(n, _all_of(F.try_multiply(a, b), n)), F.try_multiply(sa, sb)).cast("double")
        cov, vx, vy = comoment(ex, ey, sx, sy), comoment(ex, ex, sx, sx), comoment(ey, ey, sy, sy)
        r = F.when(cov.isNull() | vx.isNull() | vy.isNull(), centred).otherwise(safe_div(cov, F.sqrt(vx) * F.sqrt(vy)))
        return F.when(n < 2, F.lit(None).cast("double")).otherwise(r)
    return centred
