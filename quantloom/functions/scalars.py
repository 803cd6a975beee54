"""Scalar expressions: calendar arithmetic, finance formulas, normal law, hashed uniforms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BUSINESS_EPOCH
from .windows import col

# ---------------------------------------------------------------- calendar


def is_business_day(d) -> Column:
    return F.weekday(col(d)) < 5


def business_day_index(d) -> Column:
    """Ordinal of a weekday, so row distances are integer differences (no global window)."""
    days = F.date_diff(col(d), F.lit(BUSINESS_EPOCH).cast("date"))
    return F.floor(days / 7).cast("int") * 5 + F.weekday(col(d))


def month_start(d) -> Column:
    return F.trunc(col(d), "MM")


def week_end_sunday(d) -> Column:
    return F.next_day(F.date_sub(col(d), 1), "Sun")


# ---------------------------------------------------------------- cleaning


def finite(x) -> Column:
    """NaN and infinities become NULL."""
    c = col(x).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clip(x, lower=None, upper=None) -> Column:
    c = col(x)
    if lower is not None:
        c = F.greatest(c, lower if isinstance(lower, Column) else F.lit(float(lower)))
    if upper is not None:
        c = F.least(c, upper if isinstance(upper, Column) else F.lit(float(upper)))
    return c


def smooth_abs(x, eps: float = 1e-8) -> Column:
    return F.sqrt(col(x) * col(x) + F.lit(eps))


def smooth_sign(x, eps: float = 1e-8) -> Column:
    return col(x) / smooth_abs(x, eps)


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def logit(x, eps: float = 1e-9) -> Column:
    p = clip(x, eps, 1.0 - eps)
    return F.ln(p / (F.lit(1.0) - p))


def correlation(a, b) -> Column:
    """Pearson correlation aggregate; NULL (not an error) when a side has no variance."""
    x, y = col(a), col(b)
    both = x.isNotNull() & y.isNotNull()
    sd = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.covar_pop(x, y) / F.nullif(sd, F.lit(0.0))


# ---------------------------------------------------------------- finance


def bond_price(ytm, coupon_rate, years) -> Column:
    """Annual-coupon price per 100 face; 100 where yield or term is not positive."""
    y, n = col(ytm), col(years)
    discount = F.pow(F.lit(1.0) + y, -n)
    price = F.lit(100.0) * col(coupon_rate) * (F.lit(1.0) - discount) / y + F.lit(100.0) * discount
    return F.when((y <= 0) | (n <= 0), F.lit(100.0)).otherwise(price)


def inverse_rate(x) -> Column:
    return F.lit(1.0) / F.nullif(col(x), F.lit(0.0))


# ---------------------------------------------------------------- normal law
#
# Spark has no normal law built in.  Published rational approximations (double precision)
# keep both functions inside generated JVM code.

# Coefficients of Hart's approximation, highest power first.
CDF_NUM = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
           112.079291497871, 221.213596169931, 220.206867912376]
CDF_DEN = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
           296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]

# Coefficients of Wichura's AS 241 (PPND16), highest power first.
PPF_MID_NUM = [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
               13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080]
PPF_MID_DEN = [5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
               5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0]
PPF_NEAR_NUM = [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
                3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734]
PPF_NEAR_DEN = [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
                0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0]
PPF_FAR_NUM = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
               0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772]
PPF_FAR_DEN = [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
               0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0]


def polynomial(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def normal_cdf(x) -> Column:
    """Standard normal distribution function."""
    c = col(x)
    z = F.abs(c)
    density = F.exp(-z * z / F.lit(2.0))
    near = density * polynomial(z, CDF_NUM) / polynomial(z, CDF_DEN)
    tail = z + F.lit(1.0) / (z + F.lit(2.0) / (z + F.lit(3.0) / (z + F.lit(4.0) / (z + F.lit(0.65)))))
    upper = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(density / tail / F.lit(2.506628274631))
    return F.when(c > 0, F.lit(1.0) - upper).otherwise(upper)


def normal_quantile(p) -> Column:
    """Standard normal quantile; NULL outside (0, 1)."""
    c = col(p)
    q = c - F.lit(0.5)
    mid = F.lit(0.180625) - q * q
    r = F.sqrt(-F.ln(F.least(c, F.lit(1.0) - c)))
    near = polynomial(r - F.lit(1.6), PPF_NEAR_NUM) / polynomial(r - F.lit(1.6), PPF_NEAR_DEN)
    far = polynomial(r - F.lit(5.0), PPF_FAR_NUM) / polynomial(r - F.lit(5.0), PPF_FAR_DEN)
    tail = F.signum(q) * F.when(r <= 5.0, near).otherwise(far)
    value = F.when(F.abs(q) <= 0.425, q * polynomial(mid, PPF_MID_NUM) / polynomial(mid, PPF_MID_DEN)).otherwise(tail)
    return F.when((c > 0) & (c < 1), value)


# ---------------------------------------------------------------- hashed uniforms
#
# A counter-based generator: x -> x^5 is a bijection modulo the prime 2^31 - 1, and all
# products stay below 2^62, so the same integers come out of JVM columns, of NumPy inside a
# task and of plain SQL.  A draw depends only on its coordinates, so retried tasks and any
# partitioning give the same result.

PRIME = 2147483647


def _mix(x: Column, then) -> Column:
    """``then(x^5 mod p)``; the one-element transform names x once, so nesting stays small."""

    def power(v):
        square = v * v % F.lit(PRIME)
        return then(square * square % F.lit(PRIME) * v % F.lit(PRIME))

    return F.get(F.transform(F.array(x), power), F.lit(0))


def hash_uniform(seed: int, stream: int, major, minor) -> Column:
    """Uniform in (0, 1) for coordinates (major, minor); both non-negative integers < 2^31."""
    p = F.lit(PRIME)
    base = (F.lit((seed * 1000003 + stream * 7919 + 12345) % PRIME) + col(major).cast("long") * 69621) % p
    mixed = _mix(base, lambda v: (v + col(minor).cast("long") * 48271 + 1) % p)
    last = _mix(mixed, lambda v: (v + F.lit(104729)) % p)
    return _mix(last, lambda v: (v.cast("double") + 0.5) / F.lit(float(PRIME)))


def hash_uniform_np(seed: int, stream: int, major, minor) -> np.ndarray:
    """NumPy twin of :func:`hash_uniform` for use inside tasks."""
    p = np.int64(PRIME)

    def fifth(x):
        square = x * x % p
        return square * square % p * x % p

    major = np.asarray(major, dtype=np.int64)
    minor = np.asarray(minor, dtype=np.int64)
    base = (np.int64((seed * 1000003 + stream * 7919 + 12345) % PRIME) + major * 69621) % p
    mixed = (fifth(base) + minor * 48271 + 1) % p
    return (fifth((fifth(mixed) + 104729) % p).astype(np.float64) + 0.5) / float(PRIME)


def box_muller(u1: Column, u2: Column) -> Column:
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(6.283185307179586) * u2)
