"""Distribution functions on the driver, from the standard library and NumPy alone.

Normal, Student t, chi-square, F, beta and binomial tails and quantiles, and the noncentral t: regularised incomplete
gamma and beta functions by series and Lentz continued fractions, quantiles by bracketing and bisection on the tail.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

_NORMAL = NormalDist()
_TINY = 1e-300


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def norm_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _NORMAL.inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    return 1 - _gamma_fraction(a, x) * front


def gamma_q(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    if x < a + 1:
        return 1 - gamma_p(a, x)
    return _gamma_fraction(a, x) * math.exp(a * math.log(x) - x - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, x) / a)
    return max(0.0, 1 - front * _beta_fraction(b, a, 1 - x) / b)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 100_000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + an * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + an / c
            c = c if abs(c) > _TINY else _TINY
            step = d * c
            h *= step
        if abs(step - 1) < 1e-16:
            break
    return h


def solve(f: Callable[[float], float], low: float, high: float, steps: int = 200) -> float:
    """Root of an increasing function by bisection."""
    for _ in range(steps):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if f(mid) < 0:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def t_sf(t: float, df: float) -> float:
    if math.isinf(df):
        return norm_sf(t)
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_ppf(p: float, df: float) -> float:
    if math.isinf(df):
        return norm_ppf(p)
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1 - p, df)
    high = 1.0
    while t_sf(high, df) > 1 - p and high < 1e300:
        high *= 2
    return solve(lambda t: (1 - p) - t_sf(t, df), 0.0, high)


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def chi2_ppf(p: float, df: float) -> float:
    high = df + 10
    while chi2_sf(high, df) > 1 - p:
        high *= 2
    return solve(lambda x: (1 - p) - chi2_sf(x, df), 0.0, high)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def beta_ppf(p: float, a: float, b: float) -> float:
    return solve(lambda x: beta_i(a, b, x) - p, 0.0, 1.0)


def binom_sf(k: int, n: int, p: float) -> float:
    """P(X > k)."""
    return 1.0 if k < 0 else 0.0 if k >= n else beta_i(k + 1, n - k, p)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    return (0.0 if k == 0 else beta_ppf(alpha / 2, k, n - k + 1)), (1.0 if k == n else beta_ppf(1 - alpha / 2, k + 1, n - k))


def noncentral_t_cdf(t: float, df: float, delta: float) -> float:
    """P(T <= t) of a noncentral t by quadrature over the chi distribution's quantiles."""
    if math.isinf(df) or df > 1e6:
        return norm_cdf(t - delta)
    # E over S = sqrt(chi2_df / df) of Phi(t S - delta), Simpson on a wide range of S
    spread = 1 / math.sqrt(2 * df)
    low, high, n = max(1e-9, 1 - 12 * spread), 1 + 12 * spread + 4 / df, 2000
    log_c = math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2)
    h = (high - low) / n
    total = 0.0
    for i in range(n + 1):
        s = low + i * h
        w = 1 if i in (0, n) else 4 if i % 2 else 2
        total += w * math.exp(log_c + (df - 1) * math.log(s) - df * s * s / 2) * norm_cdf(t * s - delta)
    return min(1.0, total * h / 3)
