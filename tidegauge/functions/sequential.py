"""Anytime-valid evidence on the driver: mixture e-processes and their confidence sequences, and the asymptotic boundary."""

from __future__ import annotations

import math

from . import distributions as dist


def count_boundary(n: float, alpha: float, rho: float, directional: bool = False) -> float:
    lam = 1 / (rho * rho)
    return (1 + lam / n) * (math.log1p(n / lam) - 2 * math.log(2 * alpha if directional else alpha))


def best_rho(n: float, alpha: float) -> float:
    """The rho at which the boundary is lowest at n units."""
    grid = [10 ** (-4 + 4 * i / 400) for i in range(401)]
    return min(grid, key=lambda r: count_boundary(n, alpha, r))


def asymptotic_set(diff: float, se: float, n: float, alpha: float, rho: float) -> tuple[float, float]:
    half = se * math.sqrt(count_boundary(n, alpha, rho))
    return diff - half, diff + half


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def bernoulli_log_e(successes: int, n: int, null: float, a: float = 1.0, b: float = 1.0) -> float:
    """Log of the beta-mixture likelihood ratio against a rate."""
    if null in (0.0, 1.0):
        possible = successes == (0 if null == 0.0 else n)
        return (_log_beta(a + successes, b + n - successes) - _log_beta(a, b)) if possible else math.inf
    return _log_beta(a + successes, b + n - successes) - _log_beta(a, b) - successes * math.log(null) - (n - successes) * math.log1p(-null)


def bernoulli_sequence(successes: int, n: int, alpha: float = 0.05, a: float = 1.0, b: float = 1.0) -> tuple[float, float]:
    """Rates whose log e-value stays under -log alpha."""
    limit, peak = -math.log(alpha), successes / n if n else 0.5
    low = 0.0 if successes == 0 else dist.solve(lambda p: limit - bernoulli_log_e(successes, n, p, a, b), 1e-12, peak)
    high = 1.0 if successes == n else dist.solve(lambda p: bernoulli_log_e(successes, n, p, a, b) - limit, peak, 1 - 1e-12)
    return low, high


def gaussian_log_e(mean: float, variance: float, n: int, null: float, prior_var: float) -> float:
    """Log of the normal-mixture likelihood ratio for a known variance."""
    s = variance / n
    return -0.5 * math.log1p(prior_var / s) + 0.5 * (mean - null) ** 2 * (1 / s - 1 / (s + prior_var))


def gaussian_sequence(mean: float, variance: float, n: int, prior_var: float, alpha: float = 0.05) -> tuple[float, float]:
    s = variance / n
    half = math.sqrt(2 * (-math.log(alpha) + 0.5 * math.log1p(prior_var / s)) / (1 / s - 1 / (s + prior_var)))
    return mean - half, mean + half


class Checkpoints:
    """Registered looks at one metric: looks come in order, data only grows, and what a look decided stays decided."""

    def __init__(self, alpha: float, rho: float):
        self.alpha, self.rho, self.looks = alpha, rho, []

    def look(self, at: str, n: int, diff: float, se: float) -> dict:
        from ..errors import EngineError

        if self.looks and (at <= self.looks[-1]["at"] or n < self.looks[-1]["n"]):
            raise EngineError("sequential.order", f"look {at!r} with {n} units", at=at, n=n)
        lb, ub = asymptotic_set(diff, se, n, self.alpha, self.rho)
        if self.looks:  # intersecting the looks keeps the guarantee
            lb, ub = max(lb, self.looks[-1]["lb"]), min(ub, self.looks[-1]["ub"])
        decided = self.looks[-1]["decided"] if self.looks else None
        row = {"at": at, "n": n, "diff": diff, "lb": lb, "ub": ub, "decided": decided or ("better" if lb > 0 else "worse" if ub < 0 else None)}
        self.looks.append(row)
        return row


def predeclared(y: float, x: float, beta: float, centre: float) -> float:
    """An outcome adjusted by a slope and a centre fixed before the data."""
    return y - beta * (x - centre)
