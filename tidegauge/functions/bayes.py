"""Posteriors of an effect from an estimate and its error: normal, Student t and mixture priors."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from . import distributions as dist


@dataclass(frozen=True)
class Normal:
    mean: float
    sd: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return -0.5 * ((x - self.mean) / self.sd) ** 2 - math.log(self.sd * math.sqrt(2 * math.pi))


@dataclass(frozen=True)
class StudentT:
    mean: float
    scale: float
    df: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        c = math.lgamma((self.df + 1) / 2) - math.lgamma(self.df / 2) - 0.5 * math.log(self.df * math.pi) - math.log(self.scale)
        return c - (self.df + 1) / 2 * np.log1p(((x - self.mean) / self.scale) ** 2 / self.df)


@dataclass(frozen=True)
class Mixture:
    weights: tuple[float, ...]
    parts: tuple[Normal, ...]


def normal_posterior(estimate: float, se: float, prior: Normal) -> Normal:
    w = 1 / se**2 + 1 / prior.sd**2
    return Normal((estimate / se**2 + prior.mean / prior.sd**2) / w, math.sqrt(1 / w))


def mixture_posterior(estimate: float, se: float, prior: Mixture) -> Mixture:
    log = []
    for w, p in zip(prior.weights, prior.parts, strict=True):
        s = math.hypot(se, p.sd)
        log.append(math.log(w) - 0.5 * ((estimate - p.mean) / s) ** 2 - math.log(s))
    top = max(log)
    mass = [math.exp(x - top) for x in log]
    return Mixture(tuple(m / sum(mass) for m in mass), tuple(normal_posterior(estimate, se, p) for p in prior.parts))


def summary(posterior: Normal | Mixture, alpha: float = 0.05) -> dict:
    """Mean, equal-tailed interval and the probability of a positive effect."""
    weights, parts = (posterior.weights, posterior.parts) if isinstance(posterior, Mixture) else ((1.0,), (posterior,))
    cdf = lambda x: sum(w * dist.norm_cdf((x - p.mean) / p.sd) for w, p in zip(weights, parts, strict=True))
    low, high = min(p.mean - 40 * p.sd for p in parts), max(p.mean + 40 * p.sd for p in parts)
    bound = lambda q: dist.solve(lambda x: cdf(x) - q, low, high)
    return {"mean": sum(w * p.mean for w, p in zip(weights, parts, strict=True)), "lb": bound(alpha / 2), "ub": bound(1 - alpha / 2), "p_positive": 1 - cdf(0.0)}


def grid_posterior(estimate: float, se: float, prior: StudentT | Normal, points: int = 20_001) -> dict:
    """The same summary by quadrature, for priors without a conjugate form."""
    spread = 12 * se
    x = np.linspace(estimate - spread - abs(prior.mean - estimate), estimate + spread + abs(prior.mean - estimate), points)
    log = prior.log_density(x) - 0.5 * ((x - estimate) / se) ** 2
    mass = np.exp(log - log.max())
    mass /= mass.sum()
    cdf = np.cumsum(mass)
    at = lambda q: float(np.interp(q, cdf, x))
    return {"mean": float((mass * x).sum()), "lb": at(0.025), "ub": at(0.975), "p_positive": float(mass[x > 0].sum())}
