"""Segments on the driver: heterogeneity test, tau-marginalised shrinkage, rollout recommendation."""

from __future__ import annotations

import math

import numpy as np

from . import distributions as dist


def heterogeneity(est: list[float], var: list[float], alpha: float = 0.05) -> dict:
    w = 1 / np.array(var)
    e = np.array(est)
    mu, df = float((w * e).sum() / w.sum()), len(e) - 1
    q = float((w * (e - mu) ** 2).sum())
    tau2 = max(0.0, (q - df) / (w.sum() - (w**2).sum() / w.sum()))
    return {"k": len(e), "mu": mu, "q": q, "df": df, "p_value": dist.chi2_sf(q, df), "tau2": tau2, "i2": (max(0.0, (q - df) / q) if q > 0 else 0.0) if len(e) >= 5 else None}


def hksj(est: list[float], var: list[float], tau2: float, alpha: float = 0.05) -> tuple[float, float, float, float]:
    w = 1 / (np.array(var) + tau2)
    e = np.array(est)
    mu = float((w * e).sum() / w.sum())
    se = math.sqrt(float((w * (e - mu) ** 2).sum()) / ((len(e) - 1) * w.sum()))
    t = dist.t_ppf(1 - alpha / 2, len(e) - 1)
    return mu, se, mu - t * se, mu + t * se


def shrunk(est: list[float], var: list[float], alpha: float = 0.05, points: int = 400) -> list[dict]:
    """Each segment's effect with the spread between segments integrated out over a flat prior of tau."""
    e, v = np.array(est), np.array(var)
    taus = np.linspace(0, 4 * max(e.std(), math.sqrt(v.mean())), points)
    log, means, sds = [], [], []
    for t in taus:
        w = 1 / (v + t * t)
        mu, vm = (w * e).sum() / w.sum(), 1 / w.sum()
        log.append(0.5 * np.log(w).sum() - 0.5 * math.log(w.sum()) - 0.5 * (w * (e - mu) ** 2).sum())
        b = v / (v + t * t)
        means.append((1 - b) * e + b * mu)
        sds.append(np.sqrt((1 - b) * v + b * b * vm))
    mass = np.exp(np.array(log) - max(log))
    mass /= mass.sum()
    means, sds = np.array(means), np.maximum(np.array(sds), 1e-12)
    out = []
    for i in range(len(e)):
        cdf = lambda x, i=i: float((mass * np.array([dist.norm_cdf((x - m) / s) for m, s in zip(means[:, i], sds[:, i], strict=True)])).sum())
        low, high = means[:, i].min() - 10 * sds[:, i].max(), means[:, i].max() + 10 * sds[:, i].max()
        bound = lambda q, cdf=cdf, low=low, high=high: dist.solve(lambda x: cdf(x) - q, low, high, 60)
        out.append({"mean": float((mass * means[:, i]).sum()), "lb": bound(alpha / 2), "ub": bound(1 - alpha / 2)})
    return out


def rollout(segments: list[dict], margin: float = 0.0) -> list[dict]:
    """Per segment: roll out if its shrunk interval is above the margin, hold back if below, else follow the pooled effect."""
    pooled = heterogeneity([s["est"] for s in segments], [s["var"] for s in segments])
    if len(segments) < 2:
        return [{"segment": s["segment"], "action": "follow_pooled"} for s in segments]
    out = []
    for s, x in zip(segments, shrunk([s["est"] for s in segments], [s["var"] for s in segments]), strict=True):
        action = "roll_out" if x["lb"] > margin else "hold_back" if x["ub"] < margin else "follow_pooled"
        out.append({"segment": s["segment"], "action": action, **x, "heterogeneous": pooled["p_value"] < 0.05})
    return out
