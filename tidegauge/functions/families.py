"""Families of hypotheses on the driver: BH, e-BH, their intervals after selection, and ship decisions."""

from __future__ import annotations

import math


def bh(p: list[float], q: float = 0.05) -> list[bool]:
    ranked = sorted(p)
    cut = max((x for k, x in enumerate(ranked, 1) if x <= k * q / len(p)), default=None)
    return [cut is not None and x <= cut for x in p]


def e_bh(log_e: list[float], q: float = 0.05) -> list[bool]:
    ranked = sorted(log_e, reverse=True)
    k = max((k for k, x in enumerate(ranked, 1) if x >= -math.log(q * k / len(log_e))), default=0)
    return [k > 0 and x >= ranked[k - 1] for x in log_e]


def fcr_alpha(selected: int, family: int, q: float = 0.05) -> float:
    """Level of the intervals of selected effects that keeps the false coverage rate."""
    return q * max(1, selected) / family


def holm(p: list[float], alpha: float = 0.05) -> list[bool]:
    out, alive = [False] * len(p), True
    for k, i in enumerate(sorted(range(len(p)), key=p.__getitem__)):
        alive = alive and p[i] <= alpha / (len(p) - k)
        out[i] = alive
    return out


def decide(readouts: list[dict]) -> dict:
    """Ship if a primary metric improves, none worsens and every guardrail stays within its margin; else hold or stop.

    A readout: role (primary, secondary, guardrail), direction (increase, decrease), lb, ub and, for a guardrail, margin.
    """
    wins, losses, breaches, open_ = [], [], [], []
    for r in readouts:
        if r.get("lb") is None:
            open_.append(r["metric"])
            continue
        lb, ub = (r["lb"], r["ub"]) if r.get("direction", "increase") == "increase" else (-r["ub"], -r["lb"])
        if r["role"] == "guardrail":
            if ub < -r.get("margin", 0.0):
                breaches.append(r["metric"])
            elif lb < -r.get("margin", 0.0):
                open_.append(r["metric"])
        elif ub < 0:
            losses.append(r["metric"])
        elif lb > 0 and r["role"] == "primary":
            wins.append(r["metric"])
    verdict = "stop" if breaches or losses else "ship" if wins and not open_ else "hold"
    return {"verdict": verdict, "wins": wins, "losses": losses, "breaches": breaches, "undecided": open_}


def exploratory(rows: list[dict], q: float = 0.1) -> list[dict]:
    """One family over all metrics and segments of an exploration: selected by BH, re-intervalled at the false coverage rate."""
    from .distributions import norm_ppf

    known = [r for r in rows if r.get("p") is not None]
    chosen = bh([r["p"] for r in known], q) if known else []
    z = norm_ppf(1 - fcr_alpha(sum(chosen), max(1, len(known)), q) / 2)
    picked = {id(r) for r, c in zip(known, chosen, strict=True) if c}
    return [{**r, "selected": id(r) in picked} | ({"lb": r["est"] - z * r["se"], "ub": r["est"] + z * r["se"]} if id(r) in picked else {}) for r in rows]
