"""Deterministic allocation of units to arms by hash, as a column expression and on the driver."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

SLOTS = 10_000


def _check(arms: dict[str, int]) -> None:
    if sum(arms.values()) != SLOTS:
        raise EngineError("assignment.weights", f"weights sum to {sum(arms.values())}, not {SLOTS}", arms=arms)


def slot(unit: Column, salt: str) -> Column:
    """0 to 9999 from the SHA-256 of the length-prefixed salt and unit."""
    u = unit.cast("string")
    text = F.concat(F.lit(f"{len(salt.encode())}:{salt}"), F.octet_length(u).cast("string"), F.lit(":"), u)
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), F.lit(SLOTS))


def allocate(unit: Column, salt: str, arms: dict[str, int]) -> Column:
    """The arm of each unit; weights are parts of 10,000."""
    _check(arms)
    at, upto, out = slot(unit, salt), 0, None
    for name, weight in arms.items():
        upto += weight
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return out


def allocate_one(unit: str, salt: str, arms: dict[str, int]) -> str:
    _check(arms)
    text = f"{len(salt.encode())}:{salt}{len(unit.encode())}:{unit}"
    at = int(hashlib.sha256(text.encode()).hexdigest()[:15], 16) % SLOTS
    for name, weight in arms.items():
        if at < weight:
            return name
        at -= weight
    raise AssertionError
