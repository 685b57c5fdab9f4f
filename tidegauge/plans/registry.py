"""Extension points: estimators and learners by name, and the protocol of evidence that isn't a warehouse's."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Protocol

from pyspark.sql import DataFrame

from ..errors import EngineError

_ESTIMATORS: dict[str, tuple[str, Callable]] = {}


class EvidenceProvider(Protocol):
    """Anything that answers with moments (a row per arm) and, where an estimator needs them, unit rows."""

    def moments(self, metric: str, keys: list[str] | None = None) -> DataFrame: ...

    def totals(self, metric: str) -> DataFrame: ...


class Learner(Protocol):
    def fit(self, rows: DataFrame, columns: list[str], target: str) -> Learner: ...

    def predict(self, columns: list[str]): ...


def register(name: str, needs: str):
    """Register an estimator over "moments" or "units"; it takes the frame and options, and returns a frame of readouts."""
    if needs not in ("moments", "units"):
        raise EngineError("registry.needs", needs)

    def add(f: Callable) -> Callable:
        if name in _ESTIMATORS:
            raise EngineError("registry.duplicate", name)
        _ESTIMATORS[name] = needs, f
        return f

    return add


def load(group: str = "tidegauge.estimators") -> list[str]:
    """Estimators that installed packages offer."""
    for e in entry_points(group=group):
        e.load()
    return sorted(_ESTIMATORS)


def estimate(name: str, provider: EvidenceProvider, metric: str, **options) -> DataFrame:
    if name not in _ESTIMATORS:
        raise EngineError("registry.unknown", f"{name!r}", known=sorted(_ESTIMATORS))
    needs, f = _ESTIMATORS[name]
    return f(provider.moments(metric) if needs == "moments" else provider.totals(metric), **options)


def _defaults() -> None:
    from ..functions import effects
    from ..operators import designs, winsor

    for name, needs, f in (
        ("relative_lift", "moments", effects.relative_lift), ("absolute_difference", "moments", effects.absolute_difference), ("ratio_lift", "moments", effects.ratio_lift),
        ("cuped", "moments", effects.cuped), ("late", "moments", effects.late), ("quantile_lift", "units", designs.quantile_lift), ("iptw", "units", designs.iptw),
        ("aipw", "units", designs.aipw), ("dml", "units", designs.dml), ("winsorized_lift", "units", winsor.winsorized_lift),
    ):
        register(name, needs)(f)


_defaults()
