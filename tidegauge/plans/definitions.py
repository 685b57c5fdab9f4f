"""The semantic layer: YAML declarations, checked whole before anything is read."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from ..errors import EngineError
from ..operators.outcomes import AGGREGATIONS, Outcome

_FILTER_OPS = ("equals", "not_equals", "lt", "lte", "gt", "gte", "in")


@dataclass(frozen=True)
class Fact:
    name: str
    column: str | None = None
    missing: str = "error"
    description: str = ""


@dataclass(frozen=True)
class Property:
    name: str
    column: str
    dtype: str = "string"
    as_of: str = "event_time"
    description: str = ""


@dataclass(frozen=True)
class DimSource:
    name: str
    sql: str
    entity: str
    kind: str = "plain"
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class FactSource:
    name: str
    sql: str
    timestamp_column: str
    entities: tuple[str, ...]
    facts: tuple[Fact, ...] = ()
    properties: tuple[Property, ...] = ()
    dims: tuple[str, ...] = ()
    data_as_of: str | None = None


@dataclass(frozen=True)
class Exposure:
    name: str
    fact: str | None = None
    sql: str | None = None
    filters: tuple[dict, ...] = ()
    description: str = ""


@dataclass(frozen=True)
class Part:
    """A ratio's numerator or denominator."""

    fact: str
    aggregation: str = "sum"
    window_days: int | None = None


@dataclass(frozen=True)
class Metric:
    name: str
    type: str
    entity: str
    fact: str | None = None
    aggregation: str = "sum"
    window_days: int | None = None
    threshold_days: Any = None
    numerator: Part | None = None
    denominator: Part | None = None
    q: float | None = None
    filters: tuple[dict, ...] = ()
    winsorize: dict | None = None
    n_pre_periods: int = 0
    preferred_direction: str = "increase"
    margin: float | None = None
    description: str = ""

    @property
    def outcome(self) -> Outcome:
        if self.type == "conversion":
            return Outcome("conversion", window=self.window_days)
        if self.type == "retention":
            t = self.threshold_days
            return Outcome("retention", band=(t, None) if isinstance(t, int) else tuple(t))
        if self.type == "ratio":
            return Outcome("mean", self.numerator.aggregation, self.numerator.window_days)
        return Outcome("mean", self.aggregation, self.window_days)


@dataclass(frozen=True)
class Experiment:
    name: str
    exposure: str
    unit: str
    control: str
    start: str
    end: str
    metrics: tuple[str, ...]
    allocation: dict = field(default_factory=dict)
    breakouts: tuple[str, ...] = ()
    cluster: str | None = None
    mixed: str = "exclude"
    alpha: float = 0.05
    correction: str = "none"
    description: str = ""


@dataclass(frozen=True)
class Definitions:
    fact_sources: dict[str, FactSource]
    dim_sources: dict[str, DimSource]
    exposures: dict[str, Exposure]
    metrics: dict[str, Metric]
    experiments: dict[str, Experiment]

    def source_of(self, fact: str) -> FactSource:
        found = [s for s in self.fact_sources.values() if any(f.name == fact for f in s.facts)]
        if not found:
            raise EngineError("definition.unknown_fact", f"{fact!r}", fact=fact)
        return found[0]

    def fact(self, name: str) -> Fact:
        return next(f for f in self.source_of(name).facts if f.name == name)


_COMMAND = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|copy|call|set|use|cache|refresh|load|export|install|attach|pragma|vacuum|optimize)\b", re.I)


def admit_read_only_sql(sql: str) -> str:
    """The statement, if it is one SELECT without side effects (WITH and set operations are fine); else a refusal.

    Comments and quoted parts are blanked before the look, so that neither can hide or fake a keyword.
    """
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    bare = re.sub(r"'(?:[^']|'')*'", "''", bare)
    bare = re.sub(r'`[^`]*`|"[^"]*"', "q", bare).strip()
    bare = bare[:-1].strip() if bare.endswith(";") else bare
    if ";" in bare:
        raise EngineError("definition.sql.several_statements", "one statement is allowed")
    if not re.match(r"\(*\s*(select|with|values|from)\b", bare, re.I):
        raise EngineError("definition.sql.not_a_query", "a SELECT is expected", sql=sql[:80])
    if m := _COMMAND.search(re.sub(r"\b(set)\s*(?=\()", " ", bare, flags=re.I)):
        raise EngineError("definition.sql.command", f"{m[0]!r} isn't allowed", keyword=m[0])
    return sql.strip().rstrip(";")


def _build(cls, raw: dict, where: str):
    known = {f for f in cls.__dataclass_fields__}
    unknown = set(raw) - known
    if unknown:
        raise EngineError("definition.unknown_field", f"{where}: {sorted(unknown)}", fields=sorted(unknown))
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def _named(items, where: str) -> dict:
    out: dict = {}
    for x in items:
        if x.name in out:
            raise EngineError("definition.duplicate_name", f"{where}: {x.name!r}", name=x.name)
        out[x.name] = x
    return out


def load_definitions(where: str | Path | dict) -> Definitions:
    """A dict, a YAML file, or a folder of YAML files whose lists are put together."""
    if isinstance(where, dict):
        docs = [where]
    else:
        p = Path(where)
        docs = [yaml.safe_load(f.read_text()) or {} for f in (sorted(p.glob("*.y*ml")) if p.is_dir() else [p])]
    merged: dict[str, list] = {}
    for d in docs:
        for k, v in d.items():
            if k == "dialect":
                continue
            if k not in ("fact_sources", "dim_sources", "exposures", "metrics", "experiments"):
                raise EngineError("definition.unknown_section", f"{k!r}", section=k)
            merged.setdefault(k, []).extend(v or [])
    sources = []
    for raw in merged.get("fact_sources", []):
        raw = {**raw, "facts": [_build(Fact, f, "fact") for f in raw.get("facts", [])], "properties": [_build(Property, f, "property") for f in raw.get("properties", [])]}
        raw["sql"] = admit_read_only_sql(raw["sql"])
        sources.append(_build(FactSource, raw, "fact source"))
    dims = []
    for raw in merged.get("dim_sources", []):
        raw = {**raw, "properties": [_build(Property, f, "property") for f in raw.get("properties", [])], "sql": admit_read_only_sql(raw["sql"])}
        dims.append(_build(DimSource, raw, "dim source"))
    exposures = []
    for raw in merged.get("exposures", []):
        if (raw.get("fact") is None) == (raw.get("sql") is None):
            raise EngineError("definition.exposure.one_of", f"{raw.get('name')!r} needs a fact or a query")
        if raw.get("sql"):
            raw = {**raw, "sql": admit_read_only_sql(raw["sql"])}
        exposures.append(_build(Exposure, raw, "exposure"))
    metrics = []
    for raw in merged.get("metrics", []):
        raw = dict(raw)
        for part in ("numerator", "denominator"):
            if raw.get(part):
                raw[part] = _build(Part, raw[part], part)
        metrics.append(_build(Metric, raw, f"metric {raw.get('name')!r}"))
    experiments = [_build(Experiment, raw, "experiment") for raw in merged.get("experiments", [])]
    out = Definitions(_named(sources, "fact sources"), _named(dims, "dim sources"), _named(exposures, "exposures"), _named(metrics, "metrics"), _named(experiments, "experiments"))
    _validate(out)
    return out


def _validate(d: Definitions) -> None:
    for m in d.metrics.values():
        if m.type not in ("mean", "conversion", "retention", "ratio", "quantile", "total", "active"):
            raise EngineError("definition.metric.type", f"{m.name}: {m.type!r}", metric=m.name)
        if m.type == "ratio" and (m.numerator is None or m.denominator is None):
            raise EngineError("definition.metric.ratio_parts", m.name, metric=m.name)
        if m.type == "mean" and m.aggregation not in AGGREGATIONS:
            raise EngineError("definition.metric.aggregation", f"{m.name}: {m.aggregation!r}", metric=m.name)
        if m.type == "retention" and m.threshold_days is None:
            raise EngineError("definition.metric.threshold", m.name, metric=m.name)
        if m.type == "quantile" and not (m.q and 0 < m.q < 1):
            raise EngineError("definition.metric.quantile", m.name, metric=m.name)
        for fact in [m.fact] if m.type != "ratio" else [m.numerator.fact, m.denominator.fact]:
            source = d.source_of(fact)
            if m.entity not in source.entities:
                raise EngineError("definition.metric.entity", f"{m.name}: {m.entity!r}", metric=m.name)
            value = m.type in ("mean", "quantile") and m.aggregation != "count"
            if value and d.fact(fact).column is None:
                raise EngineError("definition.metric.no_value", f"{m.name}: {fact!r} has no value column", metric=m.name)
        for f in m.filters:
            if f.get("op") not in _FILTER_OPS:
                raise EngineError("definition.metric.filter", f"{m.name}: {f.get('op')!r}", metric=m.name)
    for e in d.experiments.values():
        if e.exposure not in d.exposures:
            raise EngineError("definition.experiment.exposure", f"{e.name}: {e.exposure!r}", experiment=e.name)
        unknown = [m for m in e.metrics if m not in d.metrics]
        if unknown:
            raise EngineError("definition.experiment.metrics", f"{e.name}: {unknown}", experiment=e.name)
    for s in d.fact_sources.values():
        unknown = [x for x in s.dims if x not in d.dim_sources]
        if unknown:
            raise EngineError("definition.source.dims", f"{s.name}: {unknown}", source=s.name)
