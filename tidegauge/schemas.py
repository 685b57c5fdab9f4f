"""Column contracts of the stages; `conform` checks and orders a frame at a stage's border."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import EngineError

#: Column contracts.
EVENTS = {"unit_id": "string", "ts": "timestamp", "value": "double"}
EXPOSURES = {"experiment_id": "string", "unit_id": "string", "group_id": "string", "first_exposure_ts": "timestamp", "first_exposure_date": "date"}
UNIT_DAY_STATS = {"unit_id": "string", "ds": "date", "n_events": "bigint", "sum_value": "double", "min_value": "double", "max_value": "double"}
UNIT_TOTALS = {"unit_id": "string", "group_id": "string", "y": "double"}
TRIGGERED = {**EXPOSURES, "first_trigger_ts": "timestamp"}
MEASURE_STATS = {"experiment_id": "string", "unit_id": "string", "ds": "date", "measure_key": "string", "n_events": "bigint", "sum_value": "double", "min_value": "double", "max_value": "double"}
PRIMARY_KEYS = {"exposures": ["experiment_id", "unit_id"], "measure_stats": ["experiment_id", "unit_id", "ds", "measure_key"]}


def conform(df: DataFrame, contract: dict[str, str], *, extra: bool = True) -> DataFrame:
    """The contract's columns, cast, then any further ones; refuses a missing column."""
    missing = [c for c in contract if c not in df.columns]
    if missing:
        raise EngineError("stage.missing_columns", f"no column {missing}", missing=missing, columns=df.columns)
    rest = [F.col(f"`{c}`") for c in df.columns if c not in contract] if extra else []
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in contract.items()), *rest)
