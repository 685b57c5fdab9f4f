"""Refusals with a machine-readable code and context; a cell that can't be estimated is a row with a reason instead."""

from __future__ import annotations

from typing import Any


class EngineError(ValueError):
    """A refused request: ``code`` names the rule, ``context`` the values that broke it."""

    def __init__(self, code: str, message: str, **context: Any):
        super().__init__(f"{code}: {message}")
        self.code, self.context = code, context
