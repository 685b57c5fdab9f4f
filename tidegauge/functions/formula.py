"""Arithmetic formulas over measures, parsed to columns or Spark SQL: + - * / ( ), numbers, names; division by zero is null."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError


def _tree(formula: str) -> ast.expr:
    try:
        return ast.parse(formula, mode="eval").body
    except SyntaxError as e:
        raise EngineError("formula.syntax", formula) from e


def names(formula: str) -> set[str]:
    return {n.id for n in ast.walk(_tree(formula)) if isinstance(n, ast.Name)}


def to_sql(formula: str) -> str:
    def walk(n: ast.expr) -> str:
        match n:
            case ast.BinOp(left, ast.Div(), right):
                return f"({walk(left)} / nullif({walk(right)}, 0))"
            case ast.BinOp(left, ast.Add() | ast.Sub() | ast.Mult() as op, right):
                return f"({walk(left)} {({ast.Add: '+', ast.Sub: '-', ast.Mult: '*'})[type(op)]} {walk(right)})"
            case ast.UnaryOp(ast.USub(), x):
                return f"(-{walk(x)})"
            case ast.Constant(v) if isinstance(v, (int, float)) and not isinstance(v, bool):
                return repr(v)
            case ast.Name(x):
                return f"`{x}`"
        raise EngineError("formula.unsupported", formula, part=ast.dump(n)[:60])

    return walk(_tree(formula))


def to_column(formula: str) -> Column:
    return F.expr(to_sql(formula))


def metric_sql(name: str, measures: dict[str, str], formula: str, source: str, by: list[str] | None = None) -> str:
    """A metric as one Spark SQL query: measures are aggregate expressions, the formula combines them."""
    unknown = names(formula) - set(measures)
    if unknown:
        raise EngineError("formula.unknown_measure", f"{sorted(unknown)}", measures=sorted(unknown))
    keys = "".join(f"`{k}`, " for k in by or [])
    inner = ", ".join(f"{e} AS `{m}`" for m, e in measures.items())
    group = f" GROUP BY {', '.join(f'`{k}`' for k in by)}" if by else ""
    return f"SELECT {keys}{to_sql(formula)} AS `{name}` FROM (SELECT {keys}{inner} FROM {source}{group})"
