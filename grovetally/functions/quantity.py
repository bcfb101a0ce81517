"""Fill rules: a Column with an optional name."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType


@dataclass(frozen=True, eq=False)
class Quantity:
    """What a node of an aggregation tree looks at in each row.

    ``expr`` is a Column, a SQL expression, a number, or a Python function of single values whose parameters are named like
    columns. Such a function runs row by row within Arrow batches; :func:`vectorized` takes one of whole batches.
    """

    expr: Column | str | float | Callable
    name: str | None = None

    def _called(self, kind: str) -> Column:
        """The column of a Python function. A result of None is null."""
        f, names = self.expr, columns_of(self.expr)
        put = float if kind == "double" else str

        def run(*series):
            got = [f(*(None if pd.isna(x) and not isinstance(x, float) else x for x in row)) for row in zip(*series, strict=True)]
            return pd.Series([None if x is None else put(x) for x in got], dtype=object)

        return vectorized(run, *names, kind=kind)

    @property
    def column(self) -> Column:
        if callable(self.expr):
            return self._called("double")
        return self.expr if isinstance(self.expr, Column) else F.expr(self.expr) if isinstance(self.expr, str) else F.lit(float(self.expr))

    def named(self, name: str) -> Quantity:
        if self.name is not None and self.name != name:
            raise ValueError(f"this quantity already has the name {self.name!r}")
        return Quantity(self.expr, name)

    def number(self, nulls: str = "nan") -> Column:
        """As a double; null is missing (NaN), or 0 with ``nulls="zero"``."""
        return F.coalesce(self.column.cast("double"), F.lit(0.0 if nulls == "zero" else float("nan")))

    def category(self) -> Column:
        """As a string; null is the category "NaN"."""
        column = self._called("string") if callable(self.expr) else self.column.cast("string")
        return F.coalesce(column, F.lit("NaN"))


def columns_of(f: Callable) -> list[str]:
    """The columns that a Python function is of: its parameters."""
    given = list(inspect.signature(f).parameters.values())
    if not given or any(p.kind not in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) for p in given):
        raise TypeError("a function as a quantity needs parameters named like columns")
    if [p.name for p in given] == ["row"]:
        raise TypeError("a function as a quantity gets the values of columns, not a row: name its parameters like columns")
    return [p.name for p in given]


def quantity(q: Quantity | Column | str | float | Callable) -> Quantity:
    if isinstance(q, Quantity):
        return q
    if isinstance(q, (Column, str, int, float)) and not isinstance(q, bool):
        return Quantity(q)
    if callable(q) and not isinstance(q, type):
        columns_of(q)
        return Quantity(q)
    raise TypeError(f"a quantity must be a Column, a SQL expression, a number or a function of columns, not {type(q).__name__}")


def named(q: Quantity | Column | str | float, name: str) -> Quantity:
    """``q`` with a name, which results and JSON keep."""
    return quantity(q).named(name)


def vectorized(f: Callable, *columns: Column | str, kind: str = "double") -> Column:
    """A Python function of some columns as a quantity. ``f`` gets a pandas Series for each column, in Arrow
    batches, and gives one of type ``kind``; a function of single numbers goes in as ``numpy.vectorize(f)``.
    """

    def run(*series):
        got = f(*series)
        return got if isinstance(got, pd.Series) else pd.Series(got)

    run.__annotations__ = {"return": pd.Series}
    return F.pandas_udf(run, kind, PandasUDFType.SCALAR)(*columns)


#: The selection that lets everything pass.
unweighted = Quantity(1.0, "unweighted")
