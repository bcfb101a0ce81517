"""Four-vector arithmetic on struct columns with the fields px, py, pz and E."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pt(v: Column) -> Column:
    """Momentum across the beam."""
    return F.sqrt(v["px"] * v["px"] + v["py"] * v["py"])


def momentum(v: Column) -> Column:
    return F.sqrt(v["px"] * v["px"] + v["py"] * v["py"] + v["pz"] * v["pz"])


def mass(v: Column) -> Column:
    """Invariant mass; NaN where the square is negative."""
    square = v["E"] * v["E"] - v["px"] * v["px"] - v["py"] * v["py"] - v["pz"] * v["pz"]
    return F.when(square >= 0, F.sqrt(square)).otherwise(F.lit(float("nan")))


def eta(v: Column) -> Column:
    """Pseudorapidity; infinite along the beam."""
    p = momentum(v)
    up, down = p + v["pz"], p - v["pz"]
    inner = F.log(F.when((up > 0) & (down > 0), up / F.when(down > 0, down).otherwise(1.0)).otherwise(1.0)) / 2
    return F.when((up > 0) & (down > 0), inner).when(v["pz"] > 0, F.lit(float("inf"))).when(v["pz"] < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def phi(v: Column) -> Column:
    return F.atan2(v["py"], v["px"])


def lorentz_sum(*vs: Column) -> Column:
    """The sum of four-vectors."""
    return F.struct(*[sum((v[c] for v in vs[1:]), vs[0][c]).alias(c) for c in ("px", "py", "pz", "E")])
