"""Specifications of aggregation trees, their results and views."""

from .results import Result, zero_of
from .spec import (
    Average, Bag, Bin, Branch, Categorize, CentrallyBin, Count, Deviate, Fraction, Index, IrregularlyBin, Label, Maximize, Measured, Minimize, Select,
    SparselyBin, Spec, Stack, Sum, UntypedLabel, containers,
)
from .sugar import (
    Histogram, Profile, ProfileErr, SparselyHistogram, SparselyProfile, SparselyProfileErr, TwoDimensionallyHistogram, TwoDimensionallySparselyHistogram,
)

PRIMITIVES = (
    Count, Sum, Average, Deviate, Minimize, Maximize, Bag, Bin, SparselyBin, CentrallyBin, IrregularlyBin, Categorize, Fraction, Stack, Select, Label,
    UntypedLabel, Index, Branch,
)

__all__ = [
    "Result", "zero_of", "Spec", "Measured", "PRIMITIVES", "containers", *[p.__name__ for p in PRIMITIVES], "Histogram", "Profile", "ProfileErr", "SparselyHistogram",
    "SparselyProfile", "SparselyProfileErr", "TwoDimensionallyHistogram", "TwoDimensionallySparselyHistogram",
]
