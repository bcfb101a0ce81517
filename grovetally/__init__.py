"""Composable aggregation trees compiled to DataFrame plans."""

from .functions import Quantity, named, quantity, unweighted, vectorized
from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import Tally, aggregate, assemble, lower, merge, tally, tidy

__all__ = ["Quantity", "named", "quantity", "unweighted", "vectorized", "aggregate", "assemble", "lower", "tidy", "Tally", "tally", "merge", *_operators]
