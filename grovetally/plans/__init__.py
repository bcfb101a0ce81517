"""From specifications to DataFrame plans and back to results."""

from .assemble import aggregate, assemble
from .lower import Plan, lower, states, tidy
from .tally import Tally, load, merge, tally

__all__ = ["Plan", "lower", "tidy", "states", "aggregate", "assemble", "Tally", "load", "merge", "tally"]
