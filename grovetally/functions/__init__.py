"""Quantities and scalar helper functions."""

from .quantity import Quantity, named, quantity, unweighted, vectorized
from .vectors import eta, lorentz_sum, mass, momentum, phi, pt

__all__ = ["Quantity", "named", "quantity", "unweighted", "vectorized", "pt", "momentum", "mass", "eta", "phi", "lorentz_sum"]
