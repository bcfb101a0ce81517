"""Compositions with names of their own."""

from __future__ import annotations

from ..functions.quantity import unweighted
from .spec import Average, Bin, Deviate, Select, SparselyBin


def Histogram(num, low, high, q, selection=unweighted):
    """Counts in equal bins of the rows that a selection lets pass."""
    return Select(selection, Bin(num, low, high, q))


def SparselyHistogram(bin_width, q, selection=unweighted, origin=0.0):
    return Select(selection, SparselyBin(bin_width, q, origin=origin))


def Profile(num, low, high, binned, averaged, selection=unweighted):
    """Means of one quantity in equal bins of another."""
    return Select(selection, Bin(num, low, high, binned, Average(averaged)))


def SparselyProfile(bin_width, binned, averaged, selection=unweighted, origin=0.0):
    return Select(selection, SparselyBin(bin_width, binned, Average(averaged), origin=origin))


def ProfileErr(num, low, high, binned, averaged, selection=unweighted):
    """Means and variances of one quantity in equal bins of another."""
    return Select(selection, Bin(num, low, high, binned, Deviate(averaged)))


def SparselyProfileErr(bin_width, binned, averaged, selection=unweighted, origin=0.0):
    return Select(selection, SparselyBin(bin_width, binned, Deviate(averaged), origin=origin))


def TwoDimensionallyHistogram(xnum, xlow, xhigh, x, ynum, ylow, yhigh, y, selection=unweighted):
    """Counts in equal bins of two quantities."""
    return Select(selection, Bin(xnum, xlow, xhigh, x, Bin(ynum, ylow, yhigh, y)))


def TwoDimensionallySparselyHistogram(xwidth, x, ywidth, y, selection=unweighted, xorigin=0.0, yorigin=0.0):
    return Select(selection, SparselyBin(xwidth, x, SparselyBin(ywidth, y, origin=yorigin), origin=xorigin))
