"""A row-at-a-time filler in plain Python: what the compiled plans must agree with."""

from __future__ import annotations

import math

from grovetally.operators import spec as S


class Node:
    def __init__(self):
        self.entries, self.values, self.children = 0.0, {}, {}


def fill(spec, rows):
    """{path: {keys: measures}} of rows given as dicts; quantities are SQL names of their columns."""
    out: dict = {}

    def at(path, keys):
        return out.setdefault(path, {}).setdefault(keys, {"entries": 0.0, "rows": []})

    def value(q, row):
        if not isinstance(q.expr, str):
            return float(q.expr)
        x = row[q.expr]
        return x

    def number(q, row):
        x = value(q, row)
        return math.nan if x is None else float(x)

    def go(s, path, keys, w, row):
        if not w > 0:
            return
        step = lambda n: f"{path}/{n}" if path else n
        n = at(path, keys)
        n["entries"] += w
        if isinstance(s, S._Leaf):
            n["rows"].append((w, number(s.q, row)))
        elif isinstance(s, S.Bag):
            x = number(s.q, row)
            at(step("values"), (*keys, "nan" if math.isnan(x) else x + 0.0))["entries"] += w
        elif isinstance(s, S.Bin):
            x = number(s.q, row)
            if math.isnan(x):
                go(s.nanflow, step("nanflow"), keys, w, row)
            elif x < s.low:
                go(s.underflow, step("underflow"), keys, w, row)
            elif x >= s.high:
                go(s.overflow, step("overflow"), keys, w, row)
            else:
                go(s.value, step("values"), (*keys, int(math.floor((x - s.low) * s.num / (s.high - s.low)))), w, row)
        elif isinstance(s, S.SparselyBin):
            x = number(s.q, row)
            if math.isnan(x):
                go(s.nanflow, step("nanflow"), keys, w, row)
            else:
                i = 2**63 - 1 if x == math.inf else -(2**63) + 1 if x == -math.inf else math.floor((x - s.origin) / s.bin_width)
                go(s.value, step("bins"), (*keys, i), w, row)
        elif isinstance(s, S.CentrallyBin):
            x = number(s.q, row)
            c = s.centers
            if math.isnan(x):
                go(s.nanflow, step("nanflow"), keys, w, row)
            else:
                go(s.value, step("bins"), (*keys, next((i for i in range(len(c) - 1) if x < (c[i] + c[i + 1]) / 2), len(c) - 1)), w, row)
        elif isinstance(s, S.IrregularlyBin):
            x = number(s.q, row)
            if math.isnan(x):
                go(s.nanflow, step("nanflow"), keys, w, row)
            else:
                hit = [i for i, e in enumerate(s.edges) if x >= e]
                for i in hit if isinstance(s, S.Stack) else hit[-1:]:
                    go(s.value, step("bins"), (*keys, i), w, row)
        elif isinstance(s, S.Categorize):
            x = value(s.q, row)
            go(s.value, step("bins"), (*keys, "NaN" if x is None else x), w, row)
        elif isinstance(s, S.Select):
            go(s.cut, step("data"), keys, w * number(s.q, row), row)
        elif isinstance(s, S.Fraction):
            go(s.value, step("denominator"), keys, w, row)
            go(s.value, step("numerator"), keys, w * number(s.q, row), row)
        elif isinstance(s, S._Collection):
            for k, c in s.children():
                go(c, step(k), keys, w, row)

    for row in rows:
        go(spec, "", (), 1.0, row)
    return out


def measures(rows):
    """sum, mean, variance, min, max of weighted values."""
    w = sum(a for a, _ in rows)
    total = sum(a * x for a, x in rows)
    mean = total / w if w else math.nan
    variance = sum(a * (x - mean) ** 2 for a, x in rows) / w if w else math.nan
    some = [x for _, x in rows if not math.isnan(x)]
    return total, mean, variance, min(some, default=math.nan), max(some, default=math.nan)
