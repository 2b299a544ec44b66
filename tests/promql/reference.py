"""A small evaluator over plain lists, written apart from the engine: what the queries of the tests should give."""

import math
from collections import defaultdict

LOOKBACK = 300_000


def rows_of(series):
    """Sample rows of ``{(name, labels...): [(t, v or None for a stale mark), ...]}``."""
    out = []
    for (name, *labels), points in series.items():
        for t, v in points:
            out.append(({"__name__": name, **dict(labels)}, t, 0.0 if v is None else v, v is None))
    return out


class Store:
    def __init__(self, series):
        self.series = series

    def pick(self, name, **labels):
        for (n, *own), points in self.series.items():
            if n == name and all(dict(own).get(k) == v for k, v in labels.items()):
                yield dict(own), points

    def at(self, name, t, **labels):
        """Newest values by labels; a stale mark ends a series."""
        out = {}
        for own, points in self.pick(name, **labels):
            near = [(x, v) for x, v in points if t - LOOKBACK < x <= t]
            if near and near[-1][1] is not None:
                out[key(**own)] = near[-1][1]
        return out

    def windows(self, name, t, width, **labels):
        out = {}
        for own, points in self.pick(name, **labels):
            inside = [(x, v) for x, v in points if t - width < x <= t and v is not None]
            if inside:
                out[key(**own)] = inside
        return out

    def over(self, fn, name, t, width, **labels):
        out = {k: fn(w, t, width) for k, w in self.windows(name, t, width, **labels).items()}
        return {k: v for k, v in out.items() if v is not None}


def key(**labels):
    return tuple(sorted(labels.items()))


def grouped(vector, names, fn):
    groups = defaultdict(list)
    for k, v in vector.items():
        groups[tuple((a, b) for a, b in k if a in names)].append(v)
    return {k: fn(v) for k, v in groups.items()}


def increase(w, t, width, counter=True):
    """Growth between the first and last sample, carried to the window's edges where those are near."""
    if len(w) < 2:
        return None
    grown = w[-1][1] - w[0][1]
    if counter:
        grown += sum(a for (_, a), (_, b) in zip(w, w[1:], strict=False) if b < a)
    length = w[-1][0] - w[0][0]
    gap = length / (len(w) - 1)
    lead, trail = w[0][0] - (t - width), t - w[-1][0]
    lead = gap / 2 if lead >= 1.1 * gap else lead
    trail = gap / 2 if trail >= 1.1 * gap else trail
    if counter and grown > 0 and w[0][1] >= 0:
        lead = min(lead, length * w[0][1] / grown)
    return grown * (length + lead + trail) / length


def rate(w, t, width):
    x = increase(w, t, width)
    return None if x is None else x / (width / 1000)


def delta(w, t, width):
    return increase(w, t, width, counter=False)


def irate(w, t, width):
    if len(w) < 2:
        return None
    (a, x), (b, y) = w[-2:]
    return (y if y < x else y - x) / ((b - a) / 1000)


def line(w, t, width):
    """(slope per second, value at t) of the least squares line."""
    n = len(w)
    if n < 2:
        return None
    xs, ys = [(a - t) / 1000 for a, _ in w], [v for _, v in w]
    mx, my = sum(xs) / n, sum(ys) / n
    slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
    return slope, my - slope * mx


def quantile(q, values):
    values = sorted(values)
    at = q * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def deviation(values):
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def smooth(w, sf, tf):
    if len(w) < 2:
        return None
    s, b = w[0][1], w[1][1] - w[0][1]
    for _, v in w[1:]:
        new = sf * v + (1 - sf) * (s + b)
        s, b = new, tf * (new - s) + (1 - tf) * b
    return s
