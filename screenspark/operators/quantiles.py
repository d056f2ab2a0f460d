"""Exact quantiles as scalars, of many columns at once, without any task holding all values.

One pass makes an approximate quantile sketch of every column, which brackets each
wanted place from both sides; one pass counts what lies below, at and between the
brackets' ends; one brings the few distinct values between them, with their counts.
Where too many would lie between, the brackets are narrowed by a sketch of their
inside first.  The passes are the same for one column and for a hundred.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values inside all brackets that are brought to the driver at most.
HELD = 500_000
#: The sketch is wrong by a row in so many at most; it has all values of columns of so many.
ACCURACY = 20_000


class Bracket:
    """Two ends around one wanted place of a column, and how many rows lie below, at, between and up to them."""

    def __init__(self, column: int, n: int, prob: float, low: float, high: float):
        self.column, self.low, self.high = column, low, high
        self.at = (n - 1) * prob
        self.first, self.last = math.floor(self.at), math.ceil(self.at)
        self.below = self.at_low = self.inside = self.at_high = 0
        self.values: list[tuple[float, int]] = []

    def widened(self, least: float, greatest: float) -> bool:
        """Whether a place lies outside, in which case the ends move to the column's own."""
        low, high = self.first < self.below, self.last >= self.below + self.at_low + self.inside + self.at_high
        self.low, self.high = least if low else self.low, greatest if high else self.high
        return low or high

    def needed(self) -> bool:
        """Whether a place lies strictly between the ends."""
        start = self.below + self.at_low
        return self.inside > 0 and self.last >= start and self.first < start + self.inside

    def value(self, k: int) -> float:
        k -= self.below
        for v, n in ((self.low, self.at_low), *sorted(self.values)):
            if k < n:
                return v
            k -= n
        return self.high

    def quantile(self) -> float:
        a, b = self.value(self.first), self.value(self.last)
        return a + (self.at - self.first) * (b - a)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], held: int = HELD, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """The interpolated quantiles of every column (NULL and NaN aside; None without values)."""
    if not cols or not probs:
        return {c: [] for c in cols}
    values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols]
    near = lambda p: [max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy)]
    shares = [s for p in probs for s in near(p)]
    row = df.agg(*(f for v in values for f in (F.count(v), F.min(v), F.max(v), F.percentile_approx(v, shares, accuracy)))).first()
    columns = [row[4 * i : 4 * i + 4] for i in range(len(cols))]
    found = {}
    for i, (n, least, greatest, sketch) in enumerate(columns):
        for j, p in enumerate(probs):
            if n:  # a sketch that has all values says nothing about their places that a row or two would not upset
                found[i, j] = Bracket(i, n, p, *((least, greatest) if n <= accuracy else sketch[2 * j : 2 * j + 2]))
    brackets = list(found.values())
    while True:
        measure(df, values, brackets)
        wide = [b for b in brackets if b.widened(*columns[b.column][1:3])]
        inside = [b for b in brackets if b.needed()]
        size = sum(b.inside for b in inside)
        if not wide and size <= held:
            break
        if not wide and not narrowed(df, values, inside, accuracy):
            break
    inside = [b for b in brackets if b.needed()]
    if inside:
        rows = F.array_compact(F.array(*(F.when(between(values, b), F.struct(F.lit(i).alias("b"), values[b.column].alias("v"))) for i, b in enumerate(inside))))
        for r in df.select(F.explode(rows).alias("x")).groupBy("x.b", "x.v").agg(F.count("*").alias("n")).collect():
            inside[r["b"]].values.append((r["v"], r["n"]))
    return {c: [found[i, j].quantile() if (i, j) in found else None for j in range(len(probs))] for i, c in enumerate(cols)}


def between(values: list, b: Bracket):
    return (values[b.column] > b.low) & (values[b.column] < b.high)


def measure(df: DataFrame, values: list, brackets: list[Bracket]) -> None:
    """Count the rows below, at and between the ends of all brackets, in one pass."""
    if not brackets:
        return
    counts = []
    for b in brackets:
        v = values[b.column]
        counts += [F.count_if(v < b.low), F.count_if(v == b.low), F.count_if(between(values, b)), F.count_if(v == b.high) if b.high > b.low else F.lit(0)]
    row = df.agg(*counts).first()
    for i, b in enumerate(brackets):
        b.below, b.at_low, b.inside, b.at_high = row[4 * i : 4 * i + 4]


def narrowed(df: DataFrame, values: list, brackets: list[Bracket], accuracy: int) -> bool:
    """Move the ends of brackets nearer to their places by sketches of what is inside; whether any moved."""
    shares = []
    for b in brackets:
        slack = 2 / min(accuracy, b.inside)
        places = [(k - b.below - b.at_low) / b.inside for k in (b.first, b.last)]
        shares.append([min(1.0, max(0.0, places[0] - slack)), min(1.0, max(0.0, places[1] + slack))])
    row = df.agg(*(F.percentile_approx(F.when(between(values, b), values[b.column]), s, accuracy) for b, s in zip(brackets, shares, strict=True))).first()
    moved = False
    for b, (low, high), s in zip(brackets, row, shares, strict=True):
        ends = (low if s[0] > 0 else b.low), (high if s[1] < 1 else b.high)
        moved |= ends != (b.low, b.high)
        b.low, b.high = ends
    return moved
