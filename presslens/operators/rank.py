"""Rows of a stated rank without a sort: exact medians (A4), exactly n rows.

Both narrow the place down by counting. A pass gives every task's share as a
few numbers, the driver sees only those, and no task ever holds more than a
sketch, a table of 65,536 counts, or one final cell of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the last cell, whose distinct values are looked at one by one.
CELL = 4096
#: Accuracy of the sketch: its rank error is at most one in so many rows.
ACCURACY = 2000


@dataclass
class _Search:
    """The middle ranks lie in [low, high]; ``below``: rows under low, ``inside``: rows in the bracket."""
    name: str
    ranks: tuple[int, int]
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    margin: float = 1.0
    found: float | None = None
    tried: tuple | None = field(default=None)

    def within(self) -> Column:
        x = F.col(self.name)
        return x.isNotNull() if self.low is None else (x >= F.lit(self.low)) & (x <= F.lit(self.high))

    def shares(self) -> list[float]:
        """Ranks, as shares of the bracket's rows, between which both middle ranks surely lie."""
        slack = self.margin * 2.0 / ACCURACY
        return [min(1.0, max(0.0, s)) for s in ((self.ranks[0] - self.below) / self.inside - slack,
                                                (self.ranks[1] + 1 - self.below) / self.inside + slack)]


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Median of each numeric column (nulls don't count), exact: the mean of the two middle values.

    A mergeable sketch proposes a bracket around the middle ranks, the next
    pass counts the rows below and inside it, so a wrong proposal is seen and
    widened. A bracket keeps about 1 in 500 of its rows, so a handful of passes
    over the narrow columns settles any number of rows; then the distinct
    values of the last cell are counted.
    """
    rows = df.select(*cols)
    counts = rows.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    todo = [_Search(c, ((n - 1) // 2, n // 2), inside=n) for c, n in zip(cols, counts) if n]
    done = {c: None for c in cols}
    while todo:
        ends = rows.agg(*[F.percentile_approx(F.when(s.within(), F.col(s.name)), s.shares(), ACCURACY).alias(f"p{i}")
                          for i, s in enumerate(todo)]).first()
        aggs = []
        for i, (s, (low, high)) in enumerate(zip(todo, ends)):
            x = F.col(s.name)
            s.tried = (low, high)
            aggs += [F.count_if(x < F.lit(low)).alias(f"b{i}"), F.count_if((x >= F.lit(low)) & (x <= F.lit(high))).alias(f"i{i}")]
        seen = rows.agg(*aggs).first()
        for i, s in enumerate(todo):
            below, inside = seen[f"b{i}"], seen[f"i{i}"]
            if not below <= s.ranks[0] <= s.ranks[1] < below + inside:
                s.margin *= 4
                continue
            shrunk = s.low is None or inside < s.inside
            (s.low, s.high), s.below, s.inside, s.margin = s.tried, below, inside, 1.0
            if s.low == s.high:
                s.found = float(s.low)
            elif inside <= CELL or not shrunk:
                s.found = _middle(rows, s)
        done |= {s.name: s.found for s in todo if s.found is not None}
        todo = [s for s in todo if s.found is None]
    return done


def _middle(rows: DataFrame, s: _Search) -> float:
    """The median from the distinct values of the last cell, which no sketch narrows further."""
    at, values = s.below, []
    # at most CELL rows, or a bracket of fewer distinct values than the sketch tells apart
    for value, n in rows.filter(s.within()).groupBy(s.name).count().orderBy(s.name).toLocalIterator():
        values += [value for r in sorted(set(s.ranks)) if at <= r < at + n]
        at += n
        if at > s.ranks[1]:
            break
    return (values[0] + values[-1]) / 2


#: Hexadecimal digits that one pass settles: a table of 16 ** 4 counts.
DIGITS = 4


def first_by_hash(df: DataFrame, digests: Sequence[tuple[Column, int]], n: int) -> DataFrame:
    """The ``n`` rows (all if there are fewer) least by ``digests``, hexadecimal texts of stated lengths, in that order.

    Rows per prefix are counted, the prefix in which the n-th row lies is
    counted by its next digits, until a prefix ends with row n; the result is a
    filter on that prefix. Rows that are equal in every digit can't be told
    apart; of those any are taken.
    """
    before, left = [], n  # the cut so far: (digest, digits) pairs
    cell, less = F.lit(True), F.lit(False)
    for digest, length in digests:
        prefix = ""
        while len(prefix) < length:
            here = F.substring(digest, len(prefix) + 1, DIGITS)
            counted = df.filter(cell).groupBy(here.alias("d")).agg(F.count(F.lit(1)).alias("n"))
            table = sorted(tuple(r) for r in counted.collect())  # at most 16 ** DIGITS rows
            if not before and not prefix and sum(r[1] for r in table) <= n:
                return df
            for digits, rows in table:
                if rows >= left:
                    break
                left -= rows
            up_to = F.substring(digest, 1, len(prefix) + DIGITS)
            if rows == left:
                return df.filter(less | (cell & (up_to <= F.lit(prefix + digits))))
            less = less | (cell & (up_to < F.lit(prefix + digits)))
            prefix += digits
            cell = cell & (up_to == F.lit(prefix))
        before.append(prefix)
    return df.filter(less).unionByName(df.filter(cell).limit(left))
