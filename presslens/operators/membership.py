"""Which of two classes a value belongs to, told inside the row.

A cascade of Bloom filters: the first holds the ``yes`` values; the ``no``
values that it also lets pass go into the second; the ``yes`` values that pass
that one into the third, and so on until none is left. As every value asked
for is of one class or the other, the answer is exact, and a row finds it by a
few bit tests on its own value: no join, no exchange of rows. The values should
be plain columns, as every test repeats their expression. A filter takes
``BITS`` bits a value, so the cascade takes about that for a ``yes`` value and
a hundredth for a ``no`` value.

The filters go to every task as scalar subqueries. Their size is known before
they are built; beyond ``MOST_BITS`` in all there is no cascade.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Bits a value, and tests a value: about one in 80 others passes a filter.
BITS, TESTS = 10, 4
#: Bits of all filters of a cascade (16 MiB).
MOST_BITS = 1 << 27


def _places(values: Sequence[Column], level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * TESTS + t), *values), F.lit(bits)) for t in range(TESTS)]


def _filter(stored: DataFrame, values: Sequence[Column], level: int, bits: int) -> DataFrame:
    """One row: the filter of the rows of ``stored`` as an array of 64-bit words."""
    place = stored.select(F.explode(F.array(*_places(values, level, bits))).alias("p"))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = place.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b"))
    every = stored.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left")
    in_order = F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b"))))
    return materialize(every.agg(F.transform(in_order, lambda x: x["b"]).alias("words")))


def _passes(words: DataFrame, values: Sequence[Column], level: int, bits: int) -> Column:
    table, out = words.scalar(), F.lit(True)
    for p in _places(values, level, bits):
        word = F.get(table, F.shiftright(p, 6).cast("int"))
        out = out & (F.call_function("getbit", word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


def cascade(classes: DataFrame, values: Sequence[str], yes: str, most_bits: int = MOST_BITS) -> Column | None:
    """Whether the row's ``values`` are of class ``yes``; null if the filters would exceed ``most_bits``.

    ``classes``: a stored table with one row per combination of ``values`` and
    the boolean ``yes``. The answer holds for combinations in the table only.
    """
    columns = [F.col(v) for v in values]
    now, other = classes.filter(yes), classes.filter(~F.col(yes))
    tests, used, level = [], 0, 0
    n = now.count()
    while n:
        bits = -(-n * BITS // 64) * 64
        used += bits
        if used > most_bits:
            return None
        words = _filter(now, columns, level, bits)
        tests.append(_passes(words, columns, level, bits))
        now, other = materialize(other.filter(tests[-1])), now
        n, level = now.count(), level + 1
    answer = F.lit(len(tests) % 2 == 1)
    for level in range(len(tests) - 1, -1, -1):
        answer = F.when(tests[level], answer).otherwise(F.lit(level % 2 == 1))
    return answer
