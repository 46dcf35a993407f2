"""Cleaning and null normalisation.

All steps are projections; N9 and N10 learn from one aggregate at (year,
section) grain, whose kept values meet the articles.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import title_case
from ..session import materialize

# Fixed values of the reference's section cleaning.
NULL_TEXTS = ("nan", "none")
OPINION_PREFIX, OPINION_LABEL = "opinion", "Opinion"
GENERIC_SECTIONS = ("Market News", "World News", "Business News", "Wires", "World", "Intel", "News")


def _string_cols(df: DataFrame, cols: Iterable[str] | None) -> list[str]:
    if cols is not None:
        return list(cols)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def text_null_fix(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Strings equal (any case) to "nan" or "none" become null."""
    cols = _string_cols(df, cols)
    return df.withColumns({
        c: F.when(~F.lower(F.col(c)).isin(*NULL_TEXTS) | F.col(c).isNull(), F.col(c)) for c in cols
    })


def empty_to_null(df: DataFrame) -> DataFrame:
    """N2: "" -> null for strings; empty arrays and maps -> null (schema driven)."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.nullif(c, F.lit(""))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out[f.name] = F.when(F.size(c) > 0, c)
    return df.withColumns(out) if out else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN -> null on floating columns, so means skip it as pandas does."""
    out = {f.name: F.when(~F.isnan(F.col(f.name)), F.col(f.name))
           for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(out) if out else df


def canonical_array(col: str | Column) -> Column:
    """Sorted, de-duplicated form of a list cell."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_sort(F.array_distinct(c))


def parse_date(col: str | Column, fmt: str | None = None) -> Column:
    """Text or timestamp -> date; unparseable -> null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_date(c.cast("string"), fmt) if fmt else F.to_date(c)


def normalise_nulls(df: DataFrame) -> DataFrame:
    """N1 + N2 + N3 in one projection."""
    return nan_to_null(empty_to_null(text_null_fix(df)))


def coalesce_prefix(df: DataFrame, col: str = "section", prefix: str = OPINION_PREFIX,
                    label: str = OPINION_LABEL) -> DataFrame:
    """Values starting (any case) with ``prefix`` become ``label``."""
    c = F.col(col)
    return df.withColumn(col, F.when(F.lower(c).startswith(prefix), F.lit(label)).otherwise(c))


def rare_values(df: DataFrame, key: str, by: str | None, global_once: bool = True) -> DataFrame:
    """(by, key, kept) of each combination in ``df``: not ``kept`` are values
    seen once overall, or once within their ``by`` group. A null ``by`` is only
    subject to the overall rule.

    One partial aggregate at (by, key) grain; the overall count is a window
    over that small table partitioned by key (at most one row per year).
    """
    keys = [by, key] if by else [key]
    counts = df.filter(F.col(key).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_by"))
    rare = F.col("_n_by") == 1 if not by else (F.col(by).isNotNull() & (F.col("_n_by") == 1))
    if global_once:
        rare = rare | (F.sum("_n_by").over(Window.partitionBy(key)) == 1)
    return counts.select(*keys, (~rare).alias("kept"))


#: Kept values that are sent to every task at most (a value and its group are some 50 bytes).
MOST_SENT = 1 << 18


def nullify_rare(df: DataFrame, key: str = "section", by: str | None = "year",
                 global_once: bool = True, most_sent: int = MOST_SENT) -> DataFrame:
    """N9 + N10: a value seen once overall, or once within its ``by`` group,
    becomes null. Rows whose ``by`` is null are only subject to the global
    rule (as the per-year loop of the reference never selects them).

    Only the values that are kept meet the rows, so the one-off values may be
    any number. The kept ones are counted: up to ``most_sent`` are broadcast
    and the rows stay where they are; beyond that both are shuffled.
    """
    keys = [by, key] if by else [key]
    classes = materialize(rare_values(df, key, by, global_once).filter("kept"))
    kept = classes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("kept").alias("_k_kept"), F.lit(0).alias("_k_salt"))
    cond = F.coalesce(F.col(key), F.lit("")) == F.col(f"_k_{key}")
    if by:
        cond = cond & F.col(by).eqNullSafe(F.col(f"_k_{by}"))
    if classes.count() <= most_sent:
        joined = df.join(F.broadcast(kept), cond, "left")
    else:
        # rows without a value meet nothing: a salt keeps them from all going to one task
        salt = F.when(F.col(key).isNull(), F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])).otherwise(F.lit(0))
        joined = df.withColumn("_salt", salt).join(kept, cond & (F.col("_salt") == F.col("_k_salt")), "left")
    value = F.when(F.col("_k_kept") & F.col(key).isNotNull(), F.col(key))
    return joined.withColumn(key, value).select(*df.columns)


def drop_values(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Drop rows whose value is in a fixed list (nulls are dropped before)."""
    return df.filter(~F.col(col).isin(*values))


def clean_sections(df: DataFrame, case_first: bool = True, generic: Sequence[str] | None = GENERIC_SECTIONS,
                   col: str = "section") -> DataFrame:
    """The section cleaning job.

    case_first=True (topic job): drop null -> title case -> opinion prefix ->
    N9 -> N10 -> drop null -> drop generic sections.
    case_first=False (exploratory order): opinion prefix -> N9 -> N10 ->
    title case -> drop null (generic sections kept unless given).
    """
    out = df.filter(F.col(col).isNotNull())
    if case_first:
        out = out.withColumn(col, title_case(col))
    out = coalesce_prefix(out, col)
    out = nullify_rare(out, col, "year")
    if not case_first:
        out = out.withColumn(col, title_case(col))
    out = out.filter(F.col(col).isNotNull())
    if generic:
        out = drop_values(out, col, generic)
    return out
