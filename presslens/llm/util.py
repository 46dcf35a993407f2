"""Helpers shared by the operators: stable row identity, stages, skew-safe joins."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import membership
from ..session import materialize

#: A key holding at least 1/HEAVY_SHARE of all rows is heavy. There are at
#: most HEAVY_SHARE such keys, whatever the input: the bound of every
#: broadcast of heavy keys.
HEAVY_SHARE = 1024

#: Characters that part words: the six ASCII white-space characters
#: ``[\x20\x09-\x0D]``. ``bytes.split()`` without argument parts at the same.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and continue from the copy."""
    return materialize(df)


def row_keyed(df: DataFrame) -> DataFrame:
    """``struct(all columns) AS _row`` plus a key of the row's place in its file.

    ``_fk`` (hash of the file's path) and ``_rx`` (row number in that file)
    tell rows apart even when ids are null or repeated, and stay the same when
    the plan is run again, also after the loss of an executor. Packing the
    columns keeps input names from clashing with those of an operator. An
    input that does not come straight from files is written as a stage first.
    """
    def keyed(d: DataFrame) -> DataFrame:
        meta = d.metadataColumn("_metadata")
        return d.select(F.struct(*[d[f"`{c}`"] for c in d.columns]).alias("_row"),
                        F.xxhash64(meta["file_path"]).alias("_fk"), meta["row_index"].alias("_rx"))
    if from_files(df):
        return keyed(df)
    return keyed(stage(df))


def from_files(df: DataFrame) -> bool:
    """True if each row is one row of one file: a file relation under nothing
    but projections and filters. (A join or an explode also knows the place of
    its rows, but may hold several of one place.)"""
    step = df._jdf.queryExecution().analyzed()
    while step.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        step = step.children().head()
    if not step.children().isEmpty() or "Relation" not in step.nodeName():
        return False
    try:
        return bool(df.select(df.metadataColumn("_metadata")["row_index"]).schema)
    except AnalysisException:
        return False


def without_rows(keyed: DataFrame, classes: DataFrame, dropped: str) -> DataFrame:
    """The rows of ``row_keyed(...)`` whose place is not ``dropped`` in the stage
    ``classes`` (_fk, _rx and that boolean, for every row). Rows stay where they
    are; only beyond some ten million dropped rows are they joined with them."""
    gone = membership.cascade(classes, ["_fk", "_rx"], dropped)
    if gone is not None:
        return keyed.filter(~gone).select("_row.*")
    return keyed.join(classes.filter(dropped), ["_fk", "_rx"], "left_anti").select("_row.*")


def field(name: str) -> Column:
    """A column of the packed input row."""
    return F.col("_row").getField(name)


def giving_back(batches_of: Callable) -> Callable:
    """A function over Arrow batches that returns unused memory to the machine when its task ends: the Python worker
    lives on for tasks of other stages, and would keep what this one needed at most."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from batches_of(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # only the GNU library can
                ctypes.CDLL(None).malloc_trim(0)
    return run


def mod_crc32(id_col: Column, n: int) -> Column:
    """``crc32(id as text) mod n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(n))


def join_by_key(rows: DataFrame, side: DataFrame, keys: list[str], weight: str, total: int,
                spread: list[str]) -> DataFrame:
    """``rows LEFT JOIN side`` on null-free ``keys`` without a hot partition.

    ``side`` has one row per key with the number of rows holding it in
    ``weight``. Keys with at least ``total / HEAVY_SHARE`` rows (at most
    HEAVY_SHARE of them, by counting) are looked up in a broadcast; their rows
    then go through the shuffle join of the rest under a salt made from the
    ``spread`` columns, where they meet nothing and spread evenly.
    """
    cols = [c for c in side.columns if c not in keys]
    is_heavy = F.col(weight) * HEAVY_SHARE >= F.lit(total)
    heavy = side.filter(is_heavy).select(*keys, F.struct(*cols).alias("_heavy"))
    light = side.filter(~is_heavy).select(*keys, F.lit(0).alias("_salt"), F.struct(*cols).alias("_light"))
    salt = F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise(
        1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 16))).cast("int")
    met = (rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt)
           .join(light, [*keys, "_salt"], "left"))
    return met.select(*rows.columns, *[
        F.coalesce(F.col("_heavy").getField(c), F.col("_light").getField(c)).alias(c) for c in cols])


def chunks_by_bytes(sizes: Iterable[int], most: int) -> Iterator[slice]:
    """Consecutive slices of a batch whose sizes sum to at most ``most``; a larger item stands alone."""
    begin = total = end = 0
    for end, size in enumerate(sizes):
        if end > begin and total + size > most:
            yield slice(begin, end)
            begin, total = end, 0
        total += size
        end += 1
    if end > begin:
        yield slice(begin, end)


def bounded_blocks(rows: DataFrame, size: str, key: list[str], most: int) -> tuple[int, Column]:
    """Number of blocks, and the block of a row by a hash of ``key``, so that the ``size`` of a block is ``most`` at
    most unless one row alone is larger. The sizes are counted, and the blocks doubled until the bound holds."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    while True:
        block = F.pmod(F.xxhash64(*key), F.lit(n))
        over = rows.groupBy(block.alias("b")).agg(F.sum(size).alias("s"), F.countDistinct(*key).alias("k")).filter(
            (F.col("s") > most) & (F.col("k") > 1))
        if n == 1 and total <= most or over.isEmpty():
            return n, block
        n *= 2
