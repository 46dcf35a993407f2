"""Exact duplicates with a heavy-hitter split.

Texts are equal when they are identical after each run of ASCII white space
is replaced by one space; a null text counts as empty. Digests are SHA-256 of
the normalised text.

1. Digests are written once as a narrow stage (row place, id, digest).
2. A Misra-Gries summary per partition, summed over partitions, leaves at most
   ``2 * HEAVY_SHARE`` candidates and is sure to hold every digest with
   ``n / HEAVY_SHARE`` rows (Misra and Gries 1982; mergeable summaries,
   Agarwal et al. 2012).
3. Candidates are counted exactly; those that reach the share are the verified
   heavy digests. Their winners (at most HEAVY_SHARE rows) are broadcast, and
   their copies are settled where they lie, without a shuffle.
4. All other digests are shuffled and settled per digest in a window; none of
   these groups holds ``n / HEAVY_SHARE`` rows.

Defined cases: of equal texts the row with the smallest id stays, ids that are
null come last; rows that repeat the smallest id are told apart by their place
in the input, so exactly one row of each group stays. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import HEAVY_SHARE, SPACE_RUN, field, giving_back, row_keyed, stage, without_rows

#: Counters of a Misra-Gries summary: its error, n / (COUNTERS + 1), is half the share looked for.
COUNTERS = 2 * HEAVY_SHARE - 1


def _reduced(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """At most ``k`` counters: the (k+1)-th largest is taken off all."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {d: c - cut for d, c in counts.items() if c > cut}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, int] = {}
    for batch in batches:
        for x in batch.column(0).value_counts().to_pylist():
            counts[x["values"]] = counts.get(x["values"], 0) + x["counts"]
        counts = _reduced(counts, COUNTERS)
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(counts), pa.binary()),
                                      "counter": pa.array(list(counts.values()), pa.int64())})


def heavy_digests(digests: DataFrame, n: int) -> DataFrame:
    """(digest, group_size, winner) of every digest with at least ``n / HEAVY_SHARE`` of the ``n`` rows."""
    summed = (digests.select("digest").mapInArrow(giving_back(_summaries), "digest binary, counter long")
              .groupBy("digest").agg(F.sum("counter").alias("counter")))
    # counters fall short by n / (COUNTERS + 1) in all at most, and their sum is n at most
    candidates = summed.filter(F.col("counter") * 2 * HEAVY_SHARE >= F.lit(n)).select("digest")
    return (digests.join(F.broadcast(candidates), "digest").groupBy("digest")
            .agg(F.count("*").alias("group_size"), F.min(_place()).alias("winner"))
            .filter(F.col("group_size") * HEAVY_SHARE >= F.lit(n)))


def _place():
    """What the staying row of a group has least: id with nulls last, then the row's place."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "_fk", "_rx")


def decide(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_fk, _rx, id, keep_id, group_size, kept, digest) per row of ``util.row_keyed(...)``."""
    text = F.regexp_replace(F.coalesce(field(text_col).cast("string"), F.lit("")), SPACE_RUN, " ")
    digests = stage(keyed.select("_fk", "_rx", field(id_col).alias("id"),
                                 F.unhex(F.sha2(text, 256)).alias("digest")))
    n = digests.count()
    heavy = stage(heavy_digests(digests, n))
    met = digests.join(F.broadcast(heavy), "digest", "left")
    out = ["_fk", "_rx", "id", "keep_id", "group_size", "kept", "digest"]
    settled = met.filter(F.col("group_size").isNotNull()).select(
        "*", F.col("winner.id").alias("keep_id"), (F.col("winner") == _place()).alias("kept")).select(out)
    group = Window.partitionBy("digest")
    first = group.orderBy(F.col("id").asc_nulls_last(), "_fk", "_rx")
    rest = met.filter(F.col("group_size").isNull()).drop("group_size", "winner").select(
        "*", F.first("id").over(first).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(first) == 1).alias("kept")).select(out)
    return settled.unionByName(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 (see the module)."""
    return decide(row_keyed(docs), id_col, text_col).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    keyed = row_keyed(docs)
    classes = stage(decide(keyed, id_col, text_col).select("_fk", "_rx", (~F.col("kept")).alias("dropped")))
    return without_rows(keyed, classes, "dropped")
