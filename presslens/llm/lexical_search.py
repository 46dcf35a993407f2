"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of ASCII letters (A-Z lower-cased), digits and non-ASCII
characters. N documents have a term, L terms in all; a document of n terms has
the normaliser ``m = 50 + (50 n N) div L``, and scores the sum over the query's
distinct terms of ``w * ((10^9 tf) div (1000 tf + 20 m))`` with
``w = floor(1000 ln((2N + 2) / (2 df + 1)))``; all but w is integer arithmetic.

Index. A task packs the documents it reads into blocks of at most ``DOCS``
documents and ``POSTINGS`` postings, a row each. In a block documents with
equal m form a stratum; a term's postings are grouped by stratum and, within
it, by tf: as m and tf alone decide the impact, it is computed once a group
and not once a document. All terms of all documents are indexed, nothing is
shuffled, and a term or stratum that holds a third of the rows is only spread
over all blocks.

Search. Queries are dealt into blocks of a checked size and broadcast with
their weights. In each index block a stratum's bound is the sum of the query's
largest impacts there (of the largest tf in that stratum); strata are visited
by falling bound, and the visits end when the bound falls below the k-th best
score that the task has found so far for the query. Each task keeps k rows a
query; their union is ranked. Weights are never negative, so the bounds hold.

Documents of equal score are ranked by ascending id, null ids last, then by
their place in the input.

Defined cases: null texts and texts without a term are in no result and don't
count in N; items without a known term give no rows; rows of items that share
an id (or have none) are one query, the union of their terms; repeated
documents are ranked each; empty tables give an empty result. A query whose
distinct terms alone exceed the block size is a block of its own.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stage_path
from .util import bounded_blocks, field, row_keyed, stage

#: Documents and postings of an index block (the document that passes the second bound is its last).
DOCS, POSTINGS = 8192, 1 << 18
#: Bytes of a row group of the index table; a reading task decodes one at a time.
ROW_GROUP = 16 << 20
#: Bytes of a block of queries: of their terms, eight more a term and 64 a result row.
QUERIES = 4 << 20

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


def normaliser(n: int, n_docs: int, n_terms: int) -> int:
    return 50 + (50 * n * n_docs) // n_terms


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Index:
    """``blocks``: a written table, a row a block; ``n_docs``, ``n_terms``: N and L; ``id_type``: of the ids."""
    blocks: DataFrame
    n_docs: int
    n_terms: int
    id_type: T.DataType


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(terms_of(x.as_py())) for x in batch.column("text")]
        yield pa.RecordBatch.from_pydict({"n_docs": pa.array([sum(s > 0 for s in sizes)], pa.int64()),
                                          "n_terms": pa.array([sum(sizes)], pa.int64())})


#: Number columns of a block, each an array as bytes (Spark would handle the elements of an array one by one).
#: Of each stratum, ascending: m and its documents. Of each term: documents, groups. Of each group, by term, stratum
#: and tf: stratum, tf, documents. Of each posting, by group: the document's number. DOCS is below 2^16.
NUMBERS = {"strata": "<i8", "stratum_docs": "<i4", "term_docs": "<i4", "term_groups": "<i4",
           "group_stratum": "<u2", "group_tf": "<i4", "group_docs": "<u2", "docs": "<u2"}


def _block_schema(id_type: T.DataType) -> T.StructType:
    """ids, fks and rxs are those of the documents, in the order of ties; ``terms`` are joined by blanks."""
    longs, raw = T.ArrayType(T.LongType()), T.BinaryType()
    return T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("fks", longs), T.StructField("rxs", longs),
                         T.StructField("terms", raw), *[T.StructField(c, raw) for c in NUMBERS]])


def numbers(row: dict, name: str) -> np.ndarray:
    return np.frombuffer(row[name], NUMBERS[name]).astype(np.int64)


class _Held:
    """Documents of a block to be: terms as numbers, so that a posting takes eight bytes."""

    def __init__(self):
        self.places: list[tuple] = []  # id, fk, rx, number of terms, distinct terms
        self.known: dict[bytes, int] = {}
        self.term, self.tf = array("i"), array("i")

    def add(self, place: tuple, terms: list[bytes]) -> None:
        counts = Counter(terms)
        self.term.extend([self.known.setdefault(w, len(self.known)) for w in counts])
        self.tf.extend(counts.values())
        self.places.append((*place, len(terms), len(counts)))

    def packed(self, m_of, id_type: pa.DataType) -> pa.RecordBatch:
        held, n_known = self.places, len(self.known)
        order = sorted(range(len(held)), key=lambda d: (held[d][0] is None, 0 if held[d][0] is None else held[d][0], *held[d][1:3]))
        rank = np.empty(len(held), np.int64)
        rank[order] = np.arange(len(held))
        doc = np.repeat(rank, [r[4] for r in held])
        held = [held[d] for d in order]
        strata, stratum = np.unique([m_of(r[3]) for r in held], return_inverse=True)
        term, tf = np.frombuffer(self.term, np.int32), np.frombuffer(self.tf, np.int32)
        order = np.lexsort((doc, tf, stratum[doc], term))
        term, tf, doc = term[order], tf[order], doc[order]
        of = stratum[doc]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (of[1:] != of[:-1]) | (tf[1:] != tf[:-1])])
        values = (strata, np.bincount(stratum, minlength=len(strata)), np.bincount(term, minlength=n_known),
                  np.bincount(term[first], minlength=n_known), of[first], tf[first], np.diff(np.r_[first, len(term)]), doc)
        row = {"ids": pa.array([[r[0] for r in held]], pa.list_(id_type)), "fks": pa.array([[r[1] for r in held]], pa.list_(pa.int64())),
               "rxs": pa.array([[r[2] for r in held]], pa.list_(pa.int64())), "terms": pa.array([b" ".join(self.known)], pa.binary())}
        row |= {c: pa.array([v.astype(kind).tobytes()], pa.binary()) for (c, kind), v in zip(NUMBERS.items(), values)}
        return pa.RecordBatch.from_pydict(row)


def _indexed(n_docs: int, n_terms: int, id_type: pa.DataType, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            return held.packed(lambda n: normaliser(n, n_docs, n_terms), id_type)
        held = _Held()
        for batch in batches:
            places = zip(*[batch.column(c).to_pylist() for c in ("id", "_fk", "_rx")])
            for place, text in zip(places, batch.column("text")):
                if terms := terms_of(text.as_py()):
                    held.add(place, terms)
                    if len(held.places) >= most_docs or len(held.term) >= POSTINGS:
                        yield packed()
                        held = _Held()
        if held.places:
            yield packed()
    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = DOCS) -> Index:
    """The index of all rows of ``docs``, written as a stage."""
    rows = row_keyed(docs).select("_fk", "_rx", field(id_col).alias("id"), field(text_col).cast("string").cast("binary").alias("text"))
    sums = rows.select("text").mapInArrow(_sizes, "n_docs long, n_terms long").agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    id_type = rows.schema["id"].dataType
    schema = _block_schema(id_type)
    path = stage_path(docs.sparkSession)
    rows.mapInArrow(_indexed(sums[0], sums[1], to_arrow_type(id_type), most_docs), schema).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return Index(docs.sparkSession.read.schema(schema).parquet(path), sums[0], sums[1], id_type)


def _found_terms(wanted):
    """Documents of the block that hold each wanted term. ``wanted``: a broadcast list of terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(wanted.value, pa.binary())
        for batch in batches:
            for row in batch.to_pylist():
                at = pc.index_in(vocabulary, value_set=pa.array(row["terms"].split(b" "), pa.binary()))
                df = pa.array(numbers(row, "term_docs"))
                yield pa.RecordBatch.from_arrays([pc.filter(vocabulary, pc.is_valid(at)), pc.take(df, pc.drop_null(at))], names=["term", "df"])
    return run


class _Best:
    """The k best documents of a query so far, as (-score, id is null, id, fk, rx)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """Score that a document must reach."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows)[:self.k]


class _Block:
    """An index block in memory, with the impacts of its groups."""

    def __init__(self, row: dict, vocabulary: pa.Array):
        self.ids, self.fks, self.rxs = (row[c].values for c in ("ids", "fks", "rxs"))
        row = {c: row[c].as_buffer() for c in ("terms", *NUMBERS)}
        self.n_docs = len(self.ids)
        self.docs, self.group_docs, self.stratum, self.stratum_docs, tf, m, groups = (
            numbers(row, c) for c in ("docs", "group_docs", "group_stratum", "stratum_docs", "group_tf", "strata", "term_groups"))
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[self.stratum])
        self.begin = np.cumsum(self.group_docs) - self.group_docs
        ends = np.cumsum(groups)
        self.group_of_term = np.r_[0, ends]
        # the last group of a term's run in a stratum has its largest tf
        term = np.repeat(np.arange(len(ends)), np.diff(self.group_of_term))
        self.largest = np.flatnonzero(np.r_[(term[1:] != term[:-1]) | (self.stratum[1:] != self.stratum[:-1]), True])
        self.run_of_term = np.searchsorted(self.largest, self.group_of_term)
        self.place = pc.index_in(vocabulary, value_set=pa.array(row["terms"].to_pybytes().split(b" "), pa.binary())).to_numpy(zero_copy_only=False)

    def _ranges(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, size = ends[terms], ends[terms + 1] - ends[terms]
        return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(weights, size)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        """``terms``: places in the vocabulary."""
        at = self.place[terms]
        here = ~np.isnan(at)
        at, weights = at[here].astype(np.int64), weights[here]
        if not len(at):
            return
        runs, w = self._ranges(self.run_of_term, at, weights)
        runs = self.largest[runs]
        bound = np.zeros(len(self.stratum_docs), np.int64)
        np.add.at(bound, self.stratum[runs], w * self.impact[runs])
        order = np.argsort(-bound, kind="stable")
        groups, w = self._ranges(self.group_of_term, at, weights)
        gain = w * self.impact[groups]
        docs_so_far, k = np.cumsum(self.stratum_docs[order]), 0
        while k < len(order) and bound[order[k]] >= best.least():
            n = int(np.searchsorted(docs_so_far, 2 * (docs_so_far[k - 1] if k else 0) + best.k)) + 1
            visit = order[k:n]
            visit = visit[bound[visit] >= best.least()]
            self._visit(visit, groups, gain, best)
            k = max(n, k + 1)

    def _visit(self, strata: np.ndarray, groups: np.ndarray, gain: np.ndarray, best: _Best) -> None:
        chosen = np.zeros(len(self.stratum_docs), bool)
        chosen[strata] = True
        own = chosen[self.stratum[groups]]
        groups, gain = groups[own], gain[own]
        size = self.group_docs[groups]
        postings = np.repeat(self.begin[groups] - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.zeros(self.n_docs, np.int64)
        np.add.at(score, self.docs[postings], np.repeat(gain, size))
        found = np.flatnonzero(score >= best.least())
        found = found[np.argsort(-score[found], kind="stable")][:best.k]  # documents are numbered in the order of ties
        rows = []
        for d in found.tolist():
            i, fk, rx = self.ids[d].as_py(), self.fks[d].as_py(), self.rxs[d].as_py()
            rows.append((-int(score[d]), i is None, 0 if i is None else i, fk, rx))
        best.add(rows)


def _searched(queries, k: int, id_type: pa.DataType):
    """``queries``: a broadcast (vocabulary, [(query, places of its terms, weights)])."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, asked = queries.value
        vocabulary = pa.array(words, pa.binary())
        best = [_Best(k) for _ in asked]
        for batch in batches:
            for j in range(batch.num_rows):
                block = _Block({c: batch.column(c)[j] for c in batch.schema.names}, vocabulary)
                for (_, terms, weights), own in zip(asked, best):
                    block.search(terms, weights, own)
        for (q, _, _), own in zip(asked, best):
            if own.rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([q] * len(own.rows), pa.int64()), pa.array([-r[0] for r in own.rows], pa.int64()),
                    pa.array([None if r[1] else r[2] for r in own.rows], id_type),
                    pa.array([r[3] for r in own.rows], pa.int64()), pa.array([r[4] for r in own.rows], pa.int64())],
                    names=["q", "score", "id", "_fk", "_rx"])
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [list(dict.fromkeys(terms_of(x.as_py()))) for x in batch.column("text")]
        yield batch.drop_columns(["text"]).append_column("terms", pa.array(terms, pa.list_(pa.binary())))


def _asked(index: Index, queries: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """Weights of the wanted terms that a document holds."""
    sc = queries.sparkSession.sparkContext
    known = sc.broadcast(wanted)
    df = (index.blocks.select("terms", "term_docs").mapInArrow(_found_terms(known), "term binary, df long")
          .groupBy("term").agg(F.sum("df").alias("df")))
    return {bytes(r["term"]): weight(index.n_docs, r["df"]) for r in df.collect()}  # at most the wanted terms


def search(index: Index, items: DataFrame, k: int = 50, item_id_col: str = "item_id", item_text_col: str = "text",
           most: int = QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``k`` best documents of every item."""
    spark = items.sparkSession
    sc = spark.sparkContext
    texts = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text"))
    item_type = texts.schema["item_id"].dataType
    termed = texts.mapInArrow(_item_terms, T.StructType([T.StructField("item_id", item_type), T.StructField("terms", T.ArrayType(T.BinaryType()))]))
    queries = stage(termed.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
                    .filter(F.size("terms") > 0)
                    .withColumn("size", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t) + 8) + 64 * k))
    n, block = bounded_blocks(queries, "size", ["item_id", "terms"], most)
    found = []
    for b in range(n if index.n_docs else 0):
        asked = queries.filter(block == b).select("item_id", "terms").collect()  # at most ``most``: counted by bounded_blocks
        wanted = sorted({bytes(t) for r in asked for t in r["terms"]})
        weights = _asked(index, queries, wanted)
        vocabulary = sorted(weights)
        at = {t: i for i, t in enumerate(vocabulary)}
        own = []
        for q, r in enumerate(asked):
            known = [t for x in r["terms"] if (t := bytes(x)) in at]
            own.append((q, np.array([at[t] for t in known], np.int64), np.array([weights[t] for t in known], np.int64)))
        sent = sc.broadcast((vocabulary, own))
        rows = index.blocks.mapInArrow(_searched(sent, k, to_arrow_type(index.id_type)), T.StructType([
            T.StructField("q", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", index.id_type),
            T.StructField("_fk", T.LongType()), T.StructField("_rx", T.LongType())]))
        best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "_fk", "_rx")
        ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        named = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(asked)], T.StructType([
            T.StructField("q", T.LongType()), T.StructField("item_id", item_type)]))
        part = ranked.join(F.broadcast(named), "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
        found.append(part if n == 1 else stage(part))
    if not found:
        return spark.createDataFrame([], T.StructType([
            T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", index.id_type), T.StructField("score", T.LongType())]))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
