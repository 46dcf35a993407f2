"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or several sources. Documents are aggregated by
membership pattern (the set of their sources); only these totals meet the
driver. There a min-cost flow routes words from patterns to source quotas:

    start --(pattern size, cost 0, 1, ... a repetition)--> pattern --> source --(quota)--> end

Each further pass over a pattern costs more than the one before (convex
repetition costs), so nothing is repeated while an unused document could serve
the same quota, and no document is taken more than ``max_copies`` times. The
flow of a pattern is then turned into documents: whole passes go to all of
them, and the rest ``r`` of a pass goes to documents in the order of a seeded
hash of (id, text) until ``r`` words are reached, to the nearest document.

The order is cut by a radix descent, not by sorting a source: words are summed
per pattern and 12-bit hash bucket, the bucket where the sum passes ``r`` is
split by the next 12 bits, and only the distinct documents of that cell (one in
16 million) are summed one by one. Rows alike in id and text, of which there
may be very many, are cut by the same descent over a hash of their places.

Sizes are numbers of words between ASCII white space, null texts have none.
Sources are ordered by code point with null last and weigh ``weights`` in turn;
the words to take are ``ratio`` of all words, shared by weight; a target stops
at ``max_copies`` times its source's words and the excess is shared again by
weight until no target is above that.

Defined cases: a null source is a source of its own; documents without words
take no words (in ``mix`` they are passed on like others of their pattern);
rows alike in id and text are told apart by their file and row number; an
empty table gives an empty result. Patterns are the only thing collected: their
number is that of distinct source sets, not of documents. Patterns of one
source are settled in closed form, so the flow only sees those that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import field, giving_back, join_by_key, row_keyed, stage

WEIGHTS = (3, 1, 2)
RATIO = 1.5
MAX_COPIES = 2
SEED = 11
_BITS = 12


class _Flow:
    """Maximum flow by blocking flows over levels (Dinic)."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for node, other, r in ((a, b, room), (b, a, 0)):
            self.out[node].append(len(self.to))
            self.to.append(other)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self, start: int) -> list[int]:
        level = [-1] * len(self.out)
        level[start], now = 0, [start]
        while now:
            then = []
            for a in now:
                for e in self.out[a]:
                    b = self.to[e]
                    if level[b] < 0 and self.room[e] > 0:
                        level[b] = level[a] + 1
                        then.append(b)
            now = then
        return level

    def run(self, start: int, end: int) -> None:
        """Adds to the flow until no way from ``start`` to ``end`` has room."""
        to, room, out = self.to, self.room, self.out
        while (level := self._levels(start))[end] >= 0:
            tried, path, a = [0] * len(out), [], start
            while True:
                if a == end:
                    push = min(room[e] for e in path)
                    for e in path:
                        room[e] -= push
                        room[e ^ 1] += push
                    while path and room[path[-1]] > 0:
                        path.pop()
                    k = next(i for i, e in enumerate(path) if room[e] == 0)
                    del path[k:]
                    a = to[path[-1]] if path else start
                    continue
                while tried[a] < len(out[a]):
                    e = out[a][tried[a]]
                    if room[e] > 0 and level[to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(out[a]):
                    path.append(out[a][tried[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break


def source_targets(sizes: dict[str | None, int], words: int, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO,
                   most: float = MAX_COPIES) -> dict[str | None, float]:
    """Words to take from each source (see the module). ``words``: those of all
    documents, less than the sum of ``sizes`` if sources overlap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = {s: 0.0 for s in order}
    left, open_ = ratio * words, [s for s in order if sizes[s] > 0]
    # the sources that fill up first come first
    open_.sort(key=lambda s: most * sizes[s] / weight[s])
    shares = sum(weight[s] for s in open_)
    for i, s in enumerate(open_):
        if left <= 0:
            break
        if weight[s] * left < most * sizes[s] * shares:
            target |= {x: weight[x] * left / shares for x in open_[i:]}
            break
        target[s] = float(most * sizes[s])
        left -= target[s]
        shares -= weight[s]
    return target


def route(patterns: Sequence[tuple[tuple[str | None, ...], int]], targets: dict[str | None, float],
          max_copies: int = MAX_COPIES) -> list[int]:
    """Words that each (sources, size) pattern gives, at least repetition cost.

    A source that no pattern shares with another is settled at once. For the
    others only the arcs into patterns cost anything, and a flow once sent
    through such an arc is never taken back, so the passes are opened one after
    the other, each followed by a maximum flow.
    """
    shared = {s for sources, _ in patterns if len(sources) > 1 for s in sources}
    gives = [0] * len(patterns)
    left = {s: round(t) for s, t in targets.items()}
    linked = []
    for p, (sources, size) in enumerate(patterns):
        if sources[0] in shared:
            linked.append(p)
        else:
            gives[p] = min(left[sources[0]], max_copies * size)
            left[sources[0]] -= gives[p]
    names = sorted(shared, key=str)
    at = {s: 2 + len(linked) + i for i, s in enumerate(names)}
    net = _Flow(2 + len(linked) + len(names))
    passes = []
    for i, p in enumerate(linked):
        sources, size = patterns[p]
        passes.append(net.arc(0, 2 + i, 0))
        for s in sources:
            net.arc(2 + i, at[s], max_copies * size)
    for s in names:
        net.arc(at[s], 1, left[s])
    for _ in range(max_copies):
        for e, p in zip(passes, linked):
            net.room[e] += patterns[p][1]
        net.run(0, 1)
    for e, p in zip(passes, linked):
        gives[p] = net.room[e ^ 1]
    return gives


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [0 if x is None else len(x.split()) for x in batch.column("text").to_pylist()]
        yield batch.drop_columns(["text"]).append_column("size", pa.array(sizes, pa.int64()))


def _pattern(source: Column, is_array: bool) -> Column:
    sources = F.coalesce(F.array_sort(F.array_distinct(source)), F.array(F.lit(None).cast("string"))) \
        if is_array else F.array(source.cast("string"))
    return F.to_json(F.when(F.size(sources) > 0, sources).otherwise(F.array(F.lit(None).cast("string"))))


def _order(id_col: Column, text: Column, seed: int) -> Column:
    """Seeded place of a document in its pattern, as an unsigned 63-bit number."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 1)


def _tie(seed: int) -> Column:
    """Seeded place of a row among those alike in id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_fk", "_rx"), 1)


def _level(order: Column, level: int) -> Column:
    return F.shiftright(order, 63 - _BITS * level).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")


def _cut(rows: DataFrame, left: DataFrame, part: Column, name: str) -> DataFrame:
    """Per pattern: the ``part`` in whose rows the running size passes what is left, and what is left there."""
    before = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("pattern", part.alias("part")).agg(F.sum("size").alias("in_part"))
    # at most 4096 rows a pattern, or the distinct documents of a cell
    running = sums.withColumn("before", F.coalesce(F.sum("in_part").over(before), F.lit(0)))
    return (running.join(left.select("pattern", "left"), "pattern")
            .filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("in_part") > F.col("left")))
            .select("pattern", F.col("part").alias(name), (F.col("left") - F.col("before")).alias("left")))


#: The steps of the descent: name of the cut, and the part of a row that it cuts.
_STEPS = (("cut1", lambda: _level(F.col("place"), 1)), ("cut2", lambda: _level(F.col("place"), 2)), ("cut3", lambda: F.col("place")),
          ("cut4", lambda: _level(F.col("tie"), 1)), ("cut5", lambda: _level(F.col("tie"), 2)))


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, ratio: float = RATIO,
             max_copies: int = MAX_COPIES) -> tuple[DataFrame, int]:
    """Per pattern what to take, and the number of rows. ``sized``: a stage with _fk, _rx, pattern, place, tie, size."""
    spark: SparkSession = sized.sparkSession
    totals = [(r["pattern"], r["sources"], r["words"], r["n"]) for r in
              sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
              .withColumn("sources", F.from_json("pattern", "array<string>")).orderBy("pattern").collect()]
    sizes: dict[str | None, int] = {}
    for _, sources, words, _ in totals:
        for s in sources:
            sizes[s] = sizes.get(s, 0) + words
    targets = source_targets(sizes, sum(words for _, _, words, _ in totals), weights, ratio, max_copies)
    flows = route([(tuple(s), w) for _, s, w, _ in totals], targets, max_copies)
    rows = [(p, n, f // w if w else 1, f % w if w else 0, sizes[s[0]], targets[s[0]])
            for (p, s, w, n), f in zip(totals, flows)]
    plan = spark.createDataFrame(rows, T.StructType([
        T.StructField("pattern", T.StringType()), T.StructField("n_docs", T.LongType()),
        T.StructField("passes", T.LongType()), T.StructField("left", T.LongType()),
        T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]))
    n = sum(t[3] for t in totals)
    plan = stage(plan)
    cell, left, found = sized, plan, plan
    for name, part in _STEPS:
        cut = stage(_cut(cell, left, part(), name))
        found = found.join(cut.select("pattern", name), "pattern", "left")
        sided = cut.join(plan.select("pattern", "n_docs"), "pattern").select("pattern", name, "n_docs")
        cell = stage(join_by_key(cell, sided, ["pattern"], "n_docs", n, ["_fk", "_rx", "place"])
                     .filter(part() == F.col(name)).select(*sized.columns))
        left = cut
    # a cell of the last cut holds one in 2 ** 24 of the rows alike in id and text
    before = Window.partitionBy("pattern").orderBy("tie", "_fk", "_rx").rowsBetween(Window.unboundedPreceding, -1)
    ends = (cell.join(left, "pattern").withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
            .filter(F.col("before") + F.col("size") / 2 <= F.col("left"))
            .groupBy("pattern").agg(F.max(F.struct("tie", "_fk", "_rx")).alias("end")))
    return stage(found.join(ends, "pattern", "left")), n


def _copies() -> Column:
    """Times a row is taken, from its place and its pattern's plan."""
    own = F.struct(F.col("tie"), F.col("_fk"), F.col("_rx"))
    more = F.coalesce(own <= F.col("end"), F.lit(False))
    for name, part in reversed(_STEPS):
        more = (part() < F.col(name)) | ((part() == F.col(name)) & more)
    return F.col("passes") + F.coalesce(more, F.lit(False)).cast("long")


def _sized(keyed: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    is_array = isinstance(keyed.schema["_row"].dataType[source_col].dataType, T.ArrayType)
    text = field(text_col).cast("string")
    rows = keyed.select("_fk", "_rx", field(id_col).alias("id"), _pattern(field(source_col), is_array).alias("pattern"),
                        _order(field(id_col), text, seed).alias("place"), _tie(seed).alias("tie"), text.cast("binary").alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(giving_back(_word_counts), T.StructType([*kept, T.StructField("size", T.LongType())]))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, max_copies: int = MAX_COPIES,
               seed: int = SEED) -> DataFrame:
    """Per row: id, size, source_size, target, taken, copies. For a document of
    several sources, source_size and target are those of its first."""
    sized = stage(_sized(row_keyed(docs), id_col, text_col, source_col, seed))
    plan, n = plan_mix(sized, weights, ratio, max_copies)
    met = join_by_key(sized, plan, ["pattern"], "n_docs", n, ["_fk", "_rx"]).withColumn("copies", _copies())
    return met.select(F.col("id").alias(id_col), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = WEIGHTS, ratio: float = RATIO, max_copies: int = MAX_COPIES,
        seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken."""
    keyed = row_keyed(docs)
    plan, n = plan_mix(stage(_sized(keyed, id_col, text_col, source_col, seed)), weights, ratio, max_copies)
    is_array = isinstance(keyed.schema["_row"].dataType[source_col].dataType, T.ArrayType)
    placed = keyed.withColumns({"pattern": _pattern(field(source_col), is_array),
                                "place": _order(field(id_col), field(text_col).cast("string"), seed), "tie": _tie(seed)})
    met = join_by_key(placed, plan, ["pattern"], "n_docs", n, ["_fk", "_rx"])
    return (met.withColumn("copies", _copies()).filter(F.col("copies") > 0)
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("_row.*"))
