"""Random forest on sparse rows (M6): the classes of rows whose features are mostly zero.

Trees grow level by level, as many at once as ``ROW_TREES`` allows. A row is kept
as its non-zero features and their bins, with the node it has reached in each tree.
A level counts (node, feature, bin, class) of the non-zero features alone, what a
node holds is known from its parent, so zeros are never counted; the counts meet by
node in a shuffle and each node's best split (Gini) goes to the driver, which numbers
the next level. Rows to be scored go down with the others and add the class shares of
the leaves that they end in, so no tree is ever held whole.

Settings as MLlib's: bootstrap by Poisson draws, ceil(sqrt(features)) of the features
offered to a node, 32 bins (zero and 31 quantiles of the other values), splits of
positive gain, a leaf at ``depth`` or where a node is pure or no offered feature splits it.

Bounds: the driver and each task hold one level's nodes (their class counts and splits),
a task further one batch of rows and the counts of its share of the nodes.

Defined cases: the smallest feature and cut among equal splits, the smallest class among
equal votes; rows without features go down on the side of zeros; a negative value raises.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_path

#: Bins of a feature: zero and the quantiles of its other values.
BINS = 32
#: Rows times trees grown at once, which bounds a level's nodes.
ROW_TREES = 100_000_000
#: Levels that rows go down from a stage before the next one is written.
LEVELS = 5
#: Rows of a partition, about.
PARTITION_ROWS = 1 << 15
#: Numbers of a block of rows with all their features, and its most rows.
BLOCK, BLOCK_ROWS = 1 << 23, 1 << 12
#: Counts that a task keeps before it adds up equal ones, and about the most of whole nodes' counts worked on at once.
PENDING, DENSE = 1 << 22, 1 << 22
#: Orders of the features in which a level's nodes are offered runs, and the most features of which these begin at any place.
STEPS, ANY_PLACE = 4, 256
#: One in so many (bin, class) cells of a node's feature are counted: from there on all its cells are laid out, some at once.
THICK, CELLS = 8, 1 << 19
#: Counts sent at once.
SENT = 1 << 20
#: Of the bootstrap draws: the Poisson distribution of mean one, by draw.
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


class Level(NamedTuple):
    """The nodes of a level of all trees."""
    feature: np.ndarray  # -1 for a leaf
    cut: np.ndarray      # last bin of the left side
    child: np.ndarray    # both sides: the next level's node, or -2 - leaf
    leaves: tuple[np.ndarray, np.ndarray]  # ends and (class, count) pairs


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column end to end, and how many each row has."""
    if not len(column):
        return np.empty(0, dtype), np.zeros(0, np.int64)
    column = column.cast(pa.binary())
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    if at[-1] == at[0]:
        return np.empty(0, dtype), np.zeros(len(column), np.int64)
    return (np.frombuffer(column.buffers()[2], dtype, (int(at[-1]) - int(at[0])) // size, int(at[0])),
            np.diff(at).astype(np.int64) // size)


def _binary(numbers: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of which each row has its count of the numbers."""
    at = np.r_[0, np.cumsum(counts * numbers.dtype.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(numbers))])


def _table(column: pa.Array, dtype, width: int) -> np.ndarray:
    return _flat(column, dtype)[0].reshape(len(column), width)


def _rows_of(numbers: np.ndarray) -> pa.Array:
    return _binary(numbers.ravel(), np.full(len(numbers), numbers.shape[1], np.int64))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _counted(packed: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``_added``, of keys that have their counts in the last four bits."""
    both = np.sort(np.concatenate(packed))
    key, count = both >> 4, both & 15
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _bucketed(bucket: np.ndarray, buckets: int, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row a bucket of keys and their counts."""
    order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
    held = np.bincount(bucket, minlength=buckets)
    full = np.flatnonzero(held)
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), _binary(key[order], held[full]),
                                       _binary(count[order], held[full])], names=["bucket", "key", "n"])


def _met(parts: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some buckets' rows with the sums of their counts."""
    got = [(_flat(p.column(0), np.int64)[0], _flat(p.column(1), np.int64)[0]) for p in parts]
    return _added([np.empty(0, np.int64), *(k for k, _ in got)], [np.empty(0, np.int64), *(n for _, n in got)])


def _buckets(spark) -> int:
    return 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _spans(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs of some rows, one row after the other, and how many each has."""
    length = ends[which + 1] - ends[which]
    return np.repeat(ends[which] - (np.cumsum(length) - length), length) + np.arange(length.sum()), length


def _vectors(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the non-zero features of a batch of vectors."""
    kind, indices, values = (column.field(n) for n in ("type", "indices", "values"))
    value, n = np.asarray(values.flatten()), np.asarray(values.value_lengths())
    row = np.repeat(np.arange(len(column)), n)
    if np.asarray(kind).all():  # dense rows
        feature = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    elif not np.asarray(kind).any():
        feature = np.asarray(indices.flatten())
    else:
        feature = np.concatenate([np.arange(len(v)) if t else np.asarray(i) for t, i, v in zip(
            kind.to_pylist(), indices.to_pylist(), values.to_pylist())])
    if len(value) and not value.min() >= 0:
        raise ValueError("features must not be negative")
    kept = value > 0
    return row[kept], feature[kept].astype(np.int64), value[kept]


def _quantiles(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The BINS - 2 inner quantiles of ascending values that occur ``n`` times each, between two values in proportion."""
    run = np.cumsum(n)
    place = (run[-1] - 1) * (np.arange(1, BINS - 1) / (BINS - 1))
    low, high = np.floor(place), np.ceil(place)
    below, above = (value[np.searchsorted(run, x + 1)] for x in (low, high))
    return np.where(below == above, below, (high - place) * below + (place - low) * above)


def cuts(rows: DataFrame, features: str, size: int) -> np.ndarray:
    """Features x (BINS - 2): the values up to which the bins of the non-zero values reach, without repeats."""
    buckets = _buckets(rows.sparkSession)

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, pending = [], [], 0
        for part in parts:
            _, feature, value = _vectors(part.column(0))
            cell = value.astype(np.float32).view(np.int32) >> 16  # 128 cells an octave
            keys.append(feature << 16 | cell)
            counts.append(np.ones(len(cell), np.int64))
            pending += len(cell)
            if pending > PENDING:
                key, count = _added(keys, counts)
                keys, counts, pending = [key], [count], len(key) // 2
        if keys:
            key, count = _added(keys, counts)
            for lo in range(0, len(key), SENT):  # a row a bucket of features
                k = key[lo:lo + SENT]
                yield _bucketed((k >> 16) % buckets, buckets, k, count[lo:lo + SENT])

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = _met(parts)
        feature, value = key >> 16, ((((key & 0xFFFF) << 16) | 0xFFFF).astype(np.int32).view(np.float32)).astype(np.float64)
        bounds = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]]) if len(key) else np.empty(0, np.int64)
        found = []
        for lo, hi in zip(bounds, np.r_[bounds[1:], len(key)]):
            at = _quantiles(value[lo:hi], n[lo:hi])
            found.append(np.unique(at[at < value[hi - 1]]))
        yield pa.RecordBatch.from_arrays([
            pa.array(feature[bounds].astype(np.int32)),
            _binary(np.concatenate([np.empty(0), *found]), np.array([len(f) for f in found], np.int64))],
            names=["feature", "cuts"])

    got = rows.select(features).mapInArrow(cells, "bucket int, key binary, n binary").repartition("bucket").select("key", "n") \
        .mapInArrow(choose, "feature int, cuts binary").collect()
    out = np.full((size, BINS - 2), np.inf)
    for r in got:
        own = np.frombuffer(r["cuts"], np.float64)
        out[r["feature"], :len(own)] = own
    return out


def _binned(rows: DataFrame, label: str, features: str, edges: np.ndarray, classes: int) -> DataFrame:
    """(_label, _ids, _bins, _votes) in place of the features: -1 for rows to be scored."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)
    rest = [c for c in rows.columns if c not in (label, features)]

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            row, feature, value = _vectors(part.column("_features"))
            bins = np.ones(len(row), np.uint8)
            for lo in range(0, len(row), 1 << 16):
                to = slice(lo, lo + (1 << 16))
                bins[to] += (shared.value[feature[to]] < value[to, None]).sum(1).astype(np.uint8)
            n = np.bincount(row, minlength=part.num_rows)
            votes = np.zeros((part.num_rows, 0 if not part.num_rows else classes))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in rest] + [part.column("_label"), _binary(feature.astype(np.int32), n),
                                                  _binary(bins, n), _rows_of(votes)],
                names=[*rest, "_label", "_ids", "_bins", "_votes"])

    given = rows.select(*rest, F.coalesce(F.col(label).cast("int"), F.lit(-1)).alias("_label"), F.col(features).alias("_features"))
    return given.mapInArrow(encode, _schema(given.drop("_features"), "_ids binary, _bins binary, _votes binary"))


def _schema(df: DataFrame, more: str):
    from pyspark.sql.types import StructType
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def _begin(rows: DataFrame, trees: int, group: int, seed: int) -> DataFrame:
    """Every row at the root of every tree, with its bootstrap draws."""

    def begin(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, group, TaskContext.get().partitionId()])
        for part in parts:
            draws = np.searchsorted(POISSON, rng.random((part.num_rows, trees)), "right").astype(np.uint8)
            draws[np.asarray(part.column("_label")) < 0] = 0
            node = np.tile(np.arange(trees, dtype=np.int32), (part.num_rows, 1))
            yield pa.RecordBatch.from_arrays([*part.columns, _rows_of(node), _rows_of(draws)],
                                             names=[*part.schema.names, "_node", "_draws"])

    return rows.mapInArrow(begin, _schema(rows, "_node binary, _draws binary"))


def _root_counts(state: DataFrame, trees: int, classes: int) -> np.ndarray:
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((classes, trees), np.int64)
        for part in parts:
            label = np.asarray(part.column("_label"))
            draws = _table(part.column("_draws"), np.uint8, trees)
            for c in range(classes):
                found[c] += draws[label == c].sum(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes * trees, dtype=np.int32)), pa.array(found.ravel())],
                                         names=["cell", "n"])

    got = state.select("_label", "_draws").mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(classes * trees, np.int64)
    out[np.asarray(got.column("cell"))] = np.asarray(got.column("n"))
    return out.reshape(classes, trees).T


def _sums_above(pair: np.ndarray, bins: np.ndarray, label: np.ndarray, n: np.ndarray, in_node: np.ndarray,
                classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each (pair, bin) in ascending counts, over what lies at or above it: the count, the sum of its squares by class and
    that of its products with ``in_node``, the count of the class in the node."""
    # bins from above, by class: what the sum of the squares at or above a bin grows by with each count
    down = np.argsort((pair * classes + label) * BINS + BINS - 1 - bins)
    group = (pair * classes + label)[down]
    begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    run = np.cumsum(n[down])
    run -= np.repeat(run[begins] - n[down][begins], np.diff(np.r_[begins, len(run)]))
    grown = np.empty_like(n)
    grown[down] = run ** 2 - (run - n[down]) ** 2
    # from the end, less those of the later pairs
    other = pair[1:] != pair[:-1]
    first = np.flatnonzero(np.r_[True, other | (bins[1:] != bins[:-1])])
    end = np.r_[np.flatnonzero(other) + 1, len(pair)][np.r_[0, np.cumsum(other)][first]]
    return tuple(x[first] - x[end] for x in (np.r_[np.cumsum(x[::-1])[::-1], 0] for x in (n, grown, in_node * n)))


def _sums_above_laid_out(pair: np.ndarray, bins: np.ndarray, label: np.ndarray, n: np.ndarray, in_node: np.ndarray,
                         classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_sums_above``, with all cells of some pairs at a time."""
    begins = np.r_[np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]), len(pair)]
    at_once, out = max(1, CELLS // (BINS * classes)), []
    for lo in range(0, len(begins) - 1, at_once):
        hi = min(lo + at_once, len(begins) - 1)
        own = slice(int(begins[lo]), int(begins[hi]))
        which = np.repeat(np.arange(hi - lo), np.diff(begins[lo:hi + 1]))
        counts, held = np.zeros((hi - lo, BINS, classes)), np.zeros((hi - lo, classes))
        counts[which, bins[own], label[own]] = n[own]
        held[which, label[own]] = in_node[own]
        there = counts.any(2)
        counts = np.cumsum(counts[:, ::-1], 1)[:, ::-1]
        out.append([x[there].astype(np.int64) for x in (
            counts.sum(2), np.einsum("pbc,pbc->pb", counts, counts), np.einsum("pbc,pc->pb", counts, held))])
    return tuple(np.concatenate(x) for x in zip(*out))


def best_splits(key: np.ndarray, count: np.ndarray, whole: tuple[np.ndarray, np.ndarray], size: int,
                classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, feature, last bin of the left side, left counts by class) of the nodes that split.
    Keys are (node, feature, bin, class), ascending; ``whole`` has the nodes' class counts: ends and (class, count) pairs."""
    ends, pairs = whole
    node = key // (size * BINS * classes)
    bounds = np.r_[np.flatnonzero(np.r_[True, node[1:] != node[:-1]]), len(key)]
    out, lo = [], 0
    while lo < len(bounds) - 1:  # whole nodes, about DENSE counts at a time
        hi = max(lo + 1, min(int(np.searchsorted(bounds, bounds[lo] + DENSE, "right")) - 1, lo + DENSE // classes))
        own = slice(int(bounds[lo]), int(bounds[hi]))
        used, which = node[bounds[lo:hi]], np.repeat(np.arange(hi - lo), np.diff(bounds[lo:hi + 1]))
        lo = hi
        at, length = _spans(ends, used)
        held, in_class = np.repeat(np.arange(len(used)), length), pairs[at, 1].astype(np.int64)
        total, squares = (np.bincount(held, x, len(used)) for x in (in_class, in_class ** 2))
        cell, n = key[own] // classes, count[own].astype(np.int64)
        label = key[own] - cell * classes
        in_node = np.zeros(len(used) * classes, np.int64)
        in_node[held * classes + pairs[at, 0]] = in_class
        in_node = in_node[which * classes + label]
        pair = cell // BINS
        bins = cell - pair * BINS
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        begins = np.r_[np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]), len(pair)]
        held = np.diff(begins)
        thick = np.repeat(held > BINS * classes // THICK, held)
        numbered = np.repeat(np.arange(len(held)), held)
        above = np.empty((3, len(first)), np.int64)
        for kind, sums in ((thick, _sums_above_laid_out), (~thick, _sums_above)):
            if kind.any():
                above[:, kind[first]] = sums(*(x[kind] for x in (numbered, bins, label, n, in_node)), classes)
        n_right, right, cross = above
        which = which[first]
        n_left = total[which] - n_right
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = (squares[which] - 2 * cross + right) / n_left + right / n_right
        alone = squares / np.maximum(total, 1)
        fit[(n_left == 0) | (n_right == 0)] = -1
        fit[fit <= alone[which] * (1 + 1e-12)] = -1
        best = np.maximum.reduceat(fit, np.flatnonzero(np.r_[True, which[1:] != which[:-1]]))
        top = np.flatnonzero((fit == best[which]) & (fit >= 0))
        top = top[np.r_[True, which[top][1:] != which[top][:-1]]] if len(top) else top
        left = np.zeros((len(top), classes), np.int64)
        at, length = _spans(ends, used[which[top]])
        left[np.repeat(np.arange(len(top)), length), pairs[at, 0]] = pairs[at, 1]
        length = begins[1:][numbered[first[top]]] - first[top]
        at = np.repeat(first[top] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        np.subtract.at(left, (np.repeat(np.arange(len(top)), length), label[at]), n[at])
        out.append((used[which[top]], cell[first[top]] // BINS % size, cell[first[top]] % BINS - 1, left))
    return tuple(np.concatenate(x) for x in zip(*out))


def _sparse(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and (class, count) pairs of rows of counts."""
    row, label = np.nonzero(counts)
    return (np.r_[0, np.cumsum(np.bincount(row, minlength=len(counts)))],
            np.stack([label, counts[row, label]], 1).astype(np.int32).reshape(-1, 2))


def _blocks(part: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """(rows as a slice, row, feature and bin of what is not zero, count by row) of some rows of a batch at a time."""
    ids, n = _flat(part.column("_ids"), np.int32)
    bins, _ = _flat(part.column("_bins"), np.uint8)
    ends = np.r_[0, np.cumsum(n)]
    rows = max(1, min(BLOCK_ROWS, BLOCK // size))
    for lo in range(0, len(n), rows):
        hi = min(lo + rows, len(n))
        own = slice(int(ends[lo]), int(ends[hi]))
        yield slice(lo, hi), np.repeat(np.arange(hi - lo), n[lo:hi]), ids[own], bins[own], n[lo:hi]


def _descend(node: np.ndarray, bins: np.ndarray, level: Level) -> np.ndarray:
    """The nodes of rows (rows x trees) one level down, -2 - leaf in a leaf; ``bins`` has rows x features."""
    at = np.maximum(node, 0)
    side = np.take_along_axis(bins, level.feature[at], 1) > level.cut[at]
    return np.where(node >= 0, level.child.ravel()[2 * at + side], -1)


def _remainder(numbers: np.ndarray, size: int) -> np.ndarray:
    by = numbers.dtype.type(size)
    return numbers - numbers // by * by


def _inverses(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature of each place in ``mixed``, and what takes a step back (0 if it has a divisor of the size)."""
    size = len(mixed)
    return np.argsort(mixed), np.array([pow(u, -1, size) if math.gcd(u, size) == 1 else 0 for u in range(max(size, 2))],
                                        mixed.dtype)


def _sought(own: np.ndarray, bins: np.ndarray, inverses: tuple[np.ndarray, np.ndarray], step: np.ndarray, start: np.ndarray,
            offered: int, filled: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``own``, feature, bin) of what is not zero among the features that rows' nodes ``own`` (-1 for none; rows, or
    rows x trees) are offered: those whose place times step plus start lies below ``offered``. ``bins`` has rows x features;
    ``filled``, if known, row and feature of what is not zero, by row.

    A step puts the features in an order in which a node is offered a run, so that the non-zero features of a row are sorted
    once a step, counted up to the ends of the runs, and a node finds its own by two of these counts."""
    rows, size = bins.shape
    trees = own.size // max(rows, 1)
    at_place, back = inverses
    nodes = own.ravel()
    live, found = np.flatnonzero(nodes >= 0), []
    steps = step[nodes[live]]
    row, feature = np.nonzero(bins) if filled is None else filled
    lies = row * size
    value = bins.ravel()[lies + feature]
    for k in np.flatnonzero(np.bincount(step[:-1].astype(np.int64))):
        at = live[steps == k]
        order = at_place[_remainder(back[k] * np.arange(size, dtype=back.dtype), size)]
        turn = np.empty(size, np.int64)
        turn[order] = np.arange(size)
        turned = np.sort((lies + turn[feature]) << 8 | value)
        place = (turned >> 8) - lies
        begin = (size - start[nodes[at]].astype(np.int64)) % size
        end = begin + offered
        over = np.flatnonzero(end > size)  # runs that go on from the first place
        at = np.r_[at, at[over]]
        begin, end = np.r_[begin, np.zeros(len(over), np.int64)], np.r_[np.minimum(end, size), end[over] - size]
        mark = np.zeros(size + 1, bool)
        mark[0] = mark[begin] = mark[end] = True
        part = np.cumsum(mark) - 1
        parts = int(part[-1]) + 1
        before = np.r_[0, np.cumsum(np.bincount(row * parts + part[place], minlength=rows * parts))]
        r = at // trees * parts
        begin, end = before[r + part[begin]], before[r + part[end]]
        length = end - begin
        which = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        found.append((np.repeat(at, length), order[place[which]], turned[which] & 255))
    return tuple(np.concatenate(x) for x in zip(*found))


def _splits(state: DataFrame, levels: list[Broadcast], whole: tuple[np.ndarray, np.ndarray], level_seed: list[int],
            trees: int, size: int, classes: int) -> pa.Table:
    """node, feature, bin, and the (class, count) pairs of both sides of the nodes that split, ``levels`` below the state."""
    rng = np.random.default_rng(level_seed)
    nodes, offered = len(whole[0]) - 1, math.ceil(math.sqrt(size))
    units = np.array([u for u in range(1, max(size, 2)) if math.gcd(u, size) == 1])
    # a node is offered the features that its step, one of a few, and its start take below ``offered``: of many features one
    # of the full runs that lie end to end, which keeps their ends few
    apart = offered if size > ANY_PLACE else 1
    number = np.uint32 if size < 1 << 16 else np.uint64  # of size * size; the last step and start are for no node
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast((
        _inverses(rng.permutation(size).astype(number)), np.r_[rng.choice(rng.choice(units, STEPS), nodes), 0].astype(number),
        np.r_[size - apart * rng.integers(0, size // apart, nodes), size].astype(number) % size, whole))
    buckets = _buckets(spark)
    if nodes * size * BINS * classes >= 1 << 59:
        raise ValueError("too many features and classes")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverses, step, start, _ = shared.value
        keys, counts, packed, pending = [], [], [], 0
        for part in parts:
            labels = np.asarray(part.column("_label"))
            nodes, draws = (_table(part.column(c), t, trees) for c, t in (("_node", np.int32), ("_draws", np.uint8)))
            for rows, row, feature, bins, n in _blocks(part, size):
                node = np.where(draws[rows] > 0, nodes[rows], -1)
                whole_rows = np.zeros((len(n), size), np.uint8)
                whole_rows[row, feature] = bins
                for level in levels:
                    node = _descend(node, whole_rows, level.value)
                node = np.maximum(node, -1)
                at, f, b = _sought(node, whole_rows, inverses, step, start, offered, (row, feature))
                key = ((node.ravel()[at] * np.int64(size) + f) * BINS + b) * classes + labels[rows][at // trees]
                packed.append(key << 4 | draws[rows].ravel()[at])
                pending += len(at)
                if pending > PENDING:
                    key, total = _counted(packed)
                    key, total = _added([*keys, key], [*counts, total])
                    keys, counts, packed, pending = [key], [total], [], len(key) // 2
        if keys or packed:
            key, n = _counted(packed or [np.empty(0, np.int64)])
            key, n = _added([*keys, key], [*counts, n])
            for lo in range(0, len(key), SENT):  # a row a bucket of nodes
                k = key[lo:lo + SENT]
                yield _bucketed(k // (size * BINS * classes) % buckets, buckets, k, n[lo:lo + SENT])

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, whole = shared.value
        key, n = _met(parts)
        if not len(key):
            return
        node, feature, cut, left = best_splits(key, n, whole, size, classes)
        ends, pairs = whole
        at, length = _spans(ends, node)
        right = -left
        right[np.repeat(np.arange(len(node)), length), pairs[at, 0]] += pairs[at, 1]
        sides = [_binary(p.ravel(), 2 * np.diff(e)) for e, p in (_sparse(left), _sparse(right))]
        yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(feature.astype(np.int32)),
                                          pa.array(cut.astype(np.int32)), *sides],
                                         names=["node", "feature", "bin", "left_side", "right_side"])

    got = state.filter("_label >= 0").select("_label", "_ids", "_bins", "_node", "_draws") \
        .mapInArrow(count, "bucket int, key binary, n binary").repartition("bucket").select("key", "n") \
        .mapInArrow(choose, "node int, feature int, bin int, left_side binary, right_side binary").toArrow()
    shared.destroy()
    return got.combine_chunks()


def _moved(state: DataFrame, levels: list[Broadcast], trees: int, size: int, classes: int) -> DataFrame:
    """Rows ``levels`` below; those to be scored take the class shares of the leaves they reach."""

    def move(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = []
        for ends, pairs in (level.value.leaves for level in levels):
            run = np.r_[0, np.cumsum(pairs[:, 1], dtype=np.int64)][ends]
            shares.append(pairs[:, 1] / np.repeat(np.diff(run), np.diff(ends)))
        for part in parts:
            node = _table(part.column("_node"), np.int32, trees).copy()
            votes = _table(part.column("_votes"), np.float64, classes).copy()
            labels = np.asarray(part.column("_label"))
            for rows, row, feature, bins, n in _blocks(part, size):
                whole_rows = np.zeros((len(n), size), np.uint8)
                whole_rows[row, feature] = bins
                scored = np.flatnonzero(labels[rows] < 0)
                for level, share in zip(levels, shares):
                    node[rows] = _descend(node[rows], whole_rows, level.value)
                    ends, pairs = level.value.leaves
                    who, tree = np.nonzero(node[rows][scored] < -1)
                    at, length = _spans(ends, -2 - node[rows][scored[who], tree])
                    place = (np.repeat(scored[who], length) + rows.start) * classes + pairs[at, 0]
                    np.add.at(votes.ravel(), place, share[at])
            node = np.maximum(node, -1)
            own = {"_node": _rows_of(node), "_votes": _rows_of(votes)}
            yield pa.RecordBatch.from_arrays([own.get(c, part.column(c)) for c in part.schema.names], names=part.schema.names)

    return state.mapInArrow(move, state.schema)


def _next_level(got: pa.Table, whole: tuple[np.ndarray, np.ndarray],
                last: bool) -> tuple[Level, tuple[np.ndarray, np.ndarray]]:
    """A level of the splits that were found, and the class counts of the next level's nodes."""
    ends, pairs = whole
    nodes = len(ends) - 1
    feature, cut = np.full(nodes, -1, np.int32), np.zeros(nodes, np.int32)
    node = np.asarray(got.column("node"))
    feature[node], cut[node] = np.asarray(got.column("feature")), np.asarray(got.column("bin"))
    flat, sizes = [], []
    for side in ("left_side", "right_side"):
        column = got.column(side).combine_chunks()
        for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
            numbers, n = _flat(part, np.int32)
            flat.append(numbers.reshape(-1, 2))
            sizes.append(n // 2)
    still = np.flatnonzero(feature < 0)  # leaves of this level
    at, length = _spans(ends, still)
    sizes, flat = np.concatenate([*sizes, length]), np.concatenate([*flat, pairs[at]])
    grows = (sizes > 1) & (not last)
    grows[2 * len(node):] = False
    code = np.where(grows, np.cumsum(grows) - 1, -1 - np.cumsum(~grows))
    child = np.empty((nodes, 2), np.int32)
    child[node, 0], child[node, 1] = code[:len(node)], code[len(node):2 * len(node)]
    child[still] = code[2 * len(node):, None]
    leaves, grown = ((np.r_[0, np.cumsum(sizes[kind])], flat[np.repeat(kind, sizes)]) for kind in (~grows, grows))
    return Level(feature, cut, child, leaves), grown


def _stage(df: DataFrame) -> tuple[DataFrame, str]:
    """A stage that is dropped when the next one stands."""
    path = stage_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _drop(context, path: str) -> None:
    found = context._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)


def predict(rows: DataFrame, label: str, features: str, size: int, classes: int, trees: int = 100, depth: int = 30,
            seed: int = 42) -> DataFrame:
    """A forest of the rows with a ``label`` (class numbers from 0); those without, with a double ``prediction``."""
    context = rows.sparkSession.sparkContext
    n = rows.count()
    edges = cuts(rows.filter(F.col(label).isNotNull()), features, size)
    parts = max(min(context.defaultParallelism, -(-n // 1024)), -(-n // PARTITION_ROWS), 1)
    stages = [_stage(_binned(rows, label, features, edges, classes).repartition(parts))]
    at_once = min(trees, max(1, ROW_TREES // max(n, 1)))
    for group, first in enumerate(range(0, trees, at_once)):
        own = min(at_once, trees - first)
        stages.append(_stage(_begin(stages[-1][0], own, group, seed)))
        whole, levels = _sparse(_root_counts(stages[-1][0], own, classes)), []
        for level in range(depth + 1):
            state = stages[-1][0]
            got = _splits(state, levels, whole, [seed, group, level], own, size, classes) if level < depth else _no_splits()
            found, whole = _next_level(got, whole, level + 1 >= depth)
            levels.append(context.broadcast(found))
            done = len(whole[0]) == 1
            if done or len(levels) == LEVELS:
                moved = _moved(state, levels, own, size, classes)
                stages.append(_stage(moved.drop("_node", "_draws") if done else moved))
                for _, path in stages[:-1]:
                    _drop(context, path)
                for b in levels:
                    b.destroy()
                stages, levels = stages[-1:], []
            if done:
                break
    base = stages[-1][0]

    def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            best = _table(part.column("_votes"), np.float64, classes).argmax(1) if part.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [pa.array(best.astype(np.float64))],
                                             names=[*rest, "prediction"])

    rest = [c for c in rows.columns if c not in (label, features)]
    scored = base.filter("_label < 0").select(*rest, "_votes")
    return scored.mapInArrow(choose, _schema(scored.drop("_votes"), "prediction double"))


def _no_splits() -> pa.Table:
    empty = pa.array([], pa.int32())
    return pa.table([empty, empty, empty, pa.array([], pa.binary()), pa.array([], pa.binary())],
                    names=["node", "feature", "bin", "left_side", "right_side"])
