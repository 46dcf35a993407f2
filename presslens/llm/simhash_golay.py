"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Fingerprint: A-Z are lower-cased, words are parted at ASCII white space, and
each shingle of ``shingle`` words joined by single spaces (repeats included; a
text of fewer words is one shingle) is hashed with XXH64, seed 42. A bit is 1
if it is set in more than half of the hashes; a text without words, or null,
has fingerprint 0 and links like any other.

Links (at most ``MAX_BITS`` = 4 differing bits) are found on distinct
fingerprints:

* The 64 bits are cut into three segments of 22, 21 and 21 bits, each a word
  of the binary Golay code [23, 12, 7]. The code is perfect: a word has exactly
  one codeword within distance 3. A word's keys are the 12-bit indices of the
  codewords within distance 4: one key, or six if it lies at distance 3. Two
  words that differ in at most 2 bits share a key (``tests/llm`` checks every
  syndrome and error).
* Of 4 errors over three segments, some two segments have at most 2 between
  them. So linked fingerprints share a pair key (segment pair, index, index).
* Fingerprints meet by pair key (a shuffle and a sort, no join that emits
  pairs) and every meeting is verified by its Hamming distance. A key emits
  at most one edge per member: to the least member of its part of the bucket.
  Buckets of more than ``TILE`` fingerprints are not held by one task: they
  are dealt again into tiles, and every pair of tiles is compared in a task of
  its own. Nothing is dropped.

Components come from alternating large-star and small-star steps (Kiveris et
al. 2014), each written as a stage. Copies of one fingerprint never meet:
counts and least ids are kept per fingerprint, and the classes go back to the
rows through ``util.join_by_key``.

Defined cases: null ids are never a component's id unless all are null; in
``drop_near_copies`` the row of least id stays (nulls last, then by place in
the input), so exactly one row of a group stays; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import field, giving_back, join_by_key, row_keyed, stage, without_rows

SHINGLE = 4
MAX_BITS = 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one bucket that one task compares.
TILE = 20_000
#: Generator polynomial of the code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
_HASHES = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        joined: Iterator[bytes] = iter([b" ".join(words)])
    else:
        joined = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _HASHES):
        part = hashes[k:k + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], np.uint64)
            yield batch.drop_columns(["text"]).append_column("fp", pa.array(found.view(np.int64), pa.int64()))
    return run


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndrome: the remainder by the generator polynomial (11 bits)."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of least weight, the number of keys, and what
    the keys' indices differ by from that of the nearest codeword."""
    message = np.arange(1 << 12) << 11
    code = message ^ _remainder(message)
    sevens = code[np.bitwise_count(code) == 7]
    error = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            error[_remainder(np.array([e]))[0]] = e
    keys = np.zeros((1 << 11, 6), np.int64)
    n = np.ones(1 << 11, np.int64)
    for syndrome in np.flatnonzero(np.bitwise_count(error) == 3):
        near = sevens[(sevens & error[syndrome]) == error[syndrome]]
        keys[syndrome, 1:] = near >> 11
        n[syndrome] = 6
    return error, n, keys


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key indices (first ``n`` of 6 columns count) and ``n`` of 23-bit words."""
    error, n, keys = golay()
    syndrome = _remainder(words)
    nearest = (words ^ error[syndrome]) >> 11
    return nearest[:, None] ^ keys[syndrome], n[syndrome]


def pair_keys(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, places in ``fps``) of all pair keys of the fingerprints (uint64)."""
    found = [segment_keys((fps >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64))
             for at, bits in SEGMENTS]
    for number, (a, b) in enumerate(combinations(range(3), 2)):
        for n_a in (1, 6):
            for n_b in (1, 6):
                at = np.flatnonzero((found[a][1] == n_a) & (found[b][1] == n_b))
                keys = (number << 24 | found[a][0][at, :n_a, None] << 12 | found[b][0][at, None, :n_b]).reshape(-1)
                yield keys.astype(np.int32), np.repeat(at, n_a * n_b)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fps = batch.column("fp").to_numpy(zero_copy_only=False)
        for k in range(0, len(all_fps), 4096):
            fps = all_fps[k:k + 4096]
            for keys, at in pair_keys(fps.view(np.uint64)):
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(fps[at], pa.int64())],
                                                     names=["key", "fp"])


def parts(fps: np.ndarray, most: int) -> np.ndarray:
    """For distinct fingerprints of one bucket: the place of the first member of
    each one's part, parts being connected by at most ``most`` differing bits.
    Members that are reached leave the search, so a bucket of near copies takes
    little more than one comparison each."""
    label = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        root, left = left[0], left[1:]
        front = [np.array([root])]
        while front and len(left):
            members = front.pop()
            step = max(1, (1 << 21) // len(left))
            if len(members) > step:
                front.append(members[step:])
                members = members[:step]
            near = (np.bitwise_count(fps[members][:, None] ^ fps[left][None, :]) <= most).any(0)
            if near.any():
                front.append(left[near])
                label[left[near]] = root
                left = left[~near]
    return label


def _small_runs(fps: np.ndarray, run: np.ndarray, most: int) -> np.ndarray:
    """As ``parts`` for many short runs of one key laid end to end."""
    label = np.arange(len(fps))
    pairs = []
    at, lag = np.arange(len(fps)), 0
    while True:
        lag += 1
        at = at[at + lag < len(fps)]
        at = at[run[at + lag] == run[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= most]
        pairs.append((near, near + lag))
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1)) if pairs else (label[:0], label[:0])
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _edges(most: int, tile: int):
    """Rows sorted by key: edges of every bucket, and the members of buckets beyond ``tile`` (a null)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int32())])

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([
            pa.array(a, pa.int64()), pa.nulls(n, pa.int64()) if b is None else pa.array(b, pa.int64()),
            pa.nulls(n, pa.int32()) if key is None else pa.array(key, pa.int32())], schema=schema)

    def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        unsigned = fps.view(np.uint64)
        label = np.arange(len(fps))
        small = np.repeat((sizes > 1) & (sizes <= 64), sizes)
        if small.any():
            at = np.flatnonzero(small)
            label[at] = at[_small_runs(unsigned[at], keys[at], most)]
        for k in np.flatnonzero(sizes > 64):
            own = slice(starts[k], starts[k] + sizes[k])
            label[own] = starts[k] + parts(unsigned[own], most)
        child = np.flatnonzero(label != np.arange(len(label)))
        if len(child):
            yield out(fps[child], fps[label[child]], None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, hot = np.zeros(0, np.int32), np.zeros(0, np.int64), None
        for batch in batches:
            keys = np.r_[keys, batch.column("key").to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, batch.column("fp").to_numpy(zero_copy_only=False)]
            if hot is not None:
                n = int(np.searchsorted(keys, hot, "right"))
                if n:
                    yield out(fps[:n], None, keys[:n])
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                hot = None
            last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
            if last:
                yield from settle(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if len(keys) > tile:
                hot = keys[-1]
                yield out(fps, None, keys)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield from settle(keys, fps)
    return run


def _tile_edges(most: int):
    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy()
        label = parts(fps.view(np.uint64), most)
        child = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": pa.array(fps[child], pa.int64()), "b": pa.array(fps[label[child]], pa.int64())})
    return run


def link_edges(fps: DataFrame, most: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` as the links do."""
    if most > MAX_BITS:
        raise ValueError(f"the segments find links of at most {MAX_BITS} bits")
    met = (fps.select("fp").mapInArrow(giving_back(_keyed), "key int, fp long").repartition("key")
           .sortWithinPartitions("key", "fp").mapInArrow(giving_back(_edges(most, tile)), "a long, b long, key int"))
    met = stage(met)
    edges = met.filter(F.col("b").isNotNull()).select("a", "b")
    hot = met.filter(F.col("b").isNull()).select("key", F.col("a").alias("fp"))
    if not hot.isEmpty():
        tiles = hot.groupBy("key").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
        dealt = (hot.join(tiles, "key").withColumn("own", own)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
                 .select("key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
        edges = edges.unionByName(dealt.groupBy("key", "i", "j").applyInArrow(_tile_edges(most), "a long, b long"))
    return edges.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` with ``m``, the least of ``a`` and its neighbours ``b``. A hub
    of a large component is looked up in a broadcast, not joined in one task."""
    least = stage(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n_edges")))
    return join_by_key(edges, least, ["a"], "n_edges", n, ["b"]).drop("n_edges")


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): every node of the graph but a component's least, with that least node as ``b``."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = stage(_with_least(both, 2 * state[0]).filter(F.col("b") > F.col("a"))
                      .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        met = _with_least(large, large.count())
        linked = met.select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stage(linked.filter(F.col("a") != F.col("b")).distinct())
        before, state = state, _state(now)
    return now


def _placed(keyed: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    rows = keyed.select("_fk", "_rx", field(id_col).alias("id"), field(text_col).cast("string").cast("binary").alias("text"))
    kept = [f for f in rows.schema.fields if f.name != "text"]
    return stage(rows.mapInArrow(giving_back(_fingerprints(shingle)), T.StructType([*kept, T.StructField("fp", T.LongType())])))


def classes(placed: DataFrame, most: int = MAX_BITS) -> tuple[DataFrame, int]:
    """Per row of the stage ``placed`` (_fk, _rx, id, fp): ``winner``, the place of
    its component's first row, and the number of rows."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "_fk", "_rx")
    kinds = stage(placed.groupBy("fp").agg(F.count("*").alias("n_rows"), F.min(place).alias("first")))
    total = kinds.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    tree = stars(link_edges(kinds, most))
    rooted = kinds.join(tree.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select(
        "fp", "n_rows", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted)
    roots = rooted.groupBy("root").agg(F.count("*").alias("n_kinds"), F.min("first").alias("winner"))
    n_kinds = rooted.count()
    sided = join_by_key(rooted, stage(roots), ["root"], "n_kinds", n_kinds, ["fp"]).select("fp", "n_rows", "winner")
    return join_by_key(placed, stage(sided), ["fp"], "n_rows", total, ["_fk", "_rx"]), total


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    most: int = MAX_BITS) -> DataFrame:
    """Per row: id, fingerprint (16 hexadecimal digits), component_id (least id of its component)."""
    rows, _ = classes(_placed(row_keyed(docs), id_col, text_col, shingle), most)
    return rows.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       F.col("winner.id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     most: int = MAX_BITS) -> DataFrame:
    """One row of each component, with all its columns."""
    keyed = row_keyed(docs)
    rows, _ = classes(_placed(keyed, id_col, text_col, shingle), most)
    dropped = (F.col("_fk") != F.col("winner._fk")) | (F.col("_rx") != F.col("winner._rx"))
    return without_rows(keyed, stage(rows.select("_fk", "_rx", dropped.alias("dropped"))), "dropped")
