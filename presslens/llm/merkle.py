"""Merkle manifest of a dataset, and membership proofs by descending its DAG.

Manifest. A row's leaf is the digest of its encoded fields (``-`` for null,
else byte count, ``:`` and value). Per source the leaves, ascending by id,
become a tree of fan-out 16 (the last run of a level may be shorter, even one
node); the roots of the sources, ordered by source with null first, become the
top tree in the same way. ``H`` is SHA-256 of the joined inputs, digests taken
as lower-case hex text. Nodes are kept content-addressed: the store maps a
digest to the digests of its children, equal subtrees once.

Proofs. Requests are leaf ranks. They descend together, one row per requested
node: a frontier row looks its digest up in the store, steps to the children
whose ranks begin with the digits of some request, and appends the segment of
unselected children (what stands left and right of the step) to its path. At a
run of leaves the requests of that run join, and the path segments are turned
round. A proof is thus never carried for more than 1/16 of the leaves, and no
level moves more rows than it has requested nodes.

Ranks are dealt by range, written once, counted per part and source, and moved
up (``range_numbered``), so a source that holds a third of the rows is in many
tasks. Store look-ups of a digest that very many nodes share (runs of copies)
go through a broadcast of at most ``util.HEAVY_SHARE`` records of 512 bytes.
The driver sees the number of rows and of sources, the largest source's size
and the root; the loops run once a level (the logarithm of the rows, base 16).

Defined cases: null fields are encoded apart from empty text; null ids come
first in their source; rows alike in source and id are ordered by leaf digest,
then by their place in the input, so rows alike in all fields have equal
leaves but proofs of their own; a null source is a source of its own; columns
besides ``fields`` don't count; an empty table has no root, no records and no
proofs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import dense_row_number, range_numbered
from .util import field, join_by_key, row_keyed, stage

FANOUT, DIGIT, BYTES = 16, 4, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows that one task of the numbering sorts.
PART_ROWS = 2_000_000


@dataclass
class Manifest:
    """``places``: _fk, _rx, id, leaf, srank (rank of the source), n (leaves of the source), pos (rank in it) and the
    ``extra`` columns, per row; ``store``: digest, children, n_uses; ``subroots``: srank, n, subroot."""
    places: DataFrame
    store: DataFrame
    subroots: DataFrame
    root: bytes | None
    n_sources: int
    n_nodes: int
    most: int


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[encoded(v) for v in values]))


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return sum(((n > F.lit(FANOUT ** k)).cast("int") for k in range(1, 15)), (n > F.lit(1)).cast("int"))


def _levels(n: int) -> int:
    k = 0
    while n > FANOUT ** k:
        k += 1
    return k


def _grown(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Trees over (tree, n, pos, digest): the written levels (tree, n, pos, digest, children), and the root of each tree."""
    tops, levels = [nodes.filter(F.col("n") == 1)], []
    for k in range(1, _levels(most) + 1):
        # at most FANOUT rows a group
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: _hex(x["digest"])), "")
        above = (nodes.filter(F.col("n") > FANOUT ** (k - 1))
                 .groupBy("tree", "n", F.shiftright("pos", DIGIT).alias("above")).agg(run.alias("run")))
        level = stage(above.select("tree", "n", F.col("above").alias("pos"), digest(F.col("run")).alias("digest"),
                                   F.unhex("run").alias("children")))
        levels.append(level)
        nodes = level.drop("children")
        tops.append(nodes.filter(_height(F.col("n")) == k))
    roots = tops[0]
    for t in tops[1:]:
        roots = roots.unionByName(t)
    return levels, roots.select("tree", "n", "digest")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
             extra: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``. ``extra``: further columns of ``places``, made from the packed row (``util.field``)."""
    keyed = row_keyed(docs)
    source = field(source_col).cast("string")
    extra = extra or {}
    rows = stage(keyed.select(
        "_fk", "_rx", field(id_col).alias("id"), leaf_digest([field(c) for c in fields]).alias("leaf"),
        F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("skey"),  # orders null first, then bytewise
        *[c.alias(name) for name, c in extra.items()]))
    total = rows.count()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // PART_ROWS))
    ranked = stage(range_numbered(rows, ["skey"], ["id", "leaf", "_fk", "_rx"], "number", parts))
    sizes = ranked.groupBy("skey").agg(F.count("*").alias("n"))
    sources = stage(dense_row_number(sizes, ["skey"], "_srank").select("skey", "n", (F.col("_srank") - 1).alias("srank")))
    n_sources, most = sources.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    met = join_by_key(ranked, sources, ["skey"], "n", total, ["_fk", "_rx"])
    places = stage(met.select("_fk", "_rx", "id", "leaf", "srank", "n", (F.col("number") - 1).alias("pos"), *extra))

    levels, roots = _grown(places.select(F.col("srank").alias("tree"), "n", "pos", F.col("leaf").alias("digest")), most)
    subroots = stage(roots.select(F.col("tree").alias("srank"), "n", F.col("digest").alias("subroot")))
    top_levels, top = _grown(subroots.select(F.lit(0).alias("tree"), F.lit(n_sources).cast("long").alias("n"),
                                             F.col("srank").alias("pos"), F.col("subroot").alias("digest")), n_sources)
    root = top.first()
    store = subroots.select(F.col("subroot").alias("digest"), F.lit(b"").alias("children")).limit(0)
    for level in [*levels, *top_levels]:
        store = store.unionByName(level.select("digest", "children"))
    store = stage(store.groupBy("digest").agg(F.first("children").alias("children"), F.count("*").alias("n_uses")))
    n_nodes = store.agg(F.coalesce(F.sum("n_uses"), F.lit(0))).first()[0]
    return Manifest(places, store, subroots, bytes(root["digest"]) if root else None, n_sources, n_nodes, most)


def _looked_up(m: Manifest, frontier: DataFrame) -> DataFrame:
    return join_by_key(frontier, m.store, ["digest"], "n_uses", m.n_nodes, ["srank", "pos"]).drop("n_uses")


def _child(children: Column, digit: Column) -> Column:
    return F.substring(children, digit * BYTES + 1, F.lit(BYTES))


def _beside(children: Column, digit: Column) -> Column:
    """The path segment of a step: unselected children left and right of it."""
    return F.struct(F.substring(children, F.lit(1), digit * BYTES).alias("left"),
                    F.substring(children, (digit + 1) * BYTES + 1, F.octet_length(children)).alias("right"))


def _stepped(m: Manifest, frontier: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each frontier node's children, with the segment of the step at the end of the path."""
    digits = F.sequence(F.lit(0), (F.octet_length("children") / BYTES).cast("int") - 1)
    met = _looked_up(m, frontier).withColumn("digit", F.explode(digits))
    return met.select(*keep, (F.shiftleft("pos", DIGIT) + F.col("digit")).alias("pos"),
                      _child(F.col("children"), F.col("digit")).alias("digest"),
                      F.concat("path", F.array(_beside(F.col("children"), F.col("digit")))).alias("path"))


def descend(m: Manifest, requests: DataFrame) -> DataFrame:
    """Proofs of ``requests`` (srank, n, pos, any further columns): those columns, ``subroot`` and ``path``, the
    segments (left, right) from leaf to root."""
    asked = requests.withColumn("run", F.shiftright("pos", DIGIT))
    runs = stage(asked.select("srank", "n", "run").distinct())
    spark = requests.sparkSession
    frontier = spark.createDataFrame(
        [(0, m.root)] if m.root else [], "pos long, digest binary").select(
        F.lit(0).cast("long").alias("srank"), "pos", "digest", F.expr("cast(array() as array<struct<left: binary, right: binary>>)").alias("path"))
    wanted = runs.select("srank").distinct()
    for k in range(_levels(m.n_sources), 0, -1):
        begun = wanted.select(F.shiftright("srank", DIGIT * (k - 1)).alias("pos")).distinct()
        frontier = stage(_stepped(m, frontier, ["srank"]).join(begun, "pos", "left_semi"))
    start = frontier.select(F.col("pos").alias("srank"), "path").join(m.subroots, "srank")
    frontier = stage(start.select("srank", "n", "subroot", F.lit(0).cast("long").alias("pos"), F.col("subroot").alias("digest"), "path"))
    own = ["srank", "n", "subroot"]
    for k in range(_levels(m.most), 1, -1):
        # nodes of height k step down to height k - 1, those of lower trees wait
        tall = _height(F.col("n")) >= k
        begun = runs.filter(tall).select("srank", F.shiftright("run", DIGIT * (k - 2)).alias("pos")).distinct()
        down = _stepped(m, frontier.filter(tall), own).join(begun, ["srank", "pos"], "left_semi")
        frontier = stage(down.select(frontier.columns).unionByName(frontier.filter(~tall)))
    bottom = _looked_up(m, frontier).select("srank", F.col("pos").alias("run"), "subroot", "path", "children")
    met = asked.join(bottom, ["srank", "run"])
    digit = F.col("pos").bitwiseAND(F.lit(FANOUT - 1)).cast("int")
    upward = F.reverse("path")
    path = F.when(F.col("n") > 1, F.concat(F.array(_beside(F.col("children"), digit)), upward)).otherwise(upward)
    return met.select(*requests.columns, "subroot", path.alias("path"))


def proof_digest(path: Column) -> Column:
    """``H`` of a path's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(F.concat(s["left"], s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda at, s: digest(_hex(F.concat(s["left"], at, s["right"]))))


def proofs(docs: DataFrame, tampered: Column, fields: Sequence[str] = FIELDS, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row proved against the manifest of ``docs``; where ``tampered`` holds (made from ``util.field``), A-Z of
    the text are lower-cased after the manifest was made. id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    changed = [F.translate(field(c).cast("string"), upper, lower) if c == text_col else field(c) for c in fields]
    m = manifest(docs, fields, id_col, source_col, {"now": F.when(tampered, leaf_digest(changed))})
    met = descend(m, m.places.select("id", "leaf", "srank", "n", "pos", "now"))
    root = F.lit(m.root.hex() if m.root else None).cast("string")
    back = _hex(folded(F.coalesce("now", "leaf"), F.col("path")))
    return met.select(F.col("id").alias(id_col), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
                      root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"),
                      (back == root).alias("verified"))
