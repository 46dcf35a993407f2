"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are maximal runs of ASCII letters (A-Z lower-cased), digits and non-ASCII
characters. The items' words become one suffix automaton (Blumer et al. 1985,
for several texts): every state is a class of item substrings. A document's
words stream through it once; at each word the state and the matching length
say which is the longest suffix read so far that occurs in an item. Where the
length reaches ``window``, the words matched are a hit; an item with fewer
words (but some) is a window of its own and is found along the suffix links.
Which items hold a window is kept with the state of that window.

``contamination`` reports hits, ``decontaminate`` cuts the spans out of the
text and drops documents whose hit share is above a limit.

Bounds. Items are cut into pieces that overlap by ``window - 1`` words (no
window is lost), and pieces are dealt into blocks whose size, at most
``BLOCK``, is checked by counting. A block's automaton is broadcast and the
documents stream against one block at a time, so memory depends on neither
the benchmark nor the documents; the usual benchmark is one block and one
pass without any shuffle. Spans of several blocks are merged per document.

Defined cases: null or empty texts have no words; a null or empty item has no
window; rows of items that share an id are one item, those without id are one
item named by the empty text; repeated documents each get a row; an empty
table of documents gives an empty result, an empty table of items no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import bounded_blocks, field, row_keyed, stage

WINDOW = 10
#: Size of a block of items: bytes and eight more a word. An automaton has at most two states and three steps a word.
BLOCK = 4 << 20
#: Words of a piece of a long item.
PIECE = 16_384

WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_NORMAL).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; state 0 is the empty match.

    ``need[v]``: the least matching length in state ``v`` at which a window ends there.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            at = 0
            for w in words:
                at = self._extended(at, w)
        n = len(self.go)
        self.names: dict[int, list[str]] = {}
        self.whole = [0] * n  # nearest state on the suffix links, itself included, that is a whole short item
        self.long = [0] * n  # the state of the last ``window`` words of a match
        self.need: list[float] = [float("inf")] * n
        short = {self._walked(words)[-1][0] for _, words in items if len(words) < window}
        for v in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[v]
            self.whole[v] = v if v in short else self.whole[up]
            if self.length[v] >= window:
                self.long[v] = v if self.length[up] < window else self.long[up]
            self.need[v] = min(self.need[up], self.length[v] if v in short else window if self.length[v] >= window else float("inf"))
        held: dict[int, set[str]] = {}
        for name, words in items:
            path = self._walked(words)
            own = [path[-1][0]] if len(words) < window else [self.long[v] for v, size in path if size >= window]
            for v in own:
                held.setdefault(v, set()).add(name)
        self.names = {v: sorted(x) for v, x in held.items()}

    def _state(self, length: int, link: int, go: dict[bytes, int]) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A copy of ``q`` for its shorter strings, those that end with a step from ``p``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.go[q]))
        self.link[q] = copy
        while p >= 0 and self.go[p].get(w) == q:
            self.go[p][w] = copy
            p = self.link[p]
        return copy

    def _extended(self, at: int, w: bytes) -> int:
        q = self.go[at].get(w)
        if q is not None:  # read before, in another item
            return q if self.length[q] == self.length[at] + 1 else self._split(at, w, q)
        new = self._state(self.length[at] + 1, 0, {})
        p = at
        while p >= 0 and w not in self.go[p]:
            self.go[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.go[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _walked(self, words: list[bytes]) -> list[tuple[int, int]]:
        v, out = 0, []
        for size, w in enumerate(words, 1):
            v = self.go[v][w]
            out.append((v, size))
        return out

    def hits(self, words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Longest matching length, spans of hit words (begin, end), names of the items with a window."""
        go, link, length, need = self.go, self.link, self.length, self.need
        v = size = longest = 0
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for i, w in enumerate(words):
            to = go[v].get(w)
            if to is None:
                if size > longest:
                    longest = size
                while v and to is None:
                    v = link[v]
                    to = go[v].get(w)
                if to is None:
                    size = 0
                    continue
                size = length[v]
            v = to
            size += 1
            if size >= need[v]:
                span = 0
                if size >= self.window:
                    span = size
                    found.add(self.long[v])
                u = self.whole[v if size == length[v] else link[v]]
                while u:
                    span = max(span, length[u])
                    found.add(u)
                    u = self.whole[link[u]]
                begin = i + 1 - span
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return max(longest, size), spans, {x for u in found for x in self.names[u]}


_SPAN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("begin", "end", "from_byte", "to_byte")]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("longest", T.LongType()),
          T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]
_PA_SPAN = pa.list_(pa.struct([(c, pa.int64()) for c in ("begin", "end", "from_byte", "to_byte")]))


def _scanned(automaton):
    """``automaton``: a broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = automaton.value.hits
        for batch in batches:
            sizes, longest, spans, items = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                words = words_of(text)
                size, found, names = hits(words)
                if found:
                    at = [m.span() for m in WORD.finditer(text.translate(_NORMAL))]
                    found = [(b, e, at[b][0], at[e - 1][1]) for b, e in found]
                sizes.append(len(words))
                longest.append(size)
                spans.append([dict(zip(("begin", "end", "from_byte", "to_byte"), x)) for x in found])
                items.append(sorted(names))
            out = batch.drop_columns(["text"])
            for name, values, kind in (("n_words", sizes, pa.int64()), ("longest", longest, pa.int64()),
                                       ("spans", spans, _PA_SPAN), ("items", items, pa.list_(pa.string()))):
                out = out.append_column(name, pa.array(values, kind))
            yield out
    return run


def _pieces(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text")):
                words = words_of(text.as_py())
                cuts = range(0, max(1, len(words) - window + 1), PIECE)
                pieces = [words[i:i + PIECE + window - 1] for i in cuts] if words else []
                yield pa.RecordBatch.from_pydict({
                    "name": pa.array([name] * len(pieces), pa.string()), "place": pa.array(range(len(pieces)), pa.int64()),
                    "words": pa.array([b" ".join(p) for p in pieces], pa.binary()),
                    "size": pa.array([sum(len(w) + 9 for w in p) for p in pieces], pa.int64())})
    return run


def item_pieces(items: DataFrame, window: int, item_id_col: str, item_text_col: str) -> DataFrame:
    """(name, place, words, size) of the items' pieces, written as a stage."""
    named = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("name"),
                         F.col(item_text_col).cast("string").cast("binary").alias("text"))
    return stage(named.mapInArrow(_pieces(window), "name string, place long, words binary, size long"))


def _passes(rows: DataFrame, items: DataFrame, window: int, item_id_col: str, item_text_col: str, most: int) -> list[DataFrame]:
    """``rows`` (with ``text`` in UTF-8) against each block of items; written if there is more than one."""
    sc = rows.sparkSession.sparkContext
    out = T.StructType([*[f for f in rows.schema.fields if f.name != "text"], *_FOUND])
    pieces = item_pieces(items, window, item_id_col, item_text_col)
    n, block = bounded_blocks(pieces, "size", ["name", "place", "words"], most)
    found = []
    for b in range(n):
        # at most ``most``: counted by bounded_blocks
        own = [(r["name"], bytes(r["words"]).split()) for r in pieces.filter(block == b).collect()]
        automaton = sc.broadcast(Automaton(own, window))
        hits = rows.mapInArrow(_scanned(automaton), out)
        found.append(hits if n == 1 else stage(hits))
        if n > 1:
            automaton.unpersist()
    return found


def _merged(spans: Column) -> Column:
    """Overlapping spans of several blocks as one, in order."""
    def met(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"),
                          last["from_byte"].alias("from_byte"), F.greatest(last["to_byte"], x["to_byte"]).alias("to_byte"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["begin"]),
                      F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.lit([]).cast(_SPAN), met)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """Per row: _fk, _rx, id, n_words, longest (matching length), spans (words begin to end, and bytes), items (names)."""
    rows = row_keyed(docs).select("_fk", "_rx", field(id_col).alias("id"), field(text_col).cast("string").cast("binary").alias("text"))
    found = _passes(rows, items, window, item_id_col, item_text_col, most)
    if len(found) == 1:
        return found[0]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    # one row a block in each group
    return every.groupBy("_fk", "_rx").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.max("longest").alias("longest"),
        _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated (see the module)."""
    found = scan(docs, items, window, id_col, text_col, item_id_col, item_text_col, most)
    return found.select(F.col("id").alias(id_col), "n_words", n_hit(F.col("spans")).alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def _without(text: Column, spans: Column) -> Column:
    """The text (binary) without the bytes of the spans."""
    def kept(at: Column, x: Column) -> Column:
        piece = F.substring(text, (at["at"] + 1).cast("int"), (x["from_byte"] - at["at"]).cast("int"))
        return F.struct(x["to_byte"].alias("at"), F.concat(at["out"], piece).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out"))
    return F.aggregate(spans, start, kept, lambda at: F.concat(
        at["out"], F.substring(text, (at["at"] + 1).cast("int"), F.octet_length(text)))).cast("string")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, id_col: str = "doc_id",
                  text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", most: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` with the hit spans cut out of the text; rows with more than ``most_coverage`` of their words hit go."""
    keyed = row_keyed(docs)
    text = field(text_col).cast("string").cast("binary")
    rows = keyed.select("_fk", "_rx", "_row", text.alias("text"))
    found = _passes(rows, items, window, item_id_col, item_text_col, most)
    if len(found) == 1:
        met = found[0]
    else:  # the texts don't go through the merge of the blocks' spans
        every = found[0].filter(F.size("spans") > 0)
        for x in found[1:]:
            every = every.unionByName(x.filter(F.size("spans") > 0))
        spans = every.groupBy("_fk", "_rx").agg(F.first("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"))
        met = keyed.join(spans, ["_fk", "_rx"], "left")
    has = F.coalesce(F.size("spans") > 0, F.lit(False))
    left = met.filter(~has | (n_hit(F.col("spans")) <= F.col("n_words") * F.lit(most_coverage)))
    cut = F.when(has, _without(text, F.col("spans"))).otherwise(field(text_col))
    return left.withColumn("_cut", cut).select(*[
        F.col("_cut").alias(c) if c == text_col else field(c).alias(c) for c in docs.columns])
