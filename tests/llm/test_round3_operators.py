"""Merkle manifest, decontamination and lexical search against plain versions, on awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presslens.llm import decontaminate, lexical_search, merkle, util

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, leaf string, n long, pos long, "
          "spans string, score double, rank int, digest string, items string, _row string, term string")


def _texts() -> list[str | None]:
    rng = random.Random(7)
    vocabulary = ["the", "The", "of", "río", "x1", "a-b", "don't", "12", "|", "ÄHRE", "你好", "😀", "end."]
    own = [None, "", " ", "...", "one", "ONE one", "x " * 20_000, "y" * 50_000]
    return own + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]


ITEMS = ["the of río the x1 12 12 of the the of río", "ONE one", "one", None, "", "...", "你好 the", "x x x x x x x x x x x x x",
         "the of", "of the of the 12 x1 río don t end 😀 the the of"]


@pytest.fixture(scope="module")
def rows():
    """Null and repeated ids, repeated rows, a source of one row, one of nearly all, texts that hold items."""
    rng, out = random.Random(5), []
    for i, text in enumerate(_texts() * 8):
        if i % 5 == 0 and text:
            text = f"{text}; {ITEMS[rng.choice([0, 8, 9, 9, 6])]}, {text[:40]}"
        doc_id = None if i % 97 == 3 else i if i % 13 else 7
        source = {1: None, 2: "é", 3: "", 4: "zz"}.get(i) or ("b" if i % 31 == 0 else "a")
        row = (doc_id, text, rng.choice(["en", None]), source, i, "l", 1, 2, "s", 0.5, 3, "d", "i", "r", "t")
        out += [row] * (20 if i == 44 else 2 if i % 11 == 5 else 1)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i if i != 6 else None, t, "other") for i, t in enumerate(ITEMS)] + [(1, "río río", "more")]
    return spark.createDataFrame(rows, "item_id long, text string, doc_id string")


def _item_texts():
    out = defaultdict(list)
    for i, t in enumerate(ITEMS):
        out[i if i != 6 else None].append(t)
    out[1].append("río río")
    return out


def _multiset(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


# Merkle manifest


def _check_proofs(rows, got):
    assert _multiset(got) == Counter(brute.merkle([r[:5] for r in rows], lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0))


def test_proofs(docs, rows):
    got = merkle.proofs(docs, util.mod_crc32(util.field("doc_id"), 5) == 0)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = got.collect()
    _check_proofs(rows, got)
    assert {r["verified"] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_proofs_of_one_source(spark, n):
    rows = [(i % 200, f"Text {i % 100}", "en", "s", 5) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _check_proofs(rows, merkle.proofs(df, util.mod_crc32(util.field("doc_id"), 5) == 0).collect())


def test_many_sources_and_equal_subtrees(spark):
    """300 sources make the top tree three levels high; 600 equal rows share their records in the store."""
    rows = [(i, "T", None, f"s{i}", 1) for i in range(299)] + [(7, "Same", "en", "hot", None)] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    _check_proofs(rows, merkle.proofs(df, util.mod_crc32(util.field("doc_id"), 5) == 0).collect())
    m = merkle.manifest(df)
    assert m.store.filter("n_uses > 30").count() == 1 and m.n_sources == 300


def test_requests_of_a_few_leaves(docs):
    """Paths of some requests equal those found when all are asked for."""
    m = merkle.manifest(docs)
    asked = m.places.select("id", "srank", "n", "pos")
    every = {(r["srank"], r["pos"]): r["path"] for r in merkle.descend(m, asked).collect()}
    few = merkle.descend(m, asked.filter("pos % 97 = 5")).collect()
    assert 0 < len(few) < 20 and all(every[r["srank"], r["pos"]] == r["path"] for r in few)
    assert merkle.descend(m, asked.limit(0)).isEmpty()


def test_manifest_of_nothing(none):
    assert merkle.proofs(none, F.lit(False)).collect() == []
    assert merkle.manifest(none).root is None


def test_a_changed_row_changes_the_root(docs):
    before = merkle.manifest(docs).root
    changed = docs.withColumn("n_chars", F.when(F.col("n_chars") == 9, 10).otherwise(F.col("n_chars")))
    assert merkle.manifest(changed).root != before == merkle.manifest(docs.repartition(3)).root


# decontamination


WORD_LISTS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORD_LISTS, max_size=6), WORD_LISTS, st.integers(1, 5))
def test_automaton_matches_plain_windows(items, words, window):
    longest, spans, names = decontaminate.Automaton([(str(i), x) for i, x in enumerate(items)], window).hits(words)
    hit, found = brute.windows(words, dict(enumerate(items)), window)
    assert {k for b, e in spans for k in range(b, e)} == hit
    assert names == {str(i) for i in found}
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    own = {tuple(x[i:j]) for x in items for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    assert longest == max([j - i for i in range(len(words)) for j in range(i + 1, len(words) + 1) if tuple(words[i:j]) in own], default=0)


def _want_contamination(rows, window=10):
    items = {i: [brute.lower_words(t) for t in texts] for i, texts in _item_texts().items()}
    for r in rows:
        words, hit, found = brute.lower_words(r[1]), set(), set()
        for i, lists in items.items():
            for x in lists:
                own, of = brute.windows(words, {i: x}, window)
                hit, found = hit | own, found | of
        names = sorted("" if i is None else str(i) for i in found)
        yield r[0], len(words), len(hit), len(found), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [decontaminate.BLOCK, 100])
def test_contamination(docs, rows, items, most):
    """A small block size sends the items through several automata."""
    got = decontaminate.contamination(docs, items, most=most)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert _multiset(got.collect()) == Counter(_want_contamination(rows))


@pytest.mark.parametrize("most", [decontaminate.BLOCK, 100])
def test_spans_are_cut(spark, most):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"Éa before, {item.upper()}; after x.", "k"), (2, "clean Text", "k"), (3, item, "k"), (4, None, "k"), (5, "", "k"),
            (6, f"one two {item[6:]} - and {item} and much more of text of its own that stays as it was and keeps the share low enough", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    tests = spark.createDataFrame([("q", item), ("r", "beta gamma"), ("s", "nothing")], "item_id string, text string")
    got = {r["doc_id"]: (r["text"], r["spans"]) for r in decontaminate.decontaminate(df, tests, most_coverage=0.8, most=most).collect()}
    assert got == {1: ("Éa before, ; after x.", "k"), 2: ("clean Text", "k"), 4: (None, "k"), 5: ("", "k"),
                   6: ("one two  - and  and much more of text of its own that stays as it was and keeps the share low enough", "k")}


def test_long_item_is_cut_without_loss(spark):
    words = [f"w{i % 4099}v{i}" for i in range(40_000)]
    tests = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    df = spark.createDataFrame([(0, " ".join(words[16_370:16_400])), (1, " ".join(words[:9])), (2, "a " + " ".join(words))], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(df, tests).collect()}
    assert got == {0: (30, 1), 1: (0, 0), 2: (40_000, 1)}


def test_nothing_to_scan(docs, none, items):
    assert decontaminate.contamination(none, items).collect() == []
    assert decontaminate.contamination(docs, items.limit(0)).filter("contaminated or n_items > 0").isEmpty()
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()


# lexical search


def _check_search(rows, got, texts, k):
    want = brute.search([(r[0], r[1]) for r in rows], texts, k)
    assert _multiset(got.select("item_id", "rank", "doc_id", "score").collect()) == Counter(want)


@pytest.mark.parametrize(("most_docs", "most", "k"), [(lexical_search.DOCS, lexical_search.QUERIES, 50), (9, 2000, 20)])
def test_search(docs, rows, items, most_docs, most, k):
    """Small blocks of documents carry the k-th score from block to block; small blocks of queries are searched in turn."""
    index = lexical_search.build_index(docs, most_docs=most_docs)
    got = lexical_search.search(index, items, k, most=most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    _check_search(rows, got, _item_texts(), k)


def test_search_of_random_documents(spark):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(40_000)]
    rows = [(i, " ".join(words[rng.randrange(39_000):][:rng.choice([1, 5, 40, 300])])) for i in range(600)]
    texts = {i: [" ".join(rng.sample(words, rng.randint(1, 25)))] for i in range(30)}
    index = lexical_search.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), most_docs=40)
    tests = spark.createDataFrame([(i, t[0]) for i, t in texts.items()], "item_id long, text string")
    _check_search(rows, lexical_search.search(index, tests, 10), texts, 10)


def test_strata_share_m_and_groups_share_tf(docs):
    index = lexical_search.build_index(docs)
    for block in index.blocks.collect():
        of = {c: lexical_search.numbers(block, c) for c in lexical_search.NUMBERS}
        assert (np.diff(of["strata"]) > 0).all() and of["stratum_docs"].sum() == len(block["ids"])
        assert of["group_docs"].sum() == len(of["docs"]) == of["term_docs"].sum() and of["term_groups"].sum() == len(of["group_tf"])


def test_search_in_nothing(docs, none, items):
    assert lexical_search.search(lexical_search.build_index(none), items).collect() == []
    assert lexical_search.search(lexical_search.build_index(docs), items.limit(0)).collect() == []
