"""Every operator against brute force on small inputs with awkward rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from presslens.llm import (chars, exact_dedup, lang_id, mixture, quality_mcd, sampling, sentencepiece_sample,
                           sharding, simhash_golay, token_count, toxicity, util, warc)

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "kept boolean, score double, shard int, _row string, fp long, digest string, pattern string, size long")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _texts() -> list[str | None]:
    rng = random.Random(4)
    vocabulary = ["the", "of", "Tree", "río", "ähre", "x", "don't", "12", "|", "idiot", "a b", "你好", "😀"]
    own = [None, "", " ", "\n\t", "one", "One  two", "one two", "one\ttwo ", "No\nNo\nyes\nNo", "x " * 30_000, "y" * 50_000]
    for _ in range(40):
        own.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))))
    near = own[-1].split(" ") + [f"w{i}" for i in range(400)]
    for i in range(12):
        near[rng.randrange(len(near))] = f"z{i}"
        own.append(" ".join(near))
    return own + own[-20:] + [own[11]] * 5


@pytest.fixture(scope="module")
def rows():
    """Awkward rows: null ids, repeated rows, null languages and sources, names that operators use themselves."""
    rng = random.Random(5)
    out = []
    for i, text in enumerate(_texts()):
        doc_id = None if i % 17 == 3 else i if i % 13 else 7
        row = (doc_id, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", None]), i,
               True, 0.5, 3, "r", 1, "d", "p", 9)
        out += [row] * (2 if i % 11 == 5 else 1)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _multiset(rows) -> Counter:
    return Counter(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows)


def _first(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


# exact dedup


def _check_exact(rows, got):
    groups = defaultdict(list)
    for r in rows:
        groups[brute.sha256(r[1])].append(r[0])
    assert _multiset((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == _multiset(
        (r[0], _first(groups[brute.sha256(r[1])]), len(groups[brute.sha256(r[1])]), brute.sha256(r[1])) for r in rows)
    kept = [r for r in got if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_dedup(docs, rows):
    _check_exact(rows, exact_dedup.exact_dedup(docs).collect())


def test_exact_dedup_heavy_and_light(spark):
    """Beyond HEAVY_SHARE rows both ways are taken: the hot text by broadcast, the others by shuffle."""
    rows = [(i, "hot  text" if i % 3 == 0 else f"text {i // 2}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    _check_exact(rows, exact_dedup.exact_dedup(df).collect())


def test_misra_gries_keeps_every_heavy_digest():
    rng = random.Random(1)
    counts = Counter()
    data = [b"hot%d" % (i % 4) for i in range(4000)] + [b"%d" % i for i in range(16000)]
    rng.shuffle(data)
    for k in range(0, len(data), 500):
        for x, n in Counter(data[k:k + 500]).items():
            counts[x] += n
        counts = Counter(exact_dedup._reduced(counts, 31))
    assert len(counts) <= 31 and all(b"hot%d" % i in counts for i in range(4))
    assert all(1000 - len(data) / 32 <= counts[b"hot%d" % i] <= 1000 for i in range(4))


def test_drop_exact_copies(docs, rows):
    got = exact_dedup.drop_exact_copies(docs)
    assert got.columns == docs.columns
    assert sorted(brute.sha256(r["text"]) for r in got.collect()) == sorted({brute.sha256(r[1]) for r in rows})


# sharding


def test_sharding(docs, rows):
    got = sharding.shard_records(docs, shards=5).collect()
    assert _multiset((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == _multiset(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), "key",
         brute.shard(r[0], [1.0] * 5), brute.shard(r[0], [1.0] * 6)) for r in rows)
    assert all(r["grown_shard"] in (r["shard"], 5) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_sharding_by_weight(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = dict(sharding.shard_records(df, 3, [1.0, 2.0, 5.0]).groupBy("shard").count().collect())
    assert all(abs(got[i] / 20_000 - w / 8) < 0.015 for i, w in enumerate((1, 2, 5)))


# mixture


def test_mix_report(docs, rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(brute.words(r[1]))
    target = brute.targets(sizes)
    got = mixture.mix_report(docs).collect()
    assert _multiset(r[:2] for r in got) == _multiset((r[0], len(brute.words(r[1]))) for r in rows)
    by_source = {(sizes[s], s): s for s in sizes}
    taken = Counter()
    for r in got:
        s = next(s for size, s in by_source if size == r["source_size"])
        assert math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    largest = max(r["size"] for r in got)
    assert all(abs(taken[s] - target[s]) <= largest / 2 + 1 for s in sizes)
    again = mixture.mix_report(docs.repartition(3)).select("doc_id", "size", "copies").collect()
    assert _multiset(again) == _multiset((r["doc_id"], r["size"], r["copies"]) for r in got)


def test_mix_comes_near_targets_of_many_documents(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 60), "abc"[i % 7 % 3]) for i in range(3000)]
    got = mixture.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("target").agg(
        F.sum("taken").alias("taken")).collect()
    assert len(got) == 3 and all(abs(r["taken"] - r["target"]) <= 31 for r in got)


def test_mix_copies_rows(docs):
    report = mixture.mix_report(docs).filter("copies > 0")
    got = mixture.mix(docs)
    assert got.columns == docs.columns
    assert got.count() == report.agg(F.sum("copies")).first()[0]


def test_flow_routes_overlapping_sources():
    """A shared pattern serves both sources; repeating costs more, so it begins only when all is used once."""
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 50)]
    flows = mixture.route(patterns, {"a": 120.0, "b": 130.0})
    assert sum(flows) == 250 and flows == [100, 100, 50]
    flows = mixture.route(patterns, {"a": 200.0, "b": 200.0})
    assert sum(flows) == 400 and all(size <= f <= 2 * size for f, (_, size) in zip(flows, patterns))


def test_flow_costs_as_little_as_a_linear_search():
    """Small overlapping cases against every way to route them."""
    rng = random.Random(6)
    for _ in range(60):
        names = "abc"[:rng.randint(2, 3)]
        patterns = [(tuple(sorted(rng.sample(names, rng.randint(1, len(names))))), rng.randint(0, 3)) for _ in range(3)]
        patterns = list(dict(patterns).items())
        targets = {s: float(rng.randint(0, 4)) for s in names}
        got = mixture.route(patterns, targets)
        best = brute.cheapest_routes(patterns, {s: round(t) for s, t in targets.items()})
        assert (sum(got), sum(max(0, g - size) for g, (_, size) in zip(got, patterns))) == best


def test_flow_of_many_sources_takes_seconds():
    rng = random.Random(1)
    names = [f"s{i}" for i in range(100_000)]
    patterns = [((s,), rng.randint(1, 10 ** 6)) for s in names] + [
        (tuple(sorted(rng.sample(names[:20_000], 2))), rng.randint(1, 10 ** 6)) for _ in range(10_000)]
    sizes = defaultdict(int)
    for sources, size in patterns:
        for s in sources:
            sizes[s] += size
    began = time.time()
    flows = mixture.route(patterns, mixture.source_targets(sizes, sum(size for _, size in patterns)))
    assert time.time() - began < 60 and all(0 <= f <= 2 * size for f, (_, size) in zip(flows, patterns))


def test_mix_with_the_same_row_at_the_same_place_of_many_files(spark, tmp_path):
    """40 files begin with one and the same row; it is half of its source."""
    for i in range(40):
        rows = [(7, "w " * 10, "a")] + ([(100 + i, "v " * 10, "a")] if i < 20 else []) + [(200 + i, "u " * 5, "b")]
        spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    got = mixture.mix_report(spark.read.parquet(f"{tmp_path}/d")).groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert sorted((r["source_size"], r["target"], r["taken"]) for r in got) == [(200, 300.0, 300), (600, 900.0, 900)]


def test_mix_of_a_row_that_is_a_third_of_all(spark):
    rows = [(1, "w w w", "a")] * 3000 + [(i, "v " * (i % 7), "ab"[i % 2]) for i in range(2, 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixture.mix_report(df).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 2 and all(abs(r["taken"] - r["target"]) <= 3.5 for r in got)


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, [["a"], ["a", "b"], ["b", "a", "b"], []][i % 4]) for i in range(400)]
    got = mixture.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"))
    assert got.count() == 400 and got.filter("taken > 2 * size").isEmpty()
    assert abs(got.agg(F.sum("taken")).first()[0] - 6000) <= 40


def test_targets_match_bisection():
    rng = random.Random(2)
    for _ in range(50):
        sizes = {s: rng.choice([0, 1, 10, 1000, 5000]) for s in (*"abcdefg"[:rng.randint(1, 7)], None)}
        got, want = mixture.source_targets(sizes, sum(sizes.values())), brute.targets(sizes)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-6, abs_tol=1e-6) for s in sizes)


# SimHash


def test_golay_keys_bear_two_errors():
    error, _, _ = simhash_golay.golay()
    assert np.bincount(np.bitwise_count(error)).tolist() == [1, 23, 253, 1771]
    one, n_one = simhash_golay.segment_keys(error)
    left = np.where(np.arange(6) < n_one[:, None], one, -1)
    for bits in [(), *combinations(range(23), 1), *combinations(range(23), 2)]:
        two, n_two = simhash_golay.segment_keys(error ^ sum(1 << b for b in bits))
        right = np.where(np.arange(6) < n_two[:, None], two, -2)
        assert (left[:, :, None] == right[:, None, :]).any((1, 2)).all()


def _check_components(rows, got):
    fps = [brute.simhash(r[1]) for r in rows]
    least = brute.components([r[0] for r in rows], fps)
    assert _multiset(got.select("doc_id", "fingerprint", "component_id").collect()) == _multiset(
        (r[0], f"{f:016x}", least[f]) for r, f in zip(rows, fps))
    return least


def test_simhash_components(docs, rows):
    least = _check_components(rows, simhash_golay.near_duplicates(docs))
    assert len(set(least.values())) < len(least)  # some copies are linked


def _planted_fingerprints() -> list[int]:
    rng = random.Random(8)
    out = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            out.add(f)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize("tile", [simhash_golay.TILE, 6])
def test_links_of_planted_fingerprints(spark, tile):
    """Chains at 1 to 5 bits; a small tile sends every larger bucket the way of hot buckets."""
    fps = _planted_fingerprints()
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash_golay.link_edges(spark.createDataFrame(signed, "fp long"), tile=tile)
    tree = dict(simhash_golay.stars(edges).collect())
    root = [tree.get(f, f) for (f,) in signed]
    want = brute.components(list(range(len(fps))), fps)
    assert len({*zip(root, want.values())}) == len(set(root)) == len(set(want.values()))


def test_drop_near_copies(docs, rows):
    got = simhash_golay.drop_near_copies(docs)
    fps = [brute.simhash(r[1]) for r in rows]
    assert got.columns == docs.columns
    part, members = brute.components(range(len(fps)), fps), defaultdict(list)
    for r, f in zip(rows, fps):
        members[part[f]].append(r[0])
    assert _multiset([(r["doc_id"],) for r in got.collect()]) == _multiset([(_first(x),) for x in members.values()])


# language


def test_viterbi_matches_plain_search():
    rng = np.random.default_rng(1)
    n_words = np.array([7, 1, 0, 30])
    scores = rng.normal(0, 3, (38, 3)).astype(np.float32)
    got = lang_id.viterbi(scores, n_words, 4.0)
    for begin, n in zip(np.cumsum(n_words) - n_words, n_words):
        s, best, back = scores[begin:begin + n].astype(float), None, []
        for row in s:
            if best is None:
                best = row
                continue
            move = best[:, None] - 4.0 * (1 - np.eye(3))
            back.append(move.argmax(0))
            best = move.max(0) + row
        if n:
            path = [int(best.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            assert got[begin:begin + n].tolist() == path[::-1]


def test_language_held_out(spark, sf_dir):
    docs = util.table(spark, sf_dir, "documents")
    model = lang_id.fit(docs, learn=util.mod_crc32(F.col("id"), 4) != 2)
    got = lang_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(
        util.mod_crc32(F.col("doc_id"), 4) == 2).collect()
    assert len(got) > 200 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.96
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_spans_and_scripts(spark):
    rng = random.Random(1)
    words = {"en": ["the", "with", "house", "garden", "and"], "fr": ["être", "avec", "maison", "les", "jardin"],
             "ru": ["дом", "сад", "или", "вместе", "это"]}
    rows = [(i, " ".join(rng.choices(words[x], k=40)), x) for i, x in enumerate(["en", "fr", "ru"] * 30)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(words["en"] * 8) + ". " + " ".join(words["fr"] * 6) + " сад это дом"
    other = ["", None, "12 + 3 …", mixed, "καλημέρα", "Сад"]
    (_, _, a), *_ = [lang_id.identify_texts(model, [t])[0] for t in other[:1]]
    got = lang_id.identify_texts(model, other)
    assert a == [] and [g[0] for g in got[:3]] == ["und"] * 3
    assert got[3][0] == "en" and [s[0] for s in got[3][2]] == ["en", "fr", "ru"] and 0.4 < got[3][1] < 0.8
    for lang, begin, size in got[3][2]:
        assert mixed[begin:begin + size].split()[0].rstrip(".") in words[lang]
    assert got[4][0] in words and got[5][0] == "ru"


# tokens


def test_token_counts_on_documents(spark, sf_dir):
    docs = util.table(spark, sf_dir, "documents")
    got = {r["doc_id"]: r for r in token_count.token_counts(docs, TOKENIZER).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = Tokenizer.from_file(TOKENIZER).encode_batch([r["text"] for r in rows], add_special_tokens=False)
    assert len(got) == len(rows)
    for r, e in zip(rows, want):
        own = got[r["doc_id"]]
        assert (own["n_bytes"], own["n_tokens"], own["over_limit"]) == (len(r["text"].encode()), len(e.ids), len(e.ids) > 2048)


def test_token_counts_of_awkward_rows(docs, rows):
    library = Tokenizer.from_file(TOKENIZER)
    got = _multiset(r[:3] for r in token_count.token_counts(docs, TOKENIZER).collect())
    assert got == _multiset((r[0], len((r[1] or "").encode()),
                             len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(st.sampled_from("astvremld''' \n1é9!?-ΣσİßÀ́你😀\x1c "), max_size=40),
                          st.text(st.characters(exclude_categories=["Cs"]), max_size=20),
                          st.sampled_from(["<|endoftext|>", "a<|startoftext|>b<|", "they'll've", "tionstheing" * 30])),
                min_size=1, max_size=6))
def test_token_counts_equal_the_library(texts):
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    assert token_count.count_texts(TOKENIZER, texts) == [len(e.ids) for e in want]


def test_token_counts_of_every_code_point():
    """Alone, between letters, before a number and under two marks that may change places."""
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"{chr(i)} a{chr(i)}a {chr(i)}1 e\u0345{chr(i)} a{chr(i)}\u0316 " for i in points[k:k + 1000])
             for k in range(0, len(points), 1000)]
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    assert token_count.count_texts(TOKENIZER, texts) == [len(e.ids) for e in want]


@pytest.mark.parametrize("look, room", [(32, 1 << 18), (1, 700)])
def test_words_cut_at_arbitrary_bytes(monkeypatch, look, room):
    """Any cuts, few symbols looked back on, slices that end inside words: maps grow until they compose."""
    monkeypatch.setattr(token_count, "LOOK", look)
    monkeypatch.setattr(token_count, "SLICE", room)
    machine = token_count.transducer(TOKENIZER)
    rng = random.Random(5)
    words = ["a" * 3001, "abc" * 700, "".join(rng.choices("abcdefghijklmnop", k=4000)), "日本語" * 500, "x", "!?" * 900]
    data = b"".join(w.encode() for w in words)
    symbols = np.frombuffer(data, np.uint8).astype(np.int32)
    symbols[np.cumsum([len(w.encode()) for w in words]) - 1] += 256
    want = [len(e.ids) for e in Tokenizer.from_file(TOKENIZER).encode_batch(words, add_special_tokens=False)]
    for _ in range(5):
        cuts = np.array([0, *sorted(rng.sample(range(1, len(data)), 200))])
        monkeypatch.setattr(token_count, "MOST_STATES", rng.choice([10, 1 << 17]))
        assert machine.count(symbols, cuts).sum() == sum(want)
    assert token_count.count_texts(TOKENIZER, words) == want


def test_lexer_chunks_compose():
    """State maps composed over chunks give the states of one sequential run."""
    rng = np.random.default_rng(3)
    maps = rng.integers(0, 7, (50, 7)).astype(np.uint8)
    state, want = token_count.START, []
    for m in maps:
        want.append(state)
        state = m[state]
    assert token_count.prefix_states(maps).tolist() == want


# toxicity


def test_toxicity_held_out(spark):
    """Labels of these tables are noisy: recall is asked of texts with an insult that training can have seen."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (util.table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels, learn=util.mod_crc32(F.col("id"), 5) != 0)
    got = (toxicity.score(docs, model, ["doc_id", "text"]).select("_row.*", "score").join(labels, "doc_id")
           .filter((util.mod_crc32(F.col("doc_id"), 5) == 0) & F.col("toxic").isNotNull()).collect())
    insulting = [r["score"] >= 0.5 for r in got if r["toxic"] and re.search("idiot|moron|scum|stupid|loser", r["text"])]
    clean = [r["score"] >= 0.5 for r in got if not r["toxic"]]
    assert len(insulting) > 30 and np.mean(insulting) > 0.9
    assert len(clean) > 500 and np.mean(clean) < 0.02
    misspelt = "The the idi0tic iddiot was a pathettic moronn and so stupiid of the scumm on a losserr. "
    plain = "The the garden was a quiet place and so green of the tree on a river. "
    assert np.diff(model.score([plain, misspelt]))[0] > 0.1


def test_toxicity_defined_cases(spark, docs):
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).prior == 0.0
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int"))
    assert one.prior == 1.0 and one.score(["anything", None]).tolist() == [1.0, 1.0]
    rng = random.Random(1)
    train = [(i, " ".join(rng.choices(["calm", "tree", "river"] + ["nasty"] * (i % 2), k=30)), i % 2) for i in range(200)]
    df = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.drop("toxic"), df.drop("text"))
    score = model.score([None, "", "42", "nastyy nasty tree " * 5, "river calm tree " * 5, "calm " * 40_000])
    assert score[0] == score[1] == score[2] == model.prior == 0.5
    assert score[3] > 0.5 > max(score[4], score[5])
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns


def _plain_score(model, text) -> float:
    """Words, their subwords and the weighted mean, one by one."""
    counts = Counter(w.lower() for w in re.findall(r"[^\W\d_]+", text or ""))
    if not counts:
        return model.prior
    total = weight = 0.0
    for word, n in counts.items():
        ids = brute.subword_buckets(word, toxicity.SIZES, toxicity.BITS)
        total += math.sqrt(n) * np.mean([model.weight[i] for i in ids])
        weight += math.sqrt(n)
    return 1 / (1 + math.exp(-(total / (weight + toxicity.PAD) + model.bias)))


def test_toxicity_scores_match_a_plain_mean(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], i % 2) for i, r in enumerate(rows) if r[0] is not None], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.weight) and np.any(model.weight)
    got = toxicity.score(docs, model, docs.columns).select("_row.*", "score").collect()  # the table has a column score itself
    assert len(got) == len(rows)
    for r in got:
        assert r[-1] == pytest.approx(_plain_score(model, r["text"]), abs=1e-4)


def test_one_step_of_training_matches_plain_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 1)
    rng = np.random.default_rng(1)
    sizes, labels, weight = np.array([2, 3, 1]), np.array([0, 1, 1]), np.array([.5, 1, 2], np.float32)
    ids, shares = np.array([5, 9, 5, 7, 9, 7]), rng.uniform(.1, 1, 6).astype(np.float32)
    got = toxicity.train(ids, shares, sizes, labels, weight, .3)
    first = np.random.default_rng(toxicity.SEED).uniform(-1 / toxicity.DIM, 1 / toxicity.DIM, (3, toxicity.DIM)).astype(np.float32)
    emb = dict(zip((5, 7, 9), first))
    docs, k = [], 0
    for n in sizes:
        docs.append(list(zip(ids[k:k + n], shares[k:k + n])))
        k += n
    p1 = .3  # the softmax begins with the prior alone
    d_soft, d_bias = np.zeros((toxicity.DIM, 2)), np.zeros(2)
    for doc, y, w in zip(docs, labels, weight):
        off = np.array([1 - p1, p1])
        off[y] -= 1
        mean = sum(s * emb[i] for i, s in doc)
        d_soft += np.outer(mean, off * w)
        d_bias += off * w
    soft = -toxicity.RATE * d_soft / np.sqrt(1e-8 + d_soft ** 2)
    bias = np.log([.7, .3]) - toxicity.RATE * d_bias / np.sqrt(1e-8 + d_bias ** 2)
    want = {i: emb[i] @ (soft[:, 1] - soft[:, 0]) for i in emb}  # embeddings don't move yet: the softmax was zero
    assert got.bias == pytest.approx(bias[1] - bias[0], rel=1e-4)
    assert all(got.weight[i] == pytest.approx(w, rel=1e-3, abs=1e-4) for i, w in want.items())
    assert np.flatnonzero(got.weight).tolist() == [5, 7, 9]


def test_classes_of_long_texts_only_are_learned(spark):
    """Texts longer than the window: seeded windows of them are learned from."""
    rng = random.Random(2)

    def text(words):
        return " ".join(rng.choices(words, k=6000))
    rows = [(i, text(["calm", "tree", "river"]), 0, "en") for i in range(20)] + [
        (20 + i, text(["calm", "tree", "nasty"]), 1, "fr") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    assert df.filter("length(text) > 20000").count() == 40
    score = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic")).score(["nasty tree " * 9, "river tree " * 9])
    assert score[0] > 0.5 > score[1]
    assert [x[0] for x in lang_id.identify_texts(lang_id.fit(df), ["nasty nasty nasty", "river river river"])] == ["fr", "en"]


def test_an_id_of_very_many_rows_stays_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BOUND", 50)
    df = spark.createDataFrame([(1 if i % 2 else 2, f"word{i} calm" if i % 2 else "nasty") for i in range(4000)], "doc_id long, text string")
    held = []
    monkeypatch.setattr(toxicity, "sample_per_label", lambda *a: held.append(sampling.sample_per_label(*a)) or held[-1])
    model = toxicity.fit(df, spark.createDataFrame([(1, 0), (2, 1)] * 30, "doc_id long, toxic int"))
    assert held[-1].count() < 200 and model.prior == 0.5
    assert model.score(["nasty nasty", "calm calm"])[0] > 0.5


def test_language_of_awkward_rows(spark, docs, rows, none):
    model = lang_id.fit(docs)
    got = lang_id.identify(docs, model)
    assert got.columns == ["doc_id", "lang_pred", "score", "spans"]
    got = got.collect()
    texts = [r[1] for r in rows]
    want = lang_id.identify_texts(model, texts)
    assert _multiset((r["doc_id"], r["lang_pred"], round(r["score"], 9), len(r["spans"])) for r in got) == _multiset(
        (r[0], w[0], round(w[1], 9), len(w[2])) for r, w in zip(rows, want))
    assert all(w[0] == "und" and w[1] == 0 for t, w in zip(texts, want) if not re.search(r"[^\W\d_]", t or ""))
    assert lang_id.identify(docs, lang_id.fit(none)).filter("lang_pred <> 'und'").isEmpty()
    assert lang_id.identify(none, model).collect() == []


# SentencePiece


def _enumerated(m, text: str) -> dict[tuple, float]:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = {sp.id_to_piece(i): i for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    s, found = "▁" + text.replace(" ", "▁"), []

    def go(i, ids, log_p):
        if i == len(s):
            found.append((tuple(ids), log_p))
        elif s[i] not in plain:
            go(i + 1, ids + [int(m.byte[b]) for b in s[i].encode()], log_p + m.log_spelt)
        for size in range(1, m.longest + 1):
            piece = s[i:i + size]
            if len(piece) == size and piece in plain:
                go(i + size, ids + [plain[piece]], log_p + m.log_p[plain[piece]])
    go(0, [], 0.0)
    log_all = math.log(sum(math.exp(x) for _, x in found))
    return {ids: x - log_all for ids, x in found}


def _samples(m, texts, seeds, k):
    out = [[] for _ in texts]
    for present, flat, ends, log_prob, score in sentencepiece_sample.sample_group(m, texts, np.array(seeds), k):
        begins = np.r_[0, ends[:-1]]
        for t in np.flatnonzero(present):
            out[t].append((tuple(flat[begins[t]:ends[t]].tolist()), log_prob[t], score[t]))
    return out


def test_sampling_follows_the_lattice():
    """First samples in proportion, no sample twice, scores that make sums unbiased (Horvitz-Thompson)."""
    m = sentencepiece_sample.model(PIECES)
    n, text = 6000, "the cats"
    p = _enumerated(m, text)
    got = _samples(m, [text] * n, range(n), 3)
    first = Counter(s[0][0] for s in got)
    assert all(abs(first[ids] / n - math.exp(x)) < 0.03 for ids, x in p.items())
    assert all(len({x[0] for x in s}) == 3 for s in got)
    assert all(math.isclose(x, p[ids], abs_tol=1e-9) for s in got[:200] for ids, x, _ in s)
    second = Counter(s[1][0] for s in got)
    for ids, x in p.items():
        want = sum(math.exp(y + x) / -math.expm1(y) for other, y in p.items() if other != ids and y < 0)
        assert abs(second[ids] / n - want) < 0.03
    mass = np.mean([sum(math.exp(x) / q for _, x, q in s) for s in got])
    assert abs(mass - 1) < 0.03


def test_sampling_gives_all_if_few():
    m = sentencepiece_sample.model(PIECES)
    for text in ("ab", "你", "\n", "", "▁"):
        p = _enumerated(m, text) if text else {(): 0.0}
        got = _samples(m, [text, "other words", text], [1, 2, 3], 50)
        for s in (got[0], got[2]):
            assert {ids for ids, _, _ in s} == set(p) and all(q == pytest.approx(1, abs=1e-6) for _, _, q in s)


def test_sampling_is_the_same_in_any_batch():
    m = sentencepiece_sample.model(PIECES)
    texts = [t or "" for t in _texts()]
    seeds = list(range(100, 100 + len(texts)))
    alone = [_samples(m, [t], [s], 2)[0] for t, s in zip(texts, seeds)]
    together = _samples(m, texts, seeds, 2)
    assert [[ids for ids, _, _ in s] for s in alone] == [[ids for ids, _, _ in s] for s in together]


def test_samples_decode_to_the_text(docs, rows):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_sample.sample_segmentations(docs, PIECES, ["doc_id", "text"], k=2)
    some = got.select("_row.text", F.explode("samples").alias("s")).select("text", "s.*")
    back = sentencepiece_sample.decode(some.withColumnRenamed("text", "was"), PIECES).collect()
    assert back and all(r["text"] == (r["was"] or "") and r["round_trip"] for r in back)
    assert all(sp.decode(list(r["ids"])) == r["text"] for r in back if len(r["ids"]) < 2000)
    assert got.count() == len(rows)


# WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://h/{i}\nx", h) for i, h in enumerate(
        [None, "", "<p>é</p>", "same", "same", "x" * 300_000, "same", "y\r\n\r\nz"])]
    pages += [(None, None, "same"), (3, "again", "same"), (None, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    index = warc.write_archives(df.repartition(3), folder=f"file://{tmp_path}/warc")
    got = warc.read_archives(index).collect()
    want = Counter()
    first = {}
    for i, _, h in pages:
        h = (h or "").encode()
        first[h] = min((x for x in (first.get(h), i) if x is not None), default=None)
    for i, u, h in pages:
        h = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        same = i == first[h]
        want[i, len(h), digest, "response" if same else "revisit", None if same else first[h], h if same else None,
             " ".join((u or "about:blank").split())] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"]), r["url"]) for r in got) == want
    # any selection can be read, and a plain reader sees whole archives
    few = warc.read_archives(index.filter("page_id = 5")).collect()
    assert len(few) == 1 and len(few[0]["payload"]) == 300_000
    plain = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/warc").iterdir())
    assert plain.count(b"WARC/1.1\r\n") == len(pages)


def test_warc_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                               "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(df, min_bytes=3)).select("page_id", "record_type").collect()
    assert dict(got) == {1: "response", 2: "response", 3: "response", 4: "revisit"}


# quality


def test_base_statistics(docs, rows):
    got = quality_mcd.quality_rules(docs).collect()
    names = [f.name for f in quality_mcd.BASE.fields]
    assert _multiset((r["doc_id"], *[r[c] for c in names], r["base_failed"]) for r in got) == _multiset(
        (r[0], *(s := brute.base_statistics(r[1])), s[0] < 50 or 100 * s[4] > 50 * s[0]) for r in rows)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_chi_squared():
    assert quality_mcd.chi2_point(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert quality_mcd.chi2_cdf(quality_mcd.chi2_point(1 - 1e-9, 5), 5) == pytest.approx(1 - 1e-9, abs=1e-12)


def _document(rng: random.Random, junk: bool) -> str:
    own = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(rng.randint(80, 400))]
    return " ".join(w + "***" if junk else w for w in own)


def test_outliers_are_rejected_per_group(spark):
    """A group where symbols are the rule keeps them; small groups are pooled; a third of junk breaks nothing."""
    rng = random.Random(6)
    rows = [(i, _document(rng, i % 5 == 0), "en", "big") for i in range(300)]
    rows += [(1000 + i, _document(rng, True), "en", "symbols") for i in range(120)]
    rows += [(2000 + i, _document(rng, i == 7), "fr", f"tiny{i}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    dropped = sorted(r["doc_id"] for r in quality_mcd.quality_rules(df).filter("NOT kept").collect())
    assert dropped == [i for i in range(300) if i % 5 == 0] + [2007]


def test_a_third_of_junk_is_rejected(spark):
    rng = random.Random(8)
    rows = [(i, _document(rng, i % 3 == 0), "en", "big") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    dropped = sorted(r["doc_id"] for r in quality_mcd.quality_rules(df).filter("NOT kept").collect())
    assert dropped == list(range(0, 600, 3))


def test_one_bad_statistic_rejects(spark):
    """Symbols behind half of the words, or two words in five repeated, are enough; clean texts are kept."""
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = _document(rng, False).split()
        if i % 10 == 0:
            words = [w + "*" * (j % 2) for j, w in enumerate(words)]
        elif i % 10 == 1:
            words[:2 * len(words) // 5] = (words[:8] * len(words))[:2 * len(words) // 5]
        rows.append((i, " ".join(words), "en", "s"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    got = quality_mcd.quality_rules(df)
    assert got.filter("base_failed").count() == 0
    assert sorted(r["doc_id"] for r in got.filter("NOT kept").collect()) == [i for i in range(400) if i % 10 < 2]


def test_least_variance_leaves_greater_ones():
    least = np.square(quality_mcd.LEAST)
    variances = least * [4, 0, .5, 9, 1]
    assert np.allclose(np.linalg.inv(quality_mcd._raised(np.diag(variances))), np.diag(np.maximum(variances, least)))


def _vectors(spark, *groups):
    rows = [(name, 0, i, *map(float, v)) for name, x in groups for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "grp string, _fk long, _rx long, v0 double, v1 double, v2 double, v3 double, v4 double")
    return util.stage(df), len(rows)


def _plain_steps(x, mean, cov):
    """Concentration over bins until the determinant falls no more."""
    best = None
    while True:
        d = np.einsum("ij,jk,ik->i", x - mean, quality_mcd._raised(cov), x - mean)
        b = np.floor(quality_mcd.BINS * np.log2(np.maximum(d, 2.0 ** -10)))
        inner = x[b <= np.sort(b)[max(math.ceil(.5 * len(x)), (len(x) + 6) // 2) - 1]]
        mean = inner.mean(0)
        cov = (inner - mean).T @ (inner - mean) / len(inner) * quality_mcd.consistency(len(inner) / len(x))
        log_det = -np.linalg.slogdet(quality_mcd._raised(cov))[1]
        if best is not None and log_det >= best[0] - quality_mcd.FALL:
            return best
        best = log_det, mean, cov


def test_starts_match_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (600, 5)) @ np.diag([1, .3, .2, .5, .4]) + 2
    x[:200, :2] += 8
    got = {r["start"]: r for r in quality_mcd.concentrated(*_vectors(spark, ("g", x))).collect()}
    q = np.quantile(x, [.25, .5, .75], axis=0, method="inverted_cdf")
    spread = np.diag(((q[2] - q[0]) / 1.349) ** 2)
    begins = {"median": (q[1], spread), "mean": (x.mean(0), np.cov(x.T, bias=True)), "lower": (q[0], spread), "upper": (q[2], spread)}
    assert set(got) == set(begins)
    for start, begin in begins.items():
        log_det, mean, _ = _plain_steps(x, *begin)
        assert got[start]["log_det"] == pytest.approx(log_det, abs=1e-6) and np.allclose(got[start]["mean"], mean)


def test_least_determinant_is_kept_where_a_start_fails(spark):
    """A group whose junk (45 %) lies so that some start ends at a greater determinant, beside a clean group."""
    rng = np.random.default_rng(5)
    clean = rng.normal(0, 1, (2000, 5)) @ np.diag([.6, .1, .2, .3, .3]) + [5, 1.6, 1, 1, 1]
    mixed = rng.normal(0, 1, (2000, 5)) @ np.diag([.6, .1, .2, .3, .3]) + [5, 1.6, 1, 1, 1]
    mixed[:900] += 8 * np.array([.6, .1, .2, .3, .3])
    vectors, n = _vectors(spark, ("clean", clean), ("mixed", mixed))
    ends = [r["log_det"] for r in quality_mcd.concentrated(vectors, n).filter("grp = 'mixed'").collect()]
    assert max(ends) > min(ends) + 1  # a start failed
    found = {r["grp"]: r for r in quality_mcd.estimates(vectors, n).collect()}
    for name, x in (("clean", clean), ("mixed", mixed)):
        mean, precision = np.array(found[name]["mean"]), np.array(found[name]["precision"]).reshape(5, 5)
        d = np.einsum("ij,jk,ik->i", x - mean, precision, x - mean)
        out = d > quality_mcd.chi2_point(1 - quality_mcd.TAIL, 5)
        if name == "mixed":
            assert out[:900].mean() > .95
            out = out[900:]
        assert out.mean() < .005 and np.allclose(mean, [5, 1.6, 1, 1, 1], atol=.15)


# row places


def test_rows_of_joins_and_explodes_get_places_of_their_own(spark, sf_dir):
    read = util.table(spark, sf_dir, "documents").select("doc_id", "text").filter("doc_id < 50")
    twice = read.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    joined = read.join(twice.select("doc_id", "copy"), "doc_id")
    assert util.from_files(read) and not util.from_files(twice) and not util.from_files(joined)
    for df in (read, twice, joined):
        keyed = util.row_keyed(df)
        assert keyed.select("_fk", "_rx").distinct().count() == df.count()
    assert exact_dedup.drop_exact_copies(twice).count() == exact_dedup.drop_exact_copies(read).count()


# empty tables


def test_empty_tables(spark, none):
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.drop_exact_copies(none).count() == 0
    assert sharding.shard_records(none).count() == mixture.mix_report(none).count() == mixture.mix(none).count() == 0
    assert simhash_golay.near_duplicates(none).count() == simhash_golay.drop_near_copies(none).count() == 0
    assert quality_mcd.quality_rules(none).count() == 0
    assert lang_id.identify(none, lang_id.fit(none)).count() == 0
    assert token_count.token_counts(none, TOKENIZER).count() == 0
    assert toxicity.drop_toxic(none, toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
    assert sentencepiece_sample.sample_segmentations(none, PIECES, ["doc_id"]).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages)).count() == 0


def test_words_of_long_and_empty_texts():
    words = chars.words_of(["", "Ab c", "x" * 100_000, "1 2"])
    assert words.text.tolist() == [1, 1, 2] and (words.end - words.begin).tolist() == [2, 1, 100_000]
    assert "".join(map(chr, words.letters[words.begin[0]:words.end[0]])) == "ab"
