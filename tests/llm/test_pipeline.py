"""The pipeline's stages, each on what the one before it kept, and the entry module without them."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from presslens.llm import mixture, sentencepiece_sample, toxicity, util

ROOT = Path(__file__).resolve().parents[2]
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = util.table(spark, sf_dir, "documents")
    found = {"documents": docs}
    for name, step in corpus_pipeline.STAGES:
        docs = found[name] = util.stage(step(spark, docs, sf_dir))
    return found


def _ids(df) -> list[int]:
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def _before(name: str) -> str:
    names = ["documents", *[n for n, _ in corpus_pipeline.STAGES]]
    return names[names.index(name) - 1]


def test_stages_are_those_asked_for():
    words = ["toxicity", "exact dedup", "SimHash", "mixing", "SentencePiece"]
    assert all(w in n for w, (n, _) in zip(words, corpus_pipeline.STAGES, strict=True))


def test_columns_of_documents_stay(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_toxic_documents_go(spark, sf_dir, stages):
    docs = stages["documents"]
    model = toxicity.fit(docs, util.table(spark, sf_dir, "labels"), learn=util.mod_crc32(F.col("id"), 5) != 0)
    rows = docs.select("doc_id", "text").collect()
    low = model.score([r["text"] for r in rows]) < 0.5
    kept = set(_ids(stages["toxicity"]))
    # float sums may differ in their last bits between batches
    assert len(kept ^ {r["doc_id"] for r, x in zip(rows, low) if x}) <= 1
    assert 0.8 < np.mean(low) < 1


def test_exact_copies_go(stages):
    rows = stages["toxicity"].select("doc_id", "text").collect()
    first = {}
    for r in sorted(rows):
        first.setdefault(brute.sha256(r["text"]), r["doc_id"])
    assert _ids(stages["exact dedup"]) == sorted(first.values())


def test_near_copies_go(stages):
    name = "SimHash near-dedup"
    rows = stages[_before(name)].select("doc_id", "text").collect()
    fps = [brute.simhash(r["text"]) for r in rows]
    least = brute.components([r["doc_id"] for r in rows], fps)
    assert _ids(stages[name]) == sorted(set(least.values()))


def test_mix_takes_what_its_report_says(stages):
    name = "mixing sources to target weights"
    report = mixture.mix_report(stages[_before(name)]).collect()
    assert Counter(_ids(stages[name])) == Counter({r["doc_id"]: r["copies"] for r in report if r["copies"]})


def test_samples_decode_to_their_documents(stages):
    name = "SentencePiece sampling"
    m = sentencepiece_sample.model(PIECES)
    texts = {r["doc_id"]: r["text"] for r in stages[_before(name)].select("doc_id", "text").collect()}
    rows = stages[name].collect()
    assert len(rows) == 2 * stages[_before(name)].count()
    assert all(m.decode(r["ids"]) == texts[r["doc_id"]] and len(r["ids"]) == r["n_pieces"] for r in rows)
    distinct = {}
    for r in rows:
        distinct.setdefault(r["doc_id"], {})[r["sample"]] = tuple(r["ids"])
    assert all(s[1] != s[2] for s in distinct.values())


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "sample", "n_pieces")
    assert Counter(map(tuple, got.collect())) == Counter(
        map(tuple, stages["SentencePiece sampling"].select("doc_id", "sample", "n_pieces").collect()))


def test_stages_of_awkward_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies long, size string"
    rows = [(None, None, None, None, None, 1, "x"), (1, "", "en", "a", 0, 1, "x"), (1, "", "en", "a", 0, 1, "x"),
            (2, "word " * 40_000, None, None, 5, 1, "x"), (3, "word  " * 40_000, "en", "a", 5, 1, "x"),
            (4, "a few words of one more text", "en", "b", 5, 1, "x")]
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = util.stage(step(spark, docs, sf_dir))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert {r["doc_id"] for r in last.collect()} <= {None, 1, 2, 4}
        assert bool(own) == (not last.isEmpty())


def test_entry_without_the_subpackage(tmp_path):
    """With the folders and the pipeline gone, the other queries are still there."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "presslens.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert "d14_bias_score" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True)
