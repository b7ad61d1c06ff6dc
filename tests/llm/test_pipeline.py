"""The pipeline's stages against brute force, stage by stage."""

from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_texts import brute_classes, brute_lines, brute_statistics
from zonehour.llm import bpe, mixing
from zonehour.llm.queries import LINE_DOCS

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents, and each stage's rows as written and read again."""
    at, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    out.append(at)
    for name, stage in corpus_pipeline.STAGES:
        path = str(Path(tmp_path_factory.mktemp("stages"), name))
        stage(spark, at, SF_DIR).write.parquet(path)
        at = spark.read.parquet(path)
        out.append(at)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_are_the_five_in_order(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    assert all(step.columns == steps[0].columns for step in steps[1:5])


def test_quality_stage_keeps_rows_that_pass(steps):
    given, kept = dict(pairs(steps[0])), dict(pairs(steps[1]))
    assert all(given[d] == t for d, t in kept.items()) and 0 < len(kept) < len(given)
    for d, t in given.items():
        words, _, _, _, repeats = brute_statistics(t)
        assert d not in kept or not (words < 50 or 2 * repeats > words)


def test_line_stage_equals_brute_force(steps):
    import hashlib

    want = brute_lines(pairs(steps[1]), LINE_DOCS)
    assert Counter((d, h) for d, _, _, h in want.elements()) == Counter(
        (d, hashlib.sha256(t.encode()).hexdigest()) for d, t in pairs(steps[2]))
    assert steps[2].where("n_chars != length(text)").count() == 0


def test_near_stage_keeps_the_first_of_each_class(steps):
    assert {d for d, _ in pairs(steps[3])} == {first for _, first, _ in brute_classes(pairs(steps[2]))}
    assert set(pairs(steps[3])) <= set(pairs(steps[2]))


def test_mixing_stage_keeps_all_and_meets_the_weights(steps):
    given, mixed = Counter(pairs(steps[3])), Counter(pairs(steps[4]))
    assert set(given) == set(mixed)
    counts = Counter(r.source for r in steps[3].collect())
    weights = mixing.default_weights(counts)
    got, rows = Counter(r.source for r in steps[4].collect()), sum(mixed.values())
    assert all(abs(got[s] - rows * weights[s] / sum(weights.values())) < mixing.BLOCK_ROWS for s in counts)


def test_last_stage_equals_the_public_library(steps):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.load_ranks(
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want = Counter((d, tuple(library.encode_ordinary(t)), t.encode()) for d, t in pairs(steps[4]))
    got = Counter((r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), bytes(r.decoded)) for r in steps[5].collect())
    assert got == want


def test_run_gives_the_last_stage(spark, steps):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == steps[5].columns
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in steps[5].collect())


def test_run_on_odd_tables(spark, tmp_path):
    """No documents at all, and documents with extra columns whose names the stages use themselves."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    docs.where("doc_id < 60").selectExpr("*", "1 AS row", "'x' AS mix_slot", "0 AS _rank", "2 AS ids").write.parquet(
        f"{tmp_path}/more/documents.parquet")
    for name in ("none", "more"):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/more")
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and 0 < out.select("doc_id").distinct().count() <= 60
