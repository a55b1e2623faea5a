"""Each stage of the pipeline on its own input against brute force."""

import hashlib

import pytest

import corpus_pipeline as pipeline
from embercast.llm import quality_model
from tests.llm.helpers import documents, frame, prose, tiktoken_encoding
from tests.llm.test_duplicates import byte_marks, groups

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_are_the_named_ones():
    assert [f.__name__ for _, f in pipeline.STAGES] == ["quality", "near_duplicates", "repeated_strings", "mixture", "token_ids"]


def test_quality_stage_drops_junk_and_keeps_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = pipeline.quality(spark, docs, "/root/testdata/sf0.01")
    assert out.columns == COLUMNS
    kept = {r["doc_id"] for r in out.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) > 0.98 * len(good)
    assert sum(d in kept for d, q in labels.items() if q == 0) < 0.2 * (len(labels) - len(good))


def test_near_duplicate_stage(spark):
    rows = documents()
    want = groups([r[:2] for r in rows], 5, 80)
    got = pipeline.near_duplicates(spark, frame(spark, rows), SF)
    assert got.columns == COLUMNS
    kept = {(d, t) for (d, t), (_, c) in want.items() if d is None or c == d}
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == kept


def test_repeated_string_stage(spark):
    rows = documents()
    want = byte_marks([r[:2] for r in rows], 100)
    got = pipeline.repeated_strings(spark, frame(spark, rows), SF)
    assert got.columns == COLUMNS and got.count() == len(rows)
    left = sorted((str(d), bytes(b for b, m in zip(*x) if not m).decode("utf-8", "ignore")) for (d, _), x in want.items() for _ in range(sum((r[0], r[1]) == (d, _t) for r in rows for _t in [_])))
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == left
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in got.collect())


def test_mixture_and_token_stages(spark):
    docs = frame(spark, documents())
    mixed = pipeline.mixture(spark, docs, SF)
    assert mixed.columns == COLUMNS
    text = {str(r["doc_id"]): r["text"] or "" for r in mixed.collect()}
    enc = tiktoken_encoding()
    for r in pipeline.token_ids(spark, mixed, SF).collect():
        t = text[str(r["doc_id"])]
        assert r["ids"] == enc.encode_ordinary(t) and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["near_duplicates", "repeated_strings", "mixture", "token_ids"])
def test_stages_on_an_empty_table(spark, name):
    assert getattr(pipeline, name)(spark, frame(spark, []), SF).count() == 0


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0
    ids = {r["doc_id"] for r in out.collect()}
    assert ids <= {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert quality_model.CHUNK == 2 * quality_model.HOP


def test_prose_helper_is_clean():
    import random

    assert prose(random.Random(1), 5).count(" ") == 4
