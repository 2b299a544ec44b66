"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from tsq.llm import chunks, classifier, decontam, lm, mixing, neardup, pii, quality, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, `key` string, row string, spans string, `_t` string"
LONG = "word " * 30_000 + "7" * 5000 + " a@b.c " + "é" * 3000


def rows():
    out = [
        (1, "the quick brown fox jumps over the lazy dog " * 8, "en", "s1"),
        (2, None, None, None),
        (3, "", "en", "s1"),
        (3, "", "en", "s1"),
        (None, "a text without an id, call +1 (980) 555-2833 now", "en", "s2"),
        (4, "the quick brown fox jumps over the lazy dog " * 8, "en", "s2"),
        (4, "the quick brown fox jumps over the lazy dog " * 8, "en", "s2"),
        (5, LONG, "de", "s3"),
        (6, " \n\t ", "de", None),
        (7, "\U0001f600 � one", "de", "s1"),
    ]
    return [(*r, 9, 1, "k", "r", "x", "t") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (None, "quick brown fox jumps over the lazy dog the quick"), (4, "short")], "item_id long, text string")


def calls(labels, bench):
    return {
        "leaks": lambda d: decontam.find_leaks(d, bench),
        "clean": lambda d: decontam.drop_leaks(d, bench),
        "mix": mixing.mix_sources,
        "suffix": suffix.remove_repeats,
        "classifier": lambda d: classifier.score_quality(d, labels),
        "lm": lambda d: lm.score_texts(d, rounds=1),
        "quality": quality.quality_features,
        "kept": quality.filter_quality,
        "neardup": neardup.duplicate_classes,
        "one": neardup.keep_one,
        "pii": pii.find_spans,
        "mask": pii.mask_text,
        "chunks": chunks.dedup_chunks,
        "trees": lambda d: tokens.build_trees(d).drop("tree_chars"),
    }


NAMES = list(calls(None, None))
BY_ROW = {"mix", "suffix", "classifier", "lm", "quality", "neardup", "pii", "mask", "chunks", "trees"}


@pytest.mark.parametrize("name", NAMES)
def test_edges(docs, labels, bench, name):
    got = calls(labels, bench)[name](docs).collect()
    if name in BY_ROW:
        assert len(got) == 10
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows())
    if name == "leaks":
        assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, None), (4, None), (4, None)]
    if name == "one":
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "5", "6", "7", "None"]
    if name == "suffix":
        assert {r["doc_id"]: r["n_removed"] for r in got}[4] == 352
    if name == "mask":
        assert next(r["text"] for r in got if r["doc_id"] is None).endswith("call [PHONE] now")
        assert next(r["text"] for r in got if r["doc_id"] == 2) is None


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(docs, labels, bench, name):
    none = docs.where("false")
    out = calls(labels, bench)[name](none)
    assert out.collect() == [] and out.columns


def test_all_null_texts(docs, labels, bench):
    void = docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    for name in ("mix", "suffix", "chunks", "pii", "quality"):
        assert len(calls(labels, bench)[name](void).collect()) == 10
