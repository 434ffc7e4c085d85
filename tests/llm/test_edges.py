"""Odd tables for every corpus operator and every stage: no rows, nulls, repeated rows, long texts, clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayfold.llm import bpe_codec, common, exact_dedup, jaccard_join, language_id, line_dedup, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
CLASHING = ["id", "z", "root", "n", "score", "digest", "tokens", "path", "copies", "spans", "label", "t", "grams", "_0", "_1", "_2", "__id", "__digest", "__score", "__doc", "__null", "__d", "__r", "__t", "class_id", "n_links", "keep_id", "held_out", "data"]


def frame(spark, rows):
    made = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    return made.withColumns({c: F.lit("x") for c in CLASHING})


def labels(spark, rows):
    return spark.createDataFrame(rows, LABELS)


def byte_bpe():
    return words.public_path("byte_bpe_50k.json")


OPERATORS = {
    "quality_classifier": lambda d, y: quality_classifier.scored(d.select("doc_id", "text"), quality_classifier.fit(d, y)),
    "language_id": lambda d, y: language_id.identify(d, language_id.fit(d)),
    "suffix_dedup": lambda d, y: suffix_dedup.report(d),
    "exact_dedup": lambda d, y: exact_dedup.exact_dedup(d),
    "quality_rules": lambda d, y: quality_rules.judge(d, y),
    "jaccard_join": lambda d, y: jaccard_join.similarity_classes(d),
    "packing": lambda d, y: packing.pack_documents(d, words.public_path(packing.VOCABULARY)),
    "token_counts": lambda d, y: token_counts.count_tokens(d, byte_bpe()),
    "line_dedup": lambda d, y: line_dedup.dedup_lines(d),
    "bpe_codec": lambda d, y: bpe_codec.round_trip(d, byte_bpe()),
}
ODD = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t\n "), (None, "a null id"), (None, None), (5, "long words " * 40_000), (6, "x" * 300_000), (7, "one two three four five six")]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](frame(spark, []), labels(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_its_result(spark, name):
    known = labels(spark, [(1, 1, 0), (2, 0, 0), (None, 1, None), (3, None, None)])
    rows = OPERATORS[name](frame(spark, ODD), known).collect()
    key = "id" if name == "jaccard_join" else "doc_id"
    ids = [None if r[key] == common.NULL_ID else r[key] for r in rows]
    if name == "packing":
        assert set(ids) == {i for i, _ in ODD}
    else:
        assert Counter(ids) == Counter(i for i, _ in ODD)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    labels(spark, [(1, 1, 0), (2, None, None)]).write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], ODD):
        docs = frame(spark, rows)
        got = stage(spark, docs, str(tmp_path))
        found = got.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == docs.columns
            assert all(r[c] == "x" for r in found for c in CLASHING)
            assert {r.doc_id for r in found} <= {i for i, _ in rows}
        assert bool(found) == bool(rows)


def test_rows_that_share_a_doc_id_keep_their_own_texts(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(None, one), (None, two), (5, three), (5, one + " tail"), (6, three + " tail"), (7, "short text")]
    docs = frame(spark, rows)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, one), (None, two), (5, three), (7, "short text")])
    links = Counter((r.id, r.class_id, r.n_links) for r in jaccard_join.similarity_classes(docs).collect())
    null = common.NULL_ID
    assert links == Counter([(null, null, 1), (null, null, 0), (5, 5, 1), (5, null, 1), (6, 5, 1), (7, 7, 0)])
    cut = Counter((r.doc_id, r.text) for r in suffix_dedup.cut_repeats(docs).collect())
    assert cut == Counter([(None, one), (None, two), (5, three), (5, " tail"), (6, " tail"), (7, "short text")])
    lines = frame(spark, [(None, "first line of its own\n" + one), (None, two + "\n" + three), (3, one + "\nother words stay here")])
    got = Counter((r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(lines).collect())
    assert got == Counter([(None, "first line of its own\n" + one), (None, two + "\n" + three), (3, "other words stay here")])


def test_quality_rules_trust_every_good_label(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 17}" for j in range(1, 15 + i % 5))) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality")).filter("doc_id % 3 = 0")
    want = sorted(quality_rules.judge(docs, labels).select("doc_id", "llr", "kept").collect())
    monkeypatch.setattr(quality_rules, "TRUSTED", 3)  # more than that meet by a shuffle, all of them
    assert sorted(quality_rules.judge(docs, labels).select("doc_id", "llr", "kept").collect()) == want
