"""Stages and operators on columns with clashing names, null and repeated ids, and repeated rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadloom.llm import common, decontaminate, mixing, ngram_lr, pii, secrets, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "lang_pred", "ambiguous", "__text", "__id", "__key", "text_key", "__n", "__i", "rate", "n_tokens", "p_good", "row_key", "spans", "items", "w", "t", "k0", "m0", "_1", "changed", "fp"]


def tables(spark, folder):
    rows = [(i, f"these are the plain words of the text number {i} in a line {i * 7} more", "en" if i % 2 else "de", "s", 40) for i in range(30)]
    rows += [rows[3], (None, "a text of its own without an id here", "en", "s", 1), (None, None, None, None, None), (4, "another text that has the id of a third one", "en", "s", 1), (40, "see the secret benchmark words of one item that nobody may train on today ok", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).select("*", *(F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias(c) for c in CLASHES))
    spark.createDataFrame([(1, "the secret benchmark words of one item that nobody may train on today")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


@pytest.mark.filterwarnings("ignore:targets are out of reach")
def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        for r in out.collect():
            assert all(r[c] == f"{c}:{'null' if r.doc_id is None else r.doc_id}" for c in CLASHES), name
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "tokens"
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_leaks_go_by_row(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, words), (1, "clean"), (None, words), (None, "clean too"), (2, None), (1, words)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, words)], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench).collect()
    assert sorted(map(repr, left)) == sorted(map(repr, [r for r in docs.collect() if r.text != words]))


def test_keep_one_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "x y z u v w"), (None, None), (None, None)], "doc_id long, text string")
    assert sorted(map(repr, simhash.keep_one(docs).collect())) == sorted(map(repr, [docs.collect()[i] for i in (0, 3, 4)]))


def test_scores_replace_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "a token = \"abcdefgh\" here", "old", "old"), (2, None, "old", "old")], "doc_id long, text string, score string, spans string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (toxicity.score(docs, toxicity.fit(docs, labels), docs.columns), ngram_lr.score(docs, ngram_lr.fit(docs, labels, "quality"), docs.columns)):
        assert out.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in out.select("doc_id", "text", "score").collect())
    out = secrets.scan(docs, secrets.SecretModel(None), docs.columns)
    assert {r.doc_id: r.spans for r in out.select("doc_id", "spans").collect()} == {1: "assign:2:19", 2: ""}


def test_pseudonyms_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "at 10.0.0.255", "c", "m", "x")], "doc_id long, text string, changed string, __m string, __c string")
    out = pii.pseudonymise(docs, "k")
    assert out.columns == [*docs.columns[:2], "__m", "__c", "changed"]
    assert out.first()["__m"] == "m" and [c.kind for c in out.first().changed] == ["ip"]


def test_mixing_reports_rates_by_row(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="out of reach"):
        assert [r.rate for r in mixing.mix(docs, labels).collect()] == [1.0, 1.0, 1.0]


def test_classes_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(common, "MAX_STRATA", 3)
    with pytest.raises(ValueError, match="classes"):
        common.sampling_shares(spark.range(9), "id", 2)
