"""Columns of documents that are named like columns of the operators come back unchanged."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cipherledger.llm import decontaminate, disclosure, line_dedup, near_dedup

NAMES = [
    "_row", "row", "_key", "key", "_doc", "doc", "_h", "h", "_lines", "lines", "_text", "_text_hash", "text_hash", "_flags", "flags", "_gone", "gone", "_kept", "stay",
    "lost_id", "lost_hash", "lost_key", "whole", "parts", "last", "_parts", "_last", "_lang_pred", "_lang_score", "value",
]


@pytest.fixture(scope="module")
def rows(vocabulary):
    rng = random.Random(21)

    def words(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    footer = "the footer line that stands in many documents here"
    texts = [f"{words(30)}\n{words(12)}\n{footer}" for _ in range(12)] + [f"call +49 30 1234567 or mail a{i}@b.org from 10.0.0.{i}" for i in range(4)]
    texts += [texts[0], texts[1] + " end"]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def clashing(spark, rows):
    schema = "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)
    # one value in all rows, as a number of the row would not be
    return spark.createDataFrame([(i, t, len(t), *(["5"] * len(NAMES))) for i, t in rows], schema).repartition(3)


def same_columns(out, docs):
    assert out.columns == docs.columns
    assert {r[n] for r in out.collect() for n in NAMES} <= {"5"} and out.count() > 0


def test_sanitised_and_spans(clashing, rows):
    same_columns(disclosure.sanitised(clashing), clashing)
    plain = clashing.select("doc_id", "text")
    assert {r.doc_id: r.text for r in disclosure.sanitised(clashing).collect()} == {r.doc_id: r.text for r in disclosure.sanitised(plain).collect()}
    both = [{r.doc_id: str(r.spans) for r in disclosure.listed(d).collect()} for d in (clashing, plain)]
    assert both[0] == both[1] and len(set(both[0].values())) > 1


@pytest.mark.parametrize("work", ["cleaned", "unique", "clean", "languages"])
def test_stages_keep_columns(spark, clashing, rows, work):
    benchmark = spark.createDataFrame([(1, rows[2][1])], "item_id bigint, text string")

    def run(docs):
        if work == "languages":
            return corpus_pipeline.languages(spark, docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")), "")
        return {"cleaned": line_dedup.cleaned, "unique": near_dedup.unique, "clean": lambda d: decontaminate.clean(d, benchmark)}[work](docs)

    out, plain = run(clashing), run(clashing.select("doc_id", "text"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((r.doc_id, r.text) for r in plain.collect())
    if work == "languages":
        out = out.drop("lang")
    if out.count():
        same_columns(out, clashing)
    assert work in ("languages", "cleaned") or out.count() < len(rows)
