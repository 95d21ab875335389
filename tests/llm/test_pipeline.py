"""Each stage of the pipeline on the smallest given tables, against a plain version of it."""

import os
import re

import pyarrow as pa
import pytest
from test_decontaminate import plain
from test_mixing import targets
from test_ngram_join import brute

import corpus_pipeline
from weftline.llm import decontaminate
from weftline.llm.labels import labelled_texts
from weftline.llm.language_id import fit_language_id, held_out
from weftline.llm.shingles import text_bytes
from weftline.llm.toxicity import train_toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def tables(spark):
    out = [spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SF), "test")
        out.append(docs.collect())
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_toxicity(spark, tables):
    model = train_toxicity(labelled_texts(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), "toxic"))
    assert ids(tables[1]) == sorted(r.doc_id for r in tables[0] if model.score(pa.array([r.text]))[0] < 0.5)
    assert len(tables[1]) >= 0.9 * len(tables[0])


def test_language(spark, tables):
    docs = spark.createDataFrame(tables[1])
    model = fit_language_id(docs.where(~held_out(docs.doc_id)))
    bits = lambda t: model.bits(*text_bytes(pa.array([t]))).min() / len(t.encode())
    assert ids(tables[2]) == sorted(r.doc_id for r in tables[1] if r.text and any(c.isalpha() for c in r.text) and bits(r.text) < 7.6)


def test_near_duplicates(tables):
    assert ids(tables[3]) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in tables[2]])})


def test_decontamination(spark, tables):
    items = [decontaminate.normal_words(pa.array([r.text]))[0].tolist() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = []
    for r in tables[3]:
        words = decontaminate.normal_words(pa.array([r.text]))[0].tolist()
        # an alignment is worth 2 points at most for each word of the item that the text holds
        if not any(2 * sum(w in own for w in i) >= max(16, len(i)) and (p := plain(i, words)) >= 16 and p >= len(i) for own in [set(words)] for i in items):
            want.append(r.doc_id)
    assert ids(tables[4]) == sorted(want)


def test_mixing(tables):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in tables[4]:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in tables[5]:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 < r.taken <= 3 * r["size"]
    assert all(abs(taken.get(s, 0) - t) <= 1.001 for s, t in targets(sizes).items())


def test_columns_and_run(spark, tables):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(t[0].asDict()) == columns for t in tables[:5])
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, tables[5]))
