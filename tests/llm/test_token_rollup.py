import os
from collections import Counter

import pytest

from weftline.llm.token_rollup import TokenRollup, count_tokens, deletes, inserts, revisions
from weftline.llm.tokenizer import DEFAULT_VOCABULARY, encoding, read_vocabulary

ROW = "source string, lang string, n_tokens long, tokenizer int, d_docs string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], ROW)


def state(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def want(*signed):
    docs, tokens = Counter(), Counter()
    for sign, version, rows in signed:
        for source, lang, n in rows:
            docs[source, lang, version] += sign
            tokens[source, lang, version] += sign * (n or 0)
    return {k: (docs[k], tokens[k]) for k in docs if docs[k] or tokens[k]}


def test_batches_against_plain_sums(spark):
    a = [("s", "en", 5), ("s", "en", 7), ("t", None, 3), (None, "de", None), ("t", "fr", 0)]
    b, c = [("s", "en", 9), ("u", "en", 1)], [("s", "de", 7)]
    r = TokenRollup(spark)
    assert state(r) == {}
    assert r.commit("load", inserts(table(spark, a), "v1"))
    assert not r.commit("load", inserts(table(spark, b), "v1"))
    assert state(r) == want((1, "v1", a))
    assert r.commit("more", inserts(table(spark, b), "v1"))
    assert r.commit("moved", revisions(table(spark, a[1:2]), table(spark, c), "v1", "v2"))
    assert r.commit("gone", deletes(table(spark, a[2:3]), "v1"))
    assert r.commit("nothing", inserts(table(spark, []), "v1"))
    total = want((1, "v1", a), (1, "v1", b), (-1, "v1", a[1:2]), (1, "v2", c), (-1, "v1", a[2:3]))
    assert state(r) == total
    r.compact()
    assert state(r) == total and {b.batch_id for b in r.committed().collect()} == {"load", "more", "moved", "gone", "nothing"}
    assert not r.commit("gone", deletes(table(spark, a), "v1")) and state(r) == total
    assert r.commit("late", inserts(table(spark, c), "v2"))
    r.compact()
    r.compact()
    assert state(TokenRollup(spark, r.folder)) == want((1, "v1", a), (1, "v1", b), (-1, "v1", a[1:2]), (1, "v2", c), (-1, "v1", a[2:3]), (1, "v2", c))


def test_a_commit_within_compact_counts_once(spark, monkeypatch):
    r = TokenRollup(spark)
    r.commit("a", inserts(table(spark, [("s", "en", 5)]), "v"))
    plain = r._sums

    def slow(base, batches):
        out = plain(base, batches)
        TokenRollup(spark, r.folder).commit("b", inserts(table(spark, [("s", "en", 10)]), "v"))
        return out

    monkeypatch.setattr(r, "_sums", slow)
    r.compact()
    monkeypatch.undo()
    assert state(r) == {("s", "en", "v"): (2, 15)}
    before = r.totals()
    r.compact()
    # what was read before stays there, and old ids stay known when their folders are gone
    assert [(x.n_docs, x.n_tokens) for x in before.collect()] == [(2, 15)]
    for _ in range(3):
        r.compact()
        assert state(r) == {("s", "en", "v"): (2, 15)}
    assert r._names("batches") == [] and len(r._names("bases")) == 2
    assert not r.commit("a", inserts(table(spark, [("s", "en", 5)]), "v")) and {b.batch_id for b in r.committed().collect()} == {"a", "b"}


def test_failed_batch_leaves_nothing(spark):
    r = TokenRollup(spark)
    bad = inserts(table(spark, [("s", "en", 1)]), "v1").selectExpr("source", "lang", "tokenizer", "d_docs", "cast(raise_error('no') as long) as d_tokens")
    with pytest.raises(Exception, match="no"):
        r.commit("bad", bad)
    assert state(r) == {} and r.commit("bad", inserts(table(spark, [("s", "en", 1)]), "v1"))
    for name in ("", "a/b", ".x", "_x"):
        with pytest.raises(ValueError):
            r.commit(name, inserts(table(spark, []), "v1"))


@pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")
def test_counts(spark):
    data = read_vocabulary()
    texts = ["Hello there, world.", None, "", " \n", "é" * 1000, "the er " * 30_000, "Hello there, world.", "a\tb" * 40_000, "x" * 70_000, "語文" * 35_000, " " * 140_000 + "y"]
    docs = spark.createDataFrame([(i, t, "s", "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, data).collect()}
    enc = encoding(data)
    assert all(got[i] == len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert count_tokens(docs.limit(0), data).collect() == []
