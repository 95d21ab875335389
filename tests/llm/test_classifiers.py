import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm.common import held_out
from weftline.llm.labels import labelled_sample
from weftline.llm.quality import FEATURES, document_statistics, fit_quality, fit_trees, score_quality
from weftline.llm.shingles import text_bytes
from weftline.llm.toxicity import (
    _EDGE,
    _STEPS,
    _WEIGHT,
    WINDOW,
    _machine,
    features,
    fit_toxicity,
    kernel_values,
    letter_words,
    score_toxicity,
    train_toxicity,
    triple_place,
    without_toxic,
)

SYLLABLES = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
INSULTS = ["grobnik", "slurfen", "wazzock"]


def sentence(rng, n=40):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def corpus(rng, n=300):
    rows = []
    for i in range(n):
        toxic, bad = rng.random() < 0.4, rng.random() < 0.3
        words = sentence(rng).split(" ")
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        if bad:
            words = [w + rng.choice(["###", "%%%"]) for w in words]
        rows.append((i, " ".join(words), int(not bad), int(toxic)))
    return rows


EDGES = [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "12 34 !!"), (9004, "the er " * 40_000 + "grobnik"), (None, "slurfen the"), (9005, "x"), (9005, "x")]


def frames(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], "en", "s", 1.0, 2) for r in rows] + [(*e, "en", None, 1.0, 2) for e in EDGES], "doc_id long, text string, lang string, source string, score double, label int")
    labels = spark.createDataFrame([(r[0], r[2], r[3], 0) for r in rows] + [(None, 1, 1, 0), (9001, None, None, 0), (5, rows[5][2], rows[5][3], 0)], "doc_id long, quality int, toxic int, text int")
    return docs, labels


def test_toxicity(spark):
    rows = corpus(random.Random(2))
    docs, labels = frames(spark, rows)
    got = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(got) == len(rows) + len(EDGES)
    by = {r.doc_id: r for r in got}
    wrong = sum(by[r[0]].predicted != r[3] for r in rows if by[r[0]].held_out)
    assert wrong <= 1 and sum(r.held_out for r in got) > 30
    assert by[9004].predicted == 1 and by[None].predicted == 1
    assert all(by[i].predicted == 0 for i in (9000, 9001, 9002, 9003, 9005))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    model = train_toxicity([(r[1], r[3]) for r in rows])
    likely = model.score(pa.array(["the gro.bn.ik er", "the g r o b n i k er", "on slurrfen an", "on the er an", None]))
    assert (likely[:3] > 0.5).all() and (likely[3:] < 0.5).all()


def test_toxicity_without_labels(spark):
    docs, labels = frames(spark, corpus(random.Random(3), 20))
    none = score_toxicity(docs, fit_toxicity(docs, labels.limit(0))).collect()
    assert {r.predicted for r in none} == {0}
    assert score_toxicity(docs.limit(0), fit_toxicity(docs, labels)).collect() == []


def lines(*words):
    out = np.zeros((len(words), WINDOW), np.uint16)
    for line, word in zip(out, words, strict=True):
        line[: len(word)] = [ord(c) for c in word]
    return out


def plain_triples(word):
    """The weight of each triple of a word, by the letters themselves."""
    marked, out = [_EDGE, *map(ord, word), _EDGE], Counter()
    scale = sum((len(marked) - j) * w * w for (_, j), w in zip(_STEPS, _WEIGHT, strict=True) if len(marked) > j) ** 0.5
    for (i, j), w in zip(_STEPS, _WEIGHT, strict=True):
        for at in range(len(marked) - j):
            out[marked[at], marked[at + i], marked[at + j]] += w / (scale or 1)
    return out


def plain_kernel(a, b):
    x, y = plain_triples(a), plain_triples(b)
    return sum(v * y[t] for t, v in x.items())


def test_kernel_against_plain_sums():
    words = ["abca", "e", "abcdefghijklmnop", "слово", "語文語", "ab"]
    used, got = features(lines(*words))
    place = {t: int(triple_place(*[np.array([c], np.uint32) for c in t])[0]) for w in words for t in plain_triples(w)}
    for line, word in zip(got, words, strict=True):
        want = Counter()
        for t, v in plain_triples(word).items():
            want[place[t]] += v
        assert {int(used[k]) for k in np.flatnonzero(line)} == set(want)
        assert all(line[np.searchsorted(used, k)] == pytest.approx(v, rel=1e-5) for k, v in want.items())
    some = ["abxca", "слоово", "nothing", "語文"]
    values = kernel_values(lines(*some), used, got)
    assert np.allclose(values, [[plain_kernel(a, b) for b in words] for a in some], atol=1e-5)


def test_folded_weights_are_the_machine_on_its_landmarks():
    model = train_toxicity([(r[1], r[3]) for r in corpus(random.Random(7), 120)], landmarks=64)
    own = ["".join(map(chr, line[line > 0])) for line in model.landmarks]
    assert len(own) > 40 and set(INSULTS) & set(own)
    words = [*own[:10], "grobnik", "grorbnik", "slrfen", "the", "zyxw"]
    want = [sum(c * plain_kernel(w, mark) for c, mark in zip(model.coefficients, own, strict=True)) + model.bias for w in words]
    assert np.allclose(model.word_margins(lines(*words)), want, atol=1e-3)
    # a text's margin, word by word
    margin = dict(zip(words, model.word_margins(lines(*words)), strict=True))
    got = model.margins(pa.array(["the grobnik the zyxw", "the zyxw", "", None, "slrfen, Grobnik!"]))
    assert got[0] == pytest.approx(max(margin["grobnik"], 0) + max(margin["the"], 0) + max(margin["zyxw"], 0)) and margin["grobnik"] > 0
    assert got[1] == pytest.approx(max(margin["the"], margin["zyxw"])) and got[2] == got[3] == -np.inf
    assert got[4] == pytest.approx(margin["grobnik"] + max(margin["slrfen"], 0))


def test_the_machine_has_the_least_loss_nearby():
    rng = np.random.default_rng(5)
    bags, of = np.c_[rng.normal(size=(40, 3)), np.ones(40)].astype(np.float32), np.repeat(np.arange(10), 4)
    clean, weight = np.c_[rng.normal(size=(60, 3)) - 1, np.ones(60)].astype(np.float32), rng.uniform(0.5, 2, 60)

    def loss(w):
        margin = bags @ w
        total = np.array([max(margin[of == t].max(), np.maximum(margin[of == t], 0).sum()) if margin[of == t].max() > 0 else margin[of == t].max() for t in range(10)])
        return w[:-1] @ w[:-1] + (np.maximum(0, 1 - total) ** 2).sum() + (weight * np.maximum(0, 1 + clean @ w) ** 2).sum()

    w = _machine(bags, of, clean, weight, 1.0)
    assert all(loss(w) <= loss(w + d) + 1e-4 for d in rng.normal(size=(200, 4)) * 0.05)


def test_letters():
    letters, s, e, row = letter_words(*text_bytes(pa.array(["Ab, C-d", None, "i d i o t! xx", "abcdeÉ" * 4 + "zzzzz", "Ёлка ΣΑΣ", "天地玄黃宇宙洪荒", "x\U0001f600y\U00020000z e\u0301"])))
    text = ["".join(map(chr, letters[a:b])) for a, b in zip(s, e, strict=True)]
    far = chr(0x8000)
    assert sorted(zip(row.tolist(), text, strict=True)) == sorted(
        [(0, "ab"), (0, "cd"), *((2, c) for c in "idiot"), (2, "idiot"), (2, "xx"), (3, ("abcdeé" * 4)[:16]), (3, ("abcdeé" * 4)[8:24]), (3, ("abcdeé" * 4)[16:] + "zz")]
        + [(4, "ёлка"), (4, "σασ"), (5, "天地玄黃宇宙"), (5, "黃宇宙洪荒"), (6, f"xy{far}z"), (6, "e")]
    )


SCRIPTS = {
    "cyrillic": ("он она мы при под над кра тле сон вет рук дом луч", ["гробник", "слюрфен"], "грообник"),
    "greek": ("και του στο προ μετ αλλ φως νερ δεν πως γρα λεξ", ["γρομπνικ", "σλυρφεν"], "γρομπτνικ"),
    "han": ("天 地 玄 黃 宇 宙 洪 荒 日 月 盈 昃 辰 宿", ["笨豬傻瓜", "醜陋混蛋"], "笨豬大傻瓜"),
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_insults_in_other_scripts(script):
    syllables, insults, edited = SCRIPTS[script]
    rng, rows = random.Random(6), []
    syllables = syllables.split()
    for i in range(240):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(25)]
        if i % 3 == 0:
            words[rng.randrange(25)] = rng.choice(insults)
        rows.append((("" if script == "han" else " ").join(words), int(i % 3 == 0)))
    model = train_toxicity(rows[60:])
    score = model.score(pa.array([r[0] for r in rows[:60]]))
    assert sum((s >= 0.5) != y for s, (_, y) in zip(score, rows, strict=False)) <= 1
    clean = rows[1][0]
    assert (model.score(pa.array([f"{clean} {edited}", clean])) >= 0.5).tolist() == [True, False]


def test_without_toxic_keeps_other_columns_nulls_and_repeats(spark):
    rows = corpus(random.Random(9), 150)
    model = train_toxicity([(r[1], r[3]) for r in rows])
    docs, _ = frames(spark, rows)
    got = without_toxic(docs, model)
    assert got.columns == docs.columns
    want = [i for i, _, _, toxic in rows if not toxic] + [9000, 9001, 9002, 9003, 9005, 9005]
    assert sorted(r.doc_id for r in got.collect()) == want
    assert without_toxic(docs.limit(0), model).collect() == []


def test_statistics_against_plain_counts():
    texts = ["The cat, the dog.\nthe cat, the dog.\n", None, "", "AB 12!! $$$\tx|y", "é ü \n\n a"]
    got = document_statistics(pa.array(texts))
    for line, t in zip(got, texts, strict=True):
        b = (t or "").encode()
        words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", b)]
        f = dict(zip(FEATURES, line, strict=True))
        assert f["log_bytes"] == pytest.approx(np.log1p(len(b))) and f["log_words"] == pytest.approx(np.log1p(len(words)))
        if b:
            assert f["distinct_words"] == pytest.approx(len(set(words)) / max(1, len(words)))
            assert f["share_upper"] == pytest.approx(sum(65 <= c <= 90 for c in b) / len(b))
            assert f["top_word"] == pytest.approx(max(Counter(words).values()) / len(words))
    assert got[0][FEATURES.index("distinct_lines")] == pytest.approx(0.5)


def test_trees_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    model = fit_trees(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    for row, margin in zip(x[:50], model.margin(x[:50]), strict=True):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            total += v[at - len(f)]
        assert total == pytest.approx(margin)
    assert fit_trees(x[:0], y[:0]).score(x[:2]) == pytest.approx(0.5)


def test_quality(spark):
    rows = corpus(random.Random(4))
    docs, labels = frames(spark, rows)
    got = score_quality(docs, fit_quality(docs, labels)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(EDGES)
    assert sum(by[r[0]].predicted != r[2] for r in rows if by[r[0]].held_out) <= 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len(score_quality(docs, fit_quality(docs, labels.limit(0))).collect()) == len(got)
    assert docs.where(held_out(docs.doc_id)).count() == sum(r.held_out for r in got)


def test_quality_scores_have_the_share_of_all_labelled_rows(spark):
    # texts that tell nothing, 20 good ones to a bad one, far more good ones than the sample takes
    words = F.concat_ws(" ", *[F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"-{k}"))), 1, 5) for k in range(8)])
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 21 == 0, 0).otherwise(1).alias("quality"))
    scores = [r.score for r in score_quality(docs, fit_quality(docs, labels)).where("held_out").collect()]
    assert np.mean(scores) == pytest.approx(20 / 21, abs=0.03)


def test_labels_that_teach_nothing_do_not_crowd_out_texts(spark):
    # label 1 on 200 texts, 8,000 null ones, 30 too long ones and 8,000 absent ones; label 0 on 200 texts, one of them twice
    text = F.when(F.col("id") < 400, F.concat(F.lit("text "), F.col("id"))).when(F.col("id") >= 8400, F.repeat(F.lit("word "), 20_000))
    docs = spark.range(8430).unionAll(spark.range(201, 202)).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = spark.range(16_430).select(F.col("id").alias("doc_id"), F.when(F.col("id").between(200, 399), 0).otherwise(1).alias("toxic"))
    rows = docs.where((F.col("doc_id") < 400) & ~held_out(F.col("doc_id"))).collect()
    want = sorted((r.text, int(r.doc_id < 200)) for r in rows)
    got, counts = labelled_sample(docs, labels, "toxic", 300)
    assert sorted(got) == want and counts == Counter(label for _, label in want)
