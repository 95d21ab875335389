import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm import language_id
from weftline.llm.language_id import ORDER, build_model, fit_language_id, identify_language, in_known_language
from weftline.llm.shingles import _LOWER, text_bytes


def plain_bits(texts: list[str], text: str) -> float:
    """The code length computed byte by byte."""
    counts: dict[bytes, dict[int, int]] = {}
    fold = lambda t: b"\n" * ORDER + t.encode().lower() if t.isascii() else b"\n" * ORDER + bytes(_LOWER[np.frombuffer(t.encode(), np.uint8)])
    for t in texts:
        b = fold(t)
        for i in range(ORDER, len(b)):
            for k in range(ORDER + 1):
                counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[b[i - k : i]][b[i]] += 1
    total, b = 0.0, fold(text)
    for i in range(ORDER, len(b)):
        for k in range(ORDER, -1, -1):
            seen = counts.get(b[i - k : i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if b[i] in seen:
                total -= math.log2(seen[b[i]] / whole)
                break
            total -= math.log2(len(seen) / whole)
        else:
            total += 8
    return total


EN = ["The cat sat on the mat and the dog ran.", "Then they went home, and that was all there is.", "a"]
DE = ["Der Hund lief über die Straße und der Mann ging.", "Nicht ein Wort über das Haus."]


def test_code_lengths_are_exact():
    model = build_model({"en": EN, "de": DE, "none": [""]})
    assert model.languages == ["de", "en"]
    texts = ["The man ran über the mat", "", "zzzz 12345 \u4e2d\u6587", "a", "The cat sat", "\n\n"]
    got = model.bits(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(got[i], [plain_bits(DE, t), plain_bits(EN, t)], rtol=1e-5)


def test_contract_and_edges(spark):
    rows = [(i, EN[i % 2] * 3, "en", "s", 1, 2) for i in range(40)] + [(100 + i, DE[i % 2] * 3, "de", "s", 1, 2) for i in range(40)]
    rows += [(500, None, "en", "s", 1, 2), (501, "", "de", None, 1, 2), (502, "123 !!", None, "s", 1, 2), (None, "the dog", None, "s", 1, 2), (503, "Der Hund " * 30_000, None, "s", 1, 2), (1, EN[0], "en", "s", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, bits int")
    got = identify_language(docs, fit_language_id(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (500, 501, 502)} == {"und"} and by[500].score == 0
    assert by[None].lang_pred == "en" and by[503].lang_pred == "de" and by[0].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)
    empty = docs.limit(0)
    assert identify_language(empty, fit_language_id(empty)).collect() == []
    assert identify_language(docs, fit_language_id(empty)).first().lang_pred == "und"


def test_rows_that_teach_nothing_do_not_crowd_out_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "build_model", lambda texts: {k: sorted(v) for k, v in texts.items()})
    text = F.when(F.col("id") < 200, F.concat(F.lit("Wort "), F.col("id"))).when(F.col("id") % 2 == 0, "").when(F.col("id") % 1000 == 1, F.repeat(F.lit("Wort "), 20_000))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("de").alias("lang"))
    assert fit_language_id(docs) == {"de": sorted(f"Wort {i}" for i in range(200))}


def test_documents_in_a_known_language_stay(spark):
    model = build_model({"en": EN * 5, "de": DE * 5})
    rows = [(1, "The dog and the cat sat there."), (2, "Der Mann und der Hund"), (2, "Der Mann und der Hund"), (3, None), (4, ""), (5, "123 !!"), (None, "the mat"), (6, "\u8a9e\u6587\u5b57" * 30), (7, "the dog " * 20_000)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = in_known_language(docs, model)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "2", "7", "None"]
    # bits a byte by the plain reckoning, for those that have a letter
    low = {r[0]: min(plain_bits(t * 5, r[1]) for t in (EN, DE)) / len(r[1].encode()) for r in rows if r[0] in (1, 2, 6)}
    assert {i for i, bits in low.items() if bits < 7.6} == {1, 2}
    assert in_known_language(docs.limit(0), model).collect() == [] == in_known_language(docs, build_model({})).collect()


def test_a_repeated_row_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "build_model", lambda texts: {k: len(v) for k, v in texts.items()})
    docs = spark.range(9000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("Wort").alias("text"), F.lit("de").alias("lang"))
    assert fit_language_id(docs, 9000)["de"] == 6008
