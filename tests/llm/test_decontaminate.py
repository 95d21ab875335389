import random

import numpy as np
import pyarrow as pa

from weftline.llm import decontaminate as D

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
COMMON = ["the", "of", "and", "to", "in"]


def text(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(WORDS) for _ in range(n))


def plain(item, words):
    best, h = 0, [0] * (len(words) + 1)
    for x in item:
        new = [0]
        for j, y in enumerate(words):
            new.append(max(0, h[j] + (D.MATCH if x == y else D.MISS), h[j + 1] - D.GAP, new[-1] - D.GAP))
        h = new
        best = max(best, *h)
    return best


def test_alignment_against_plain():
    rng = np.random.default_rng(0)
    item = rng.integers(0, 6, 12).astype(np.uint64)
    windows = rng.integers(0, 6, (40, 25)).astype(np.uint64)
    score, end = D.align(item, windows)
    for w, s, e in zip(windows, score, end, strict=True):
        assert s == plain(list(item), list(w)) == plain(list(item), list(w[:e]))


def build(rng):
    items = [(i, text(rng, rng.choice([18, 25, 40]))) for i in range(30)]
    rows, want = [], set()
    for d in range(240):
        words = text(rng, rng.choice([10, 80, 200])).split()
        if d % 4 == 0:
            i, t = rng.choice(items)
            copy = t.split()
            kind = d % 12
            if kind == 4:
                for k in range(5, len(copy), 6):
                    copy[k] = "Ööö"
            elif kind == 8:
                copy = [w.upper() + "," for w in copy if w != copy[len(copy) // 2]]
            at = rng.randrange(len(words))
            words[at:at] = copy
            want.add((d, i))
        rows.append((d, " ".join(words), "s", 1))
    return rows, items, want


def frames(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string, score int"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")


def test_copies_are_found_and_clean_texts_left(spark, monkeypatch):
    rows, items, want = build(random.Random(3))
    docs, bench = frames(spark, rows, items)
    got = D.contaminated_passages(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    by = {r[0]: r[1].split() for r in rows}
    for r in got:
        assert 0.5 <= r.score <= 1 and 0 <= r.first_word < r.end_word <= len(by[r.doc_id])
    assert {r.doc_id for r in D.without_contaminated(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in want}
    monkeypatch.setattr(D, "BENCHMARK_BYTES", 1500)
    assert {(r.doc_id, r.item_id) for r in D.contaminated_passages(docs, bench).collect()} == want


def test_every_pair_against_brute_force(spark):
    rng = random.Random(8)
    rows, items, _ = build(rng)
    rows, items = rows[:60], items[:12]
    docs, bench = frames(spark, rows, items)
    words = lambda t: D.normal_words(pa.array([t]))[0].tolist()
    want = {(d[0], i[0]) for d in rows for i in items if (p := plain(words(i[1]), words(d[1]))) >= 16 and p >= 0.5 * 2 * len(words(i[1]))}
    assert {(r.doc_id, r.item_id) for r in D.contaminated_passages(docs, bench).collect()} == want


def test_edges(spark):
    rng = random.Random(4)
    item = text(rng, 30)
    long = text(rng, 30_000) + " " + item
    rows = [(1, None, "s", 1), (2, "", "s", 1), (3, " \n", "s", 1), (None, item, "s", 1), (4, long, None, 1), (5, item, "s", 1), (5, item, "s", 1), (6, "!! ,,", "s", 1)]
    docs, bench = frames(spark, rows, [(1, item), (1, item), (2, None), (3, ""), (4, "the of and"), (None, text(rng, 20))])
    got = D.contaminated_passages(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == sorted([("None", 1), ("4", 1), ("5", 1), ("5", 1)] * 2)
    assert [r.end_word for r in got if r.doc_id == 4] == [30_030] * 2
    assert D.without_contaminated(docs, bench).count() == 4
    empty, none = docs.limit(0), bench.limit(0)
    assert D.contaminated_passages(empty, bench).collect() == [] == D.contaminated_passages(docs, none).collect()
    assert D.without_contaminated(docs, none).count() == len(rows)


def test_edited_copies_in_many_rows_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, text(rng, 40)) for i in range(5)]
    edited = []
    for (_, t), every in zip(items[:4], (4, 4, 5, 4), strict=True):
        edited.append([w if k % every < every - 1 else "Ööö" for k, w in enumerate(t.split())])
    edited.append(items[4][1].split()[:24])
    rows = []
    for d in range(1000):
        words = text(rng, 12).split()
        # 0.3 %, 1 %, 1 %, and a third of the rows, and one part of an item in 1 %
        for i, here in enumerate((d % 333 == 5, d % 100 == 7, d % 100 == 8, d % 3 == 0, d % 100 == 9)):
            if here:
                words[6:6] = edited[i]
        rows.append((d, " ".join(words), "s", 1))
    docs, bench = frames(spark, rows, items)
    words = lambda t: D.normal_words(pa.array([t]))[0].tolist()
    want = {(d[0], i[0]): p / 80 for d in rows for i in items if (p := plain(words(i[1]), words(d[1]))) >= 40}
    assert {i: sum(k[1] == i for k in want) for i in range(5)} == {0: 3, 1: 10, 2: 10, 3: 334, 4: 10}
    assert {(r.doc_id, r.item_id): r.score for r in D.contaminated_passages(docs, bench).collect()} == want
    assert {r.doc_id for r in D.without_contaminated(docs, bench).collect()} == set(range(1000)) - {d for d, _ in want}


def test_edits_that_leave_no_three_words_together(spark):
    rng = random.Random(12)
    items = [(i, text(rng, n)) for i, n in enumerate((8, 16, 30, 60, 60))]
    words = lambda t: D.normal_words(pa.array([t]))[0].tolist()
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    few = []
    for d in range(60):
        i, t = items[d % 5]
        t = t.split()
        if d % 4 == 0:
            t = [w if k % 3 else f"Ö{k}" for k, w in enumerate(t)]
        elif d % 4 == 1:
            t = [x for w in t for x in (w, "und")][: -1 - rng.randrange(4)]
        elif d % 4 == 2:
            t = [x for k, w in enumerate(t) for x in ((w, "und") if k % 2 else (w,))]
        else:
            t = [w for w in t if rng.random() > 0.25]
        around = text(rng, 20).split()
        around[7:7] = t
        few.append((d, " ".join(around), "s", 1))
    few.append((999, " ".join(w if k % 3 else "x" for k, w in enumerate(items[3][1].split() * 40)), "s", 1))
    want, unseeded = {}, 0
    for r in few:
        for i, t in items:
            if (p := plain(words(t), words(r[1]))) >= max(16, len(words(t))):
                want[r[0], i] = p / 2 / len(words(t))
                unseeded += not grams(words(t)) & grams(words(r[1]))
    assert len(want) > 30 and unseeded > 10
    many = few + [(10_000 + k, f"{t} {k}", "s", 1) for k, (_, t, _, _) in enumerate(rng.choices(few[:5], k=200))] + [(20_000 + k, text(rng, 3), "s", 1) for k in range(9000)]
    for rows in (few, many):
        docs, bench = frames(spark, rows, items)
        got = {(r.doc_id, r.item_id): r.score for r in D.contaminated_passages(docs, bench).collect() if r.doc_id < 1000}
        assert got == want


def test_long_texts_in_pieces_and_wide_windows(monkeypatch):
    rng = random.Random(13)
    rows = [text(rng, 25).split() for _ in range(3)]
    monkeypatch.setattr(D, "PIECE_WORDS", 400)
    bench = D.Benchmark([type("Row", (), {"item_id": i, "text": " ".join(t)}) for i, t in enumerate(rows)], 0.5)
    long = [rng.choice(WORDS) for _ in range(5000)]
    for at in (0, 380, 395, 2000, 4990):
        long[at:at] = rows[0]
    texts = [" ".join(long), "", " ".join(rows[1] * 60), " ".join(rows[2][:12])]
    got = D._matches(bench, pa.array(texts))
    assert [(r, i, s) for r, i, s, _, _ in got] == [(0, 0, 1.0), (2, 1, 1.0)]
    assert [(a, b) for *_, a, b in got] == [(0, 25), (0, 25)]
