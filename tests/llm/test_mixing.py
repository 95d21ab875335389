import random
import re

import pytest

from weftline.llm.mixing import mix_sources

SCHEMA = "doc_id long, text string, source string, size long, target int, key string"


def targets(sizes, weights=(1, 2, 3), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        for s in above:
            out[s] = epochs * sizes[s]
            left -= out[s]
        open_ -= above
    return out


def run(spark, rows):
    return mix_sources(spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA)).collect()


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.source or "~") for r in got) == sorted((d is None, d or 0, size(t), s or "~") for d, t, s in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1.001


def test_targets_and_cut(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("x" * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 5, 50, 400]))), rng.choice(["a", "b", "b", "b", "B", "é", None, "tiny"])) for i in range(400)]
    rows = [r for r in rows if r[2] != "tiny"] + [(9000, "one", "tiny"), (9001, None, "tiny"), (9002, " \t", "null only"), (None, "a b", "a"), (7, rows[0][1], "a"), (7, rows[0][1], "a")]
    got = run(spark, rows)
    check(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, run(spark, rows[::-1])))


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("weftline.llm.mixing.ROWS_PER_RANGE", 16)
    rows = [(i, "w " * (i % 23), "hot" if i % 3 else f"s{i % 7}") for i in range(900)]
    check(rows, run(spark, rows))


def test_empty(spark):
    assert run(spark, []) == []
    check([(1, None, "a")], run(spark, [(1, None, "a")]))
