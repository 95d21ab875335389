import random
import re

from weftline.llm import ngram_join
from weftline.llm.ngram_join import drop_near_duplicates, ngram_jaccard_components

SCHEMA = "doc_id long, text string, key string, n long, part int"


def brute(rows, n=5, share=75):
    sets = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0]))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_components(frame).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, line = [], " ".join(rng.choice(words) for _ in range(50))
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 120]))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(rng.randrange(4)):
            copy = list(text)
            for _ in range(rng.randrange(1 + len(copy) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
        if i % 3 == 0:
            rows.append((len(rows), " ".join(text[:12]) + " " + line))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"), (None, "one two"), (903, "One two"), (905, "É é"), (906, "é é")]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_chain_and_large_group(spark):
    rng = random.Random(6)
    base = [f"a{i}" for i in range(200)]
    rows = []
    for i in range(120):
        copy = list(base)
        copy[rng.randrange(200)] = f"b{i}"
        copy[rng.randrange(200)] = f"c{i}"
        rows.append((1000 - i, " ".join(copy)))
    step = list(base)
    for i in range(25):
        step = step[:]
        step[i * 8] = f"z{i}"
        rows.append((2000 - i, " ".join(step)))
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == []
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    assert run(spark, [(2, long), (1, long + " end")]) == brute([(2, long), (1, long + " end")])


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(40):
        text = [rng.choice(words) for _ in range(40)]
        for _ in range(rng.randrange(1, 4)):
            text = [*text[:5], rng.choice(words), *text[6:]]
            rows.append((len(rows), " ".join(text)))
    plain = [(*r, "x", 1, 2) for r in rows]
    stay = {c for _, _, c in brute(rows)}
    assert sorted(r.doc_id for r in drop_near_duplicates(spark.createDataFrame(plain, SCHEMA)).collect()) == sorted(stay)
    odd = [(0, rows[0][1]), (None, "only here " * 3), (None, "only here " * 3), (None, rows[5][1]), (700, None), (700, ""), (701, "a b c d e f"), (701, "a b c d e f"), (701, "g h i j k l")]
    got = drop_near_duplicates(spark.createDataFrame([*plain, *[(*r, "x", 1, 2) for r in odd]], SCHEMA)).collect()
    want = [*sorted(stay), None, 700, 700, 701, 701]
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, want)) and got[0].part == 2
    assert drop_near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shingles_that_many_sets_hold(spark, monkeypatch):
    # a passage in every row, near copies among them, in fragments so small that the passage would fill a few of them
    rng = random.Random(10)
    words, passage = [f"w{i}" for i in range(2000)], " ".join(f"p{i}" for i in range(12))
    rows = []
    for i in range(700):
        text = [rng.choice(words) for _ in range(40)]
        rows.append((len(rows), f"{' '.join(text)} {passage}"))
        if i % 10 == 0:
            text[rng.randrange(40)] = "other"
            rows.append((len(rows), f"{' '.join(text)} {passage}"))
    rows += [(len(rows), passage), (len(rows) + 1, passage + " more"), (len(rows) + 2, passage)]
    want = brute(rows)
    assert run(spark, rows) == want
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    loads = {}
    for r in ngram_join._postings(frame, 5, 64).collect():
        loads[r.part] = loads.get(r.part, 0) + len(r.blob)
    assert len(loads) == 64 and max(loads.values()) <= 2 * sorted(loads.values())[32]
    monkeypatch.setattr(ngram_join, "POSTINGS_PER_FRAGMENT", 500)
    monkeypatch.setattr(ngram_join, "COMMON_SETS", 3)
    assert run(spark, rows) == want
