"""Toxicity by a support vector machine on a gapped subsequence kernel, with Nystroem landmarks.

The kernel of two words sums, over the letter triples that both hold in order,
the products of decay ** span of their occurrences, so a word with letters put
in or left out keeps most of its likeness.  The machine is learned from
labelled texts, as bags of words: a clean text says that none of its words is
an insult, a toxic one that some are, not which.  It is linear in the
landmarks' kernel values; as those are inner products of explicit triple
weights, it folds into one weight a triple, and scoring a word adds up the
weights of its triples.  A text's margin is the sum of its words' margins above
0, or its worst word's if there is none.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, held_out, keep_rows, map_batches, with_columns
from .labels import labelled_texts
from .shingles import span_hashes, text_bytes, word_spans

DECAY, SPAN = 0.7, 6
#: Letters that one window of a word has at most, and one in a script without spaces; longer words are read in windows that overlap by half.
WINDOW, DENSE_WINDOW = 16, 6
#: Rows of each label that the machine learns from, about.
SAMPLE_ROWS = 2000
#: Words that stand for a text in training, those of highest margin; clean words beside them: the commonest, some at random, and those that were ever among the highest of a clean text.
WORDS_PER_TEXT, COMMON_WORDS, RANDOM_WORDS, HARD_WORDS = 4, 2000, 3000, 9000
#: Bits of a triple's place in the table of weights.
TABLE_BITS = 20
_EDGE = 1
_STEPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_WEIGHT = np.array([DECAY ** (j + 1) for _, j in _STEPS])

# The letter that a digit or sign stands for, and code points of scripts that are written without spaces.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_DENSE = [(0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xAC00)]


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """For each code point under 2 ** 16 the letter that it counts as, without case (0: none), and whether its script has no spaces."""
    letter, dense = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, bool)
    for point in [*range(0xD800), *range(0xE000, 1 << 16)]:
        kind = unicodedata.category(chr(point))
        if kind[0] == "L" or (kind in ("Mc", "Mn") and not 0x300 <= point < 0x370):
            small = ord(chr(point).lower()[0])
            letter[point] = small if small < 1 << 16 else point
    for sign, stands in _STANDS_FOR.items():
        letter[ord(sign)] = ord(stands)
    for low, high in _DENSE:
        dense[low:high] = True
    return letter, dense


def letters_of(raw: np.ndarray) -> np.ndarray:
    """The letter that begins at each byte of UTF-8, 0 where none does; those beyond 2 ** 16 share the upper half of the codes."""
    table = _alphabet()[0]
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    point = raw[at].astype(np.uint32)
    wide = np.flatnonzero(point >= 0xC0)
    if len(wide):
        more = np.concatenate([raw, np.zeros(3, np.uint8)])
        one, two, three = ((more[at[wide] + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3))
        lead = point[wide]
        point[wide] = np.where(lead < 0xE0, (lead & 0x1F) << 6 | one, np.where(lead < 0xF0, (lead & 0x0F) << 12 | one << 6 | two, (lead & 0x07) << 18 | one << 12 | two << 6 | three))
    found = table[np.minimum(point, 0xFFFF)]
    far = point >= 1 << 16
    found[far] = np.where(point[far] >= 0x20000, (point[far] & 0x7FFF) | 0x8000, 0)
    out = np.zeros(len(raw), np.uint16)
    out[at] = found
    return out


def letter_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all texts end to end; start, end and row of each word in them.

    Letters spelt one by one (three words or more of one letter) are one word
    besides, a letter more than twice in a row counts twice, and a word above
    WINDOW letters (DENSE_WINDOW in a script without spaces) is its windows.
    """
    symbols = letters_of(raw)
    kept = symbols > 0
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(kept, out=count[1:])
    letters = symbols[kept]
    starts, ends, first = word_spans(raw, offs)
    if len(letters) > 2:
        begins = np.zeros(len(letters) + 1, bool)
        begins[count[starts]] = True
        again = np.zeros(len(letters), bool)
        again[2:] = (letters[2:] == letters[1:-1]) & (letters[2:] == letters[:-2]) & ~begins[1:-2] & ~begins[2:-1]
        if again.any():
            kept[np.flatnonzero(kept)[again]] = False
            np.cumsum(kept, out=count[1:])
            letters = symbols[kept]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    s, e = count[starts], count[ends]
    some = e > s
    s, e, row = s[some], e[some], row[some]
    one = (e - s) == 1
    same = np.r_[False, row[1:] == row[:-1]] if len(row) else np.empty(0, bool)
    begin = one & ~(np.r_[False, one[:-1]] & same) if len(one) else one
    runs = np.flatnonzero(begin)
    if len(runs):
        group = np.cumsum(begin)[one] - 1
        length = np.bincount(group, minlength=len(runs))
        long = runs[length >= 3]
        s, e, row = np.r_[s, s[long]], np.r_[e, s[long] + length[length >= 3]], np.r_[row, row[long]]
    size = e - s
    most = np.where(_alphabet()[1][letters[s]], DENSE_WINDOW, WINDOW) if len(s) else s
    wide = np.flatnonzero(size > most)
    if len(wide):
        half = most[wide] // 2
        parts = -(-(size[wide] - most[wide]) // half) + 1
        own = np.repeat(wide, parts)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        more = s[own] + np.repeat(half, parts) * step
        rest = size <= most
        s, e, row = np.r_[s[rest], more], np.r_[e[rest], np.minimum(more + most[own], e[own])], np.r_[row[rest], row[own]]
    order = np.argsort(s, kind="stable")
    return letters, s[order], e[order], row[order]


def _as_words(letters: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The spans, one a line, 0 behind the last letter."""
    n = e - s
    out = np.zeros((len(s), WINDOW), np.uint16)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(s)), n), inner] = letters[np.repeat(s, n) + inner]
    return out


def _distinct(letters: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and for every word which of those it is."""
    _, one, back = np.unique(span_hashes(letters.view(np.uint8), 2 * s, 2 * e, fold=False), return_index=True, return_inverse=True)
    return one, back


def _grid(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words between edge marks; and their lengths with the marks."""
    grid = np.zeros((len(words), WINDOW + 2), np.uint32)
    grid[:, 0] = _EDGE
    grid[:, 1:-1] = words
    n = (words > 0).sum(axis=1)
    grid[np.arange(len(words)), n + 1] = _EDGE
    return grid, n + 2


def _norms() -> np.ndarray:
    """For each length, the root of the summed squares of its triples' weights: a scale that makes kernels comparable."""
    out = np.ones(WINDOW + 3)
    for n in range(3, WINDOW + 3):
        out[n] = np.sqrt(sum((n - j) * w * w for (_, j), w in zip(_STEPS, _WEIGHT, strict=True) if n > j))
    return out


_NORM = _norms()


def triple_place(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of each letter triple in the table of weights: a hash, so that any letters of any script have one."""
    with np.errstate(over="ignore"):
        x = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ ((c + np.uint32(0x165667B1)) * np.uint32(0xC2B2AE3D))
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return x >> np.uint32(32 - TABLE_BITS)


def _triples(grid: np.ndarray, length: np.ndarray):
    """Yields (weight, lines, triple) for each way to step over a word, at each place where it fits."""
    for (i, j), weight in zip(_STEPS, _WEIGHT, strict=True):
        width = grid.shape[1] - j
        yield weight, np.arange(width) < (length - j)[:, None], triple_place(grid[:, :width], grid[:, i : i + width], grid[:, j : j + width])


def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The triples that the words hold, sorted, and the explicit weights [word, triple], for words few enough."""
    grid, length = _grid(words)
    lines, triples, weights = [], [], []
    for weight, fits, triple in _triples(grid, length):
        line = np.broadcast_to(np.arange(len(grid))[:, None], fits.shape)[fits]
        lines.append(line)
        triples.append(triple[fits])
        weights.append(weight / _NORM[length][line])
    used, column = np.unique(np.concatenate(triples), return_inverse=True)
    out = np.zeros((len(grid), len(used)), np.float32)
    np.add.at(out, (np.concatenate(lines), column), np.concatenate(weights).astype(np.float32))
    return used, out


def kernel_values(words: np.ndarray, used: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernels [word, landmark] of words with landmarks, given as what features says of them."""
    column = np.full(1 << TABLE_BITS, len(used), np.int32)
    column[used] = np.arange(len(used))
    by_triple = np.concatenate([landmarks.T, np.zeros((1, len(landmarks)), np.float32)])
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for at in range(0, len(words), 512):
        grid, length = _grid(words[at : at + 512])
        for weight, fits, triple in _triples(grid, length):
            for place in np.flatnonzero(fits.any(axis=0)):
                line = np.flatnonzero(fits[:, place])
                out[at + line] += np.float32(weight) * by_triple[column[triple[line, place]]]
        out[at : at + 512] /= _NORM[length][:, None]
    return out


def word_sums(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word, its triples' weights summed as the kernel weighs them."""
    out = np.empty(len(words))
    for at in range(0, len(words), 1 << 14):
        grid, length = _grid(words[at : at + (1 << 14)])
        total = np.zeros(len(grid))
        for weight, fits, triple in _triples(grid, length):
            total += weight * np.where(fits, weights[triple], 0).sum(axis=1)
        out[at : at + (1 << 14)] = total / _NORM[length]
    return out


@dataclass
class ToxicityModel:
    """The machine: landmarks with a coefficient each, the same folded into weights of triples, a bias, and the scale of scores."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    landmarks: np.ndarray
    coefficients: np.ndarray

    def word_margins(self, words: np.ndarray) -> np.ndarray:
        return word_sums(words, self.weights) + self.bias

    def margins(self, column: pa.Array) -> np.ndarray:
        """Each text's margin; -inf for a text without a letter."""
        raw, offs = text_bytes(column)
        letters, s, e, row = letter_words(raw, offs)
        if not len(s):
            return np.full(len(offs) - 1, -np.inf)
        one, back = _distinct(letters, s, e)
        pairs = np.sort(row * len(one) + back)
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        return _pooled(self.word_margins(_as_words(letters, s[one], e[one]))[pairs % len(one)], pairs // len(one), len(offs) - 1)

    def score(self, column: pa.Array) -> np.ndarray:
        margin = np.clip(self.margins(column), -20.0, 20.0)
        return 1.0 / (1.0 + np.exp(-(self.slope * margin + self.offset)))


def _pooled(margin: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The margin of each text from those of its distinct words."""
    best = np.full(rows, -np.inf)
    np.maximum.at(best, row, margin)
    return np.where(best > 0, np.bincount(row, np.maximum(margin, 0), rows), best)


class _Texts:
    """Which words each text holds: the distinct words, and for each text their places."""

    def __init__(self, texts: list[str]):
        words, row, word, seen = [np.empty((0, WINDOW), np.uint16)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for at in range(0, len(texts), 500):
            letters, s, e, own = letter_words(*text_bytes(pa.array(texts[at : at + 500], pa.large_string())))
            if not len(s):
                continue
            one, back = _distinct(letters, s, e)
            pairs = np.unique(own * len(one) + back)
            words.append(_as_words(letters, s[one], e[one]))
            row.append(at + pairs // len(one))
            word.append(seen + pairs % len(one))
            seen += len(one)
        every = np.ascontiguousarray(np.concatenate(words))
        _, one, place = np.unique(every.view(f"V{2 * WINDOW}").reshape(-1), return_index=True, return_inverse=True)
        self.n, self.words, self.row, self.word = len(texts), every[one], np.concatenate(row), place[np.concatenate(word)]
        self.first = np.searchsorted(self.row, np.arange(len(texts) + 1))

    def counts(self, texts: np.ndarray) -> np.ndarray:
        """In how many of the texts (a mask) each word is."""
        return np.bincount(self.word[texts[self.row]], minlength=len(self.words))

    def highest(self, margin: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of each text's words of highest margin."""
        order = np.lexsort((-margin[self.word], self.row))
        kept = np.arange(len(order)) - self.first[self.row] < most
        return self.row[order][kept], self.word[order][kept]


def _triple_counts(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The weights of all triples in the words, each word so many times."""
    out = np.zeros(1 << TABLE_BITS)
    there = np.flatnonzero(times)
    for at in range(0, len(there), 1 << 14):
        some = there[at : at + (1 << 14)]
        grid, length = _grid(words[some])
        each = np.broadcast_to((times[some] / _NORM[length])[:, None], (len(some), grid.shape[1]))
        for weight, fits, triple in _triples(grid, length):
            out += np.bincount(triple[fits], weight * each[:, : fits.shape[1]][fits], 1 << TABLE_BITS)
    return out


def _witness(texts: _Texts, bad: np.ndarray) -> np.ndarray:
    """A first margin of each word: how much oftener its triples are in toxic texts than in clean ones, as a sum of log odds."""
    toxic, clean = (_triple_counts(texts.words, texts.counts(of)) for of in (bad, ~bad))
    return word_sums(texts.words, np.log((toxic + 2.0) / (clean * bad.sum() / (~bad).sum() + 2.0)))


def _machine(bags: np.ndarray, of: np.ndarray, clean: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """The linear machine of least squared hinge: words `bags` of toxic texts `of` (0, 1, ...) sum up to 1 above 0, clean words stay at -1.

    The words of a toxic text that count are those above 0, or its best one.
    Given those the problem is convex; it is solved, and they are chosen anew,
    until they stay the same, each turn lowering the loss.
    """
    texts, width = int(of.max()) + 1, bags.shape[1]
    ridge = np.eye(width)
    ridge[-1, -1] = 1e-6
    counts = np.r_[True, of[1:] != of[:-1]]
    below, above = np.ones(texts, bool), np.ones(len(clean), bool)
    for _ in range(6):
        summed = np.zeros((texts, width), np.float32)
        np.add.at(summed, of[counts], bags[counts])
        for _ in range(12):
            heavy = clean[above] * weight[above, None].astype(np.float32)
            left = ridge + cost * (summed[below].T.astype(float) @ summed[below] + heavy.T.astype(float) @ clean[above])
            w = np.linalg.solve(left, cost * (summed[below].sum(axis=0, dtype=float) - heavy.sum(axis=0, dtype=float)))
            now = summed @ w < 1, clean @ w > -1
            done = (now[0] == below).all() and (now[1] == above).all()
            below, above = now
            if done:
                break
        margin = bags @ w
        best = np.full(texts, -np.inf)
        np.maximum.at(best, of, margin)
        chosen = (margin > 0) | ((best <= 0)[of] & (margin == best[of]))
        if (chosen == counts).all():
            break
        counts = chosen
    return w


def train_toxicity(rows: list[tuple[str, int]], landmarks: int = 384, rounds: int = 2, cost: float = 1.0, seed: int = 3) -> ToxicityModel:
    """The machine learned from labelled texts.

    Landmarks are words: half of them those that stand for most toxic texts,
    half clean ones.  Each round takes the WORDS_PER_TEXT words of highest margin
    for each text, the first time by the triples' odds in toxic and clean texts,
    and trains on them, with common and random clean words beside.  All texts
    given count, and every word of them is scored in every round.  Without both
    labels the score is the share of label 1 whatever the text.
    """
    rows = sorted(set(rows))
    bad = np.array([bool(r[1]) for r in rows])
    texts = _Texts([r[0] for r in rows])
    if len(np.unique(bad)) < 2 or not texts.counts(bad).any() or not texts.counts(~bad).any():
        share = (bad.sum() + 1.0) / (len(bad) + 2.0) if len(bad) and bad.all() else 0.0
        return ToxicityModel(np.zeros(1 << TABLE_BITS, np.float32), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.empty((0, WINDOW), np.uint16), np.empty(0))
    rng = np.random.default_rng(seed)
    clean = texts.counts(~bad)
    seen = np.flatnonzero(clean)
    plain = np.unique(np.r_[rng.permutation(seen)[:RANDOM_WORDS], seen[np.argsort(-clean[seen], kind="stable")[:COMMON_WORDS]]])
    hard = np.empty(0, np.int64)
    margin = _witness(texts, bad)
    for _ in range(rounds):
        of, word = texts.highest(margin, WORDS_PER_TEXT)
        mine, hers = bad[of], ~bad[of]
        hard = np.union1d(hard, word[hers])
        hard = np.sort(hard[np.argsort(-margin[hard], kind="stable")[:HARD_WORDS]])
        some, times = np.unique(word[mine], return_counts=True)
        chosen = np.unique(np.r_[some[np.argsort(-times, kind="stable")[: landmarks // 2]], rng.permutation(hard)[: landmarks // 4], rng.permutation(plain)[: landmarks // 4]])
        used, phi = features(texts.words[chosen])
        values, vectors = np.linalg.eigh((phi @ phi.T).astype(float))
        good = values > 1e-5 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        against = np.union1d(hard, plain)
        both = np.union1d(some, against)
        z = np.c_[kernel_values(texts.words[both], used, phi) @ root.astype(np.float32), np.ones(len(both), np.float32)]
        _, bag = np.unique(of[mine], return_inverse=True)
        weight = bad.sum() / 5000 * np.sqrt(clean[against])
        w = _machine(z[np.searchsorted(both, word[mine])], bag, z[np.searchsorted(both, against)], weight, cost)
        coefficients = root @ w[:-1]
        weights = np.zeros(1 << TABLE_BITS, np.float32)
        weights[used] = coefficients @ phi
        model = ToxicityModel(weights, float(w[-1]), 6.0, 0.0, texts.words[chosen], coefficients)
        margin = model.word_margins(texts.words)
    # The score is one half where the fewest texts are wrong, a clean one counted four times: in the middle of that range.
    whole = _pooled(margin[texts.word], texts.row, texts.n)
    tries = np.linspace(-1.0, 1.5, 251)
    wrong = np.array([(whole[bad] < t).sum() + 4 * (whole[~bad] >= t).sum() * bad.sum() / (~bad).sum() for t in tries])
    model.offset = float(-model.slope * tries[wrong == wrong.min()].mean())
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """The machine trained on the bounded sample that labelled_texts gives."""
    model = train_toxicity(labelled_texts(docs, labels, "toxic", SAMPLE_ROWS))
    give_back()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, ...).

    score is the calibrated probability of label 1, predicted is 1 from
    threshold on.  Every word of the whole text counts.  A text that is null,
    empty or without a letter has the lowest score.  Repeated rows and null ids
    stay rows; no rows in: none out.  Other columns are ignored.
    """
    rows = with_columns(docs, ["doc_id", "text"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = sent.value.score(batch.column(2))
        return pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return map_batches(rows, one, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score_toxicity is under threshold.

    Null, empty and letterless texts have the lowest score and stay; repeated
    rows and null ids stay or go as their texts do; no rows in: none out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, ["text"], lambda batch: sent.value.score(batch.column(0)) < threshold)
