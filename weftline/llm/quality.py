"""Quality scores by histogram gradient-boosted trees over document statistics.

Statistics of a batch are taken on its bytes at once; the trees have one depth,
so they lie flat in three arrays and a batch walks all rows through a level of a
tree at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, with_columns
from .labels import labelled_sample
from .shingles import shingle_hashes, span_hashes, text_bytes, word_spans

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": (32,),
    "line": (10,),
    "stop": (46,),
    "comma": (44,),
    "bang": (33, 63),
    "bar": (124,),
    "sign": (35, 36, 37, 38, 42, 64, 94, 126),
    "mark": (34, 39, 40, 41, 45, 58, 59, 91, 93, 95, 123, 125),
    "code": (47, 60, 61, 62, 92, 96, 43),
    "high": range(128, 256),
    "control": [*range(9), *range(11, 32), 127],
}
FEATURES = [
    "log_bytes",
    "log_words",
    "word_length",
    "word_length_spread",
    *(f"share_{c}" for c in _CLASSES),
    "distinct_words",
    "distinct_grams",
    "distinct_lines",
    "log_lines",
    "line_length",
    "long_words",
    "short_words",
    "signed_words",
    "top_word",
]


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how many distinct keys it has, and how often its commonest comes."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    begins = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.empty(0, int)
    most = np.zeros(rows)
    np.maximum.at(most, r[begins], np.diff(np.r_[begins, len(k)]))
    return np.bincount(r[begins], minlength=rows), most


def document_statistics(column: pa.Array) -> np.ndarray:
    """[row, feature]: FEATURES of each text; null counts as empty, whose statistics are 0."""
    raw, offs = text_bytes(column)
    rows, sizes = len(offs) - 1, np.diff(offs)
    row = np.repeat(np.arange(rows), sizes)
    by_byte = np.bincount(row * 256 + raw, minlength=rows * 256).reshape(rows, 256)
    bytes_ = np.maximum(1, sizes)
    starts, ends, first = word_spans(raw, offs)
    words = np.diff(first)
    w = np.maximum(1, words)
    lengths, word_row = (ends - starts).astype(float), np.repeat(np.arange(rows), words)
    sums = lambda x: np.bincount(word_row, x, rows)
    mean = sums(lengths) / w
    hashes = span_hashes(raw, starts, ends)
    grams, gram_at = shingle_hashes(hashes, first, 3)
    gram_row = np.repeat(np.arange(rows), np.diff(gram_at))
    kinds, most = _distinct(hashes, word_row, rows)
    gram_kinds, _ = _distinct(grams, gram_row, rows)
    cuts = np.unique(np.r_[offs, np.flatnonzero(raw == 10) + 1])
    line_starts, line_ends = cuts[:-1], cuts[1:]
    line_row = np.searchsorted(offs, line_starts, "right") - 1
    lines = np.maximum(1, np.bincount(line_row, minlength=rows))
    line_kinds, _ = _distinct(span_hashes(raw, line_starts, line_ends), line_row, rows)
    sign = np.zeros(256, bool)
    sign[list(_CLASSES["sign"]) + list(_CLASSES["bang"])] = True
    last = raw[np.maximum(0, ends - 1)] if len(raw) else np.empty(0, np.uint8)
    columns = [
        np.log1p(sizes),
        np.log1p(words),
        mean,
        np.sqrt(np.maximum(0, sums(lengths**2) / w - mean**2)),
        *(by_byte[:, list(c)].sum(axis=1) / bytes_ for c in _CLASSES.values()),
        kinds / w,
        gram_kinds / np.maximum(1, np.diff(gram_at)),
        line_kinds / lines,
        np.log1p(np.where(sizes > 0, lines, 0)),
        sizes / lines,
        sums(lengths > 15) / w,
        sums(lengths < 3) / w,
        sums(sign[last]) / w,
        most / w,
    ]
    out = np.stack(columns, axis=1)
    out[sizes == 0] = 0
    return out


@dataclass
class BoostedTrees:
    """Trees of one depth: node i of a tree has children 2i + 1 and 2i + 2; value holds the leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), int)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, ridge: float = 1.0, least: int = 8) -> BoostedTrees:
    """Boosting on the logistic loss; splits are sought on histograms of at most so many bins a feature.

    Without rows, or with one label only, the score is that label's share,
    smoothed by one row of each, and there are no trees.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if len(np.unique(y)) < 2:
        return BoostedTrees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    n, width = x.shape
    flat = binned + bins * np.arange(width)
    margin = np.full(n, base)
    feature, threshold, value = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        f, t, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(n, int)
        for level in range(depth):
            low, nodes = 2**level - 1, 2**level
            cell = ((at - low)[:, None] * (width * bins) + flat).ravel()
            g, h, c = (np.bincount(cell, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for v in (grad, hess, np.ones(n)))
            all_g, all_h, all_c = g[..., -1:], h[..., -1:], c[..., -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(c < least) | (all_c - c < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                if gain[k].ravel()[best[k]] > 1e-9:
                    j, b = divmod(int(best[k]), bins)
                    f[low + k], t[low + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > t[at])
        leaf = at - inner
        v = rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + ridge)
        margin += v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return BoostedTrees(base, np.array(feature), np.array(threshold), np.array(value))


def fit_quality(docs: DataFrame, labels: DataFrame) -> BoostedTrees:
    """Trees that tell quality 1 from 0, from the bounded sample that labelled_texts gives.

    The sample may hold the labels in other shares than the data, so the base is
    shifted to the odds of all labelled rows, smoothed by one row of each label.
    """
    rows, counts = labelled_sample(docs, labels, "quality")
    y = np.array([r[1] > 0 for r in rows], float)
    x = document_statistics(pa.array([r[0] for r in rows], pa.large_string())) if rows else np.zeros((0, len(FEATURES)))
    model = fit_trees(x, y)
    good = sum(n for label, n in counts.items() if label > 0)
    bad = sum(counts.values()) - good
    model.base += float(np.log((good + 1.0) / (bad + 1.0)) - np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0)))
    return model


def score_quality(docs: DataFrame, model: BoostedTrees, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, ...).

    score is the probability of label 1; predicted is 1 from threshold on.  A
    null, empty or blank text has its score too, that of its statistics, which
    are 0 for an empty one.  Whole texts count, however long.  Repeated rows and
    null ids stay rows; no rows in: none out.  Other columns are ignored.
    """
    rows = with_columns(docs, ["doc_id", "text"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = sent.value.score(document_statistics(batch.column(2)))
        return pa.record_batch({"doc_id": batch.column(0), "held_out": batch.column(1), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return map_batches(rows, one, "doc_id long, held_out boolean, score double, predicted int")
