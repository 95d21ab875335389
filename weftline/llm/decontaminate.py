"""Benchmark decontamination: rare n-grams seed pairs of passage and item, Smith-Waterman alignment scores them.

The seeds lose no pair.  An alignment worth T points has M matches and E edits
with 2 M - E >= T.  Either SEED of its matches follow one another, which the
word n-grams of the item find; or each SEED - 1 matches cost an edit, so that
M >= (T - 1) / (2 - 1 / (SEED - 1)): so many of the item's words are there that
its rarest ones, however they are chosen, must be among them in some number.
Rarity is an order of the item's own words, by how many items hold them, and
no word or n-gram is left out for being common.  Pairs that share common words
only are told before the alignment, by bounds that none of theirs can exceed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_batches, stage, with_columns
from .shingles import mix, shingle_hashes, span_hashes, text_bytes, word_spans

#: Words of a seed; alignment scores; the words that an alignment must at least be worth.
SEED, MATCH, MISS, GAP, LEAST_WORDS = 3, 2, -1, 1, 8
#: Bytes of benchmark text that are held by each task at a time; a larger benchmark is done in so many parts.
BENCHMARK_BYTES = 4 << 20
#: Words of the windows that are taken in one step, about, and words of a text that are sought at a time.
GRID_WORDS, PIECE_WORDS = 1 << 18, 1 << 18
_PAIR = np.uint64(0x9E3779B97F4A7C15)

_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word without case and ASCII punctuation, and each row's first word (n + 1 entries)."""
    raw, offs = text_bytes(column)
    if len(raw):
        raw = raw.copy()
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        big = second[(raw[second] >= 0x80) & (raw[second] <= 0x9E) & (raw[second] != 0x97)]
        raw[big] += 0x20
    keep = _KEEP[raw]
    count = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    starts, ends, first = word_spans(raw, offs)
    s, e = count[starts], count[ends]
    some = e > s
    kept = np.zeros(len(s) + 1, np.int64)
    np.cumsum(some, out=kept[1:])
    return span_hashes(raw[keep], s[some], e[some]), kept[first]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of the item with each window [n, width], and where in the window it ends."""
    n, width = windows.shape
    slope = GAP * np.arange(width + 1)
    last = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for word in item:
        here = np.zeros((n, width + 1), np.int32)
        here[:, 1:] = np.maximum(last[:, :-1] + np.where(windows == word, MATCH, MISS), last[:, 1:] - GAP)
        np.maximum(here, 0, out=here)
        last = np.maximum.accumulate(here + slope, axis=1) - slope
        at = last.argmax(axis=1)
        top = last[np.arange(n), at]
        end = np.where(top > best, at, end)
        best = np.maximum(best, top)
    return best, end


def _pair_keys(item: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(words + item.astype(np.uint64) * _PAIR)


class Benchmark:
    """Items with their words, and what finds them in texts.

    seeds (sorted hashes, with item and place of each) are all word n-grams;
    rare (sorted words, with the item of each) are the rarest words of the items,
    of which an alignment without a seed must match `need`.  reach is how many
    words of a text an alignment can span, slack how many edits it can have.
    """

    def __init__(self, rows: list, least: float):
        hashes, first = normal_words(pa.array([r.text for r in rows], pa.large_string()))
        self.ids = [r.item_id for r in rows]
        self.words = [hashes[first[i] : first[i + 1]] for i in range(len(rows))]
        self.size = np.diff(first)
        self.least_points = np.maximum(least * MATCH * self.size, MATCH * LEAST_WORDS)
        self.slack = np.maximum(0, np.floor(MATCH * self.size - self.least_points)).astype(np.int64)
        self.reach = self.size + self.slack
        counts = self.size >= LEAST_WORDS
        grams, at = shingle_hashes(hashes, first, SEED)
        item = np.repeat(np.arange(len(rows)), np.diff(at))
        place = np.arange(len(grams)) - np.repeat(at[:-1], np.diff(at))
        on = counts[item]
        order = np.argsort(grams[on], kind="stable")
        self.seeds, self.item, self.place = grams[on][order], item[on][order], place[on][order]
        apart = np.ceil((self.least_points - 1) / (MATCH - 1 / (SEED - 1)) - 1e-9).astype(np.int64)
        self.need = np.minimum(apart, self.size // 6 + 2)
        take = np.where(counts & (apart <= self.size), self.size - apart + self.need, 0)
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(rows)), self.size)
        order = np.lexsort((np.arange(len(hashes)), times[back], owner))
        some = order[np.arange(len(hashes)) - np.repeat(first[:-1], self.size) < np.repeat(take, self.size)]
        pairs = np.unique(np.stack([hashes[some], owner[some].astype(np.uint64)]), axis=1)
        self.rare, self.rare_item = pairs[0], pairs[1].astype(np.int64)
        self._pairs = np.unique(_pair_keys(owner, hashes))
        self._marks: dict[str, np.ndarray] = {}

    def may_hold(self, name: str, values: np.ndarray) -> np.ndarray:
        """Whether each hash is in one of the sorted tables, or, now and then, looks so."""
        if name not in self._marks:
            table = getattr(self, name)
            bits = max(16, int(16 * len(table)).bit_length())
            self._marks[name] = np.zeros(1 << bits, bool)
            self._marks[name][table >> np.uint64(64 - bits)] = True
        marks = self._marks[name]
        return marks[values >> np.uint64(65 - len(marks).bit_length())]

    def hits(self, name: str, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which value, which entry of a sorted table) for each equal pair."""
        table, maybe = getattr(self, name), np.flatnonzero(self.may_hold(name, values))
        low, high = np.searchsorted(table, values[maybe], "left"), np.searchsorted(table, values[maybe], "right")
        times = high - low
        which = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(maybe, times), which

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_marks": {}}


def _spans(bench: Benchmark, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, word after the last) of windows, each within a row, that hold every alignment that can be worth enough.

    Words count from the start of the first row.  Windows of an item that
    overlap are one, and one much wider than an alignment's reach is several,
    which overlap by that reach.
    """
    grams, at = shingle_hashes(words, first, SEED)
    gram, which = bench.hits("seeds", grams)
    row = np.searchsorted(at, gram, "right") - 1
    begin = first[row] + gram - at[row] - bench.place[which]
    item = bench.item[which]
    low, high = begin - bench.slack[item], begin + bench.size[item] + bench.slack[item]
    place, which = bench.hits("rare", words)
    if len(place):
        key = np.sort(bench.rare_item[which] * (len(words) + 1) + place)
        own, place = key // (len(words) + 1), key % (len(words) + 1)
        of = np.searchsorted(first, place, "right") - 1
        last = np.arange(len(own)) + bench.need[own] - 1
        inside = np.minimum(last, len(own) - 1)
        near = (last < len(own)) & (own[inside] == own) & (of[inside] == of) & (place[inside] - place < bench.reach[own])
        own, of, begin, end = own[near], of[near], place[near], place[inside[near]]
        item, row = np.r_[item, own], np.r_[row, of]
        low, high = np.r_[low, end - bench.reach[own] + 1], np.r_[high, begin + bench.reach[own]]
    low, high = np.maximum(low, first[row]), np.minimum(high, first[row + 1])
    base = item * (len(words) + 1)
    order = np.argsort(base + low, kind="stable")
    item, low, high, base = item[order], low[order], high[order], base[order]
    far = np.maximum.accumulate(base + high) if len(base) else base
    fresh = np.r_[True, (base + low)[1:] >= far[:-1]] if len(base) else np.empty(0, bool)
    begins = np.flatnonzero(fresh)
    item, low = item[begins], low[begins]
    high = far[np.r_[begins[1:], len(far)] - 1] - base[begins] if len(begins) else high
    reach = bench.reach[item]
    tiles = np.where(high - low > 3 * reach, -(-(high - low - reach) // reach), 1)
    own = np.repeat(np.arange(len(item)), tiles)
    step = np.arange(tiles.sum()) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    low = low[own] + step * reach[own]
    high = np.where(tiles[own] > 1, np.minimum(low + 2 * reach[own], high[own]), high[own])
    return item[own], low, high


def _hopeful(bench: Benchmark, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which windows can hold enough points: at most those of their best stretch, each word of the item a match and each other an edit."""
    out = np.zeros(len(item), bool)
    ends = np.cumsum(high - low)
    a = 0
    while a < len(item):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + GRID_WORDS)))
        n = (high - low)[a:b]
        at = np.cumsum(n) - n
        own = np.repeat(np.arange(b - a), n)
        place = np.arange(n.sum()) - at[own] + low[a:b][own]
        points = np.cumsum(np.where(bench.may_hold("_pairs", _pair_keys(item[a:b][own], words[place])), MATCH, -1))
        before = np.r_[0, points[:-1]]
        # each window's sums lie below those of the one before, so that the least sum so far is its own
        drop = own * (MATCH + 2) * (int(n.max()) + 1)
        shift = points[np.maximum(at - 1, 0)] * (at > 0)
        least = np.minimum.accumulate(before - shift[own] - drop) + drop
        out[a:b] = np.maximum.reduceat(points - shift[own] - least, at) >= bench.least_points[item[a:b]]
        a = b
    return out


def _grids(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows by groups (places in low), each with its words [window, width], 0 behind the last."""
    order = np.argsort(high - low, kind="stable")
    a = 0
    while a < len(order):
        to = a + 1
        while to < len(order) and (to + 1 - a) * (high - low)[order[to]] <= GRID_WORDS:
            to += 1
        some = order[a:to]
        n = (high - low)[some]
        grid = np.zeros((len(some), max(1, int(n.max()))), np.uint64)
        inside = np.arange(grid.shape[1]) < n[:, None]
        grid[inside] = words[(low[some][:, None] + np.arange(grid.shape[1]))[inside]]
        yield some, grid
        a = to


def most_points(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """What an alignment of the item with each window is worth at most: all words that they share, in any order."""
    own, times = np.unique(item, return_counts=True)
    place = np.minimum(np.searchsorted(own, windows), len(own) - 1)
    at, column = np.nonzero(own[place] == windows)
    shared = np.bincount(at * len(own) + place[at, column], minlength=len(windows) * len(own)).reshape(len(windows), len(own))
    return MATCH * np.minimum(shared, times).sum(axis=1)


def _pieces(first: np.ndarray, most: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, word after the last) of rows, those above so many words in pieces that overlap."""
    n = np.diff(first)
    parts = np.where(n > most, -(-(n - overlap) // (most - overlap)), 1)
    row = np.repeat(np.arange(len(n)), parts)
    step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    low = first[row] + step * (most - overlap)
    return row, low, np.where(parts[row] > 1, np.minimum(low + most, first[row + 1]), first[row + 1])


def _matches(bench: Benchmark, column: pa.Array) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, word after the last) for each row and item that align well enough."""
    words, first = normal_words(column)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not len(bench.seeds) or not len(words):
        return []
    widest = int(bench.reach.max())
    rows, lows, highs = _pieces(first, max(PIECE_WORDS, 4 * widest), widest)
    a = 0
    while a < len(rows):
        # rows that follow one another, or a piece of a long one
        b = a + 1
        while b < len(rows) and lows[b] == highs[b - 1] and highs[b] - lows[a] <= PIECE_WORDS:
            b += 1
        part, edges = words[lows[a] : highs[b - 1]], np.r_[lows[a:b], highs[b - 1]] - lows[a]
        item, low, high = _spans(bench, part, edges)
        on = _hopeful(bench, part, item, low, high)
        item, low, high = item[on], low[on], high[on]
        row = rows[a + np.searchsorted(edges, low, "right") - 1] if len(low) else low
        for i in np.unique(item).tolist():
            mine = np.flatnonzero(item == i)
            own, floor = bench.words[i], bench.least_points[i]
            likely = [mine[some[most_points(own, grid) >= floor]] for some, grid in _grids(part, low[mine], high[mine])]
            mine = np.concatenate(likely)
            for some, grid in _grids(part, low[mine], high[mine]):
                points, end = align(own, grid)
                for k in np.flatnonzero(points >= floor):
                    window = mine[some[k]]
                    start = int(low[window] + lows[a] - first[row[window]])
                    back = int(align(own[::-1], grid[k : k + 1, : end[k]][:, ::-1])[1][0])
                    found = (float(points[k] / (MATCH * len(own))), start + int(end[k]) - back, start + int(end[k]))
                    key = (int(row[window]), i)
                    if key not in best or (found[0], -found[1]) > (best[key][0], -best[key][1]):
                        best[key] = found
        a = b
    return [(r, i, *v) for (r, i), v in sorted(best.items())]


def _parts(benchmark: DataFrame, least: float) -> Iterator[Benchmark]:
    """The benchmark by parts of bounded size."""
    items = stage(with_columns(benchmark, ["item_id", "text"]).where(F.col("text").isNotNull()), "benchmark")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // BENCHMARK_BYTES)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        rows.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield Benchmark(rows, least)


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) for each row of docs and item that it holds a copy of.

    Words are compared without case and ASCII punctuation.  score is the best
    local alignment (2 for a match, -1 for a miss, -1 for a word put in or left
    out) over that of the item with itself, 0 to 1; rows have at least `least`
    and the worth of 8 words, so an item under 8 words matches nothing.  Every
    such row and item is found, whatever other rows and items there are.  The
    span counts words of the whole text from 0, its end excluded; among equals
    it is the first.  Null or blank texts match nothing; a repeated row or item
    gives its rows again; null ids are kept.  Other columns are ignored.
    """
    rows = with_columns(docs, ["doc_id", "text"])
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for bench in _parts(benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(bench)

        def one(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            found = _matches(sent.value, batch.column(1))
            ids = sent.value.ids
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            return pa.record_batch(
                {
                    "doc_id": batch.column(0).take(pa.array(columns[0], pa.int64())),
                    "item_id": pa.array([ids[i] for i in columns[1]], pa.int64()),
                    "score": pa.array(columns[2], pa.float64()),
                    "first_word": pa.array(columns[3], pa.int64()),
                    "end_word": pa.array(columns[4], pa.int64()),
                }
            )

        out = out.unionByName(map_batches(rows, one, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that hold a copy of no benchmark item (as contaminated_passages finds them).

    Null and blank texts stay; repeated rows and null ids stay or go as their
    texts do; an empty benchmark keeps all rows; no rows in: none out.
    """
    for bench in _parts(benchmark, least):
        sent = docs.sparkSession.sparkContext.broadcast(bench)

        def clean(batch: pa.RecordBatch, sent=sent) -> np.ndarray:
            keep = np.ones(batch.num_rows, bool)
            keep[[m[0] for m in _matches(sent.value, batch.column(0))]] = False
            return keep

        docs = keep_rows(docs, ["text"], clean)
    return docs
