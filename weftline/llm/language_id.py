"""Language identification by prediction by partial matching, under frozen statistics.

For each language, a variable-order context tree over bytes (A-Z lower-cased)
gives the exact code length of a text: at each byte the longest context codes
it, or pays for an escape and leaves it to the next shorter one (escape
probabilities of method C: distinct / (total + distinct)), down to 1/256.  As
the statistics are frozen, the code lengths of each context and byte are laid
out once as one row with all languages, so scoring is lookups and sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_of_a_key, held_out, keep_rows, label_sample, map_batches, with_columns
from .shingles import _LOWER, text_bytes

UNKNOWN = "und"
#: Bytes of context at most.
ORDER = 4
#: Rows of each language that the statistics are taken from, about, and the longest text among them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """Row numbers of 64-bit codes, by open addressing."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        bits = max(10, (4 * len(codes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        rows, at = np.arange(len(codes), dtype=np.int32), self._home(codes)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            lost = self.slots[at] != rows
            rows, at = rows[lost], (at[lost] + np.uint64(1)) & self.mask

    def _home(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (codes * _ODD) >> self.shift

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The row of each code, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int32)
        at = self._home(codes)
        out = self.slots[at]
        open_ = np.flatnonzero((out >= 0) & (self.codes[out] != codes))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            out[open_] = self.slots[at[open_]]
            still = (out[open_] >= 0) & (self.codes[out[open_]] != codes[open_])
            open_ = open_[still]
        return out


@dataclass
class LanguageModel:
    languages: list[str]
    #: For each length of gram, 1 to ORDER + 1: its codes and bits [gram, language].
    grams: list[tuple[_Table, np.ndarray]]
    #: For each length of context, 0 to ORDER: its codes and the bits of its escape.
    escapes: list[tuple[_Table, np.ndarray]]

    def bits(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        rows, languages = len(offs) - 1, len(self.languages)
        sizes = np.diff(offs)
        out = np.zeros((rows, languages))
        if not len(raw) or not languages:
            return out
        padded, doc = _padded(raw, offs)
        codes = _codes(padded, doc, sizes)
        where = np.repeat(np.arange(rows), sizes)
        for length in range(ORDER + 1, 0, -1):
            table, bits = self.grams[length - 1]
            found = table.find(codes)
            hit = found >= 0
            _add(out, where[hit], bits, found[hit])
            codes, where = codes[~hit], where[~hit]
            if not len(codes):
                return out
            table, bits = self.escapes[length - 1]
            found = table.find(codes >> np.uint64(8)) if length > 1 else np.zeros(len(codes), np.int32)
            hit = found >= 0
            _add(out, where[hit], bits, found[hit])
            codes = codes & np.uint64((1 << (8 * (length - 1))) - 1) if length > 1 else codes
        return out + 8.0 * np.bincount(where, minlength=rows)[:, None]


def _add(out: np.ndarray, where: np.ndarray, bits: np.ndarray, rows: np.ndarray) -> None:
    if len(where):
        begins = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        for language in range(out.shape[1]):
            out[where[begins], language] += np.add.reduceat(bits[language][rows], begins, dtype=np.float64)


def _padded(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts, each after ORDER line feeds, and where each text begins."""
    sizes = np.diff(offs)
    starts = offs[:-1] + ORDER * np.arange(1, len(sizes) + 1)
    out = np.full(len(raw) + ORDER * len(sizes), 10, np.uint8)
    out[np.arange(len(raw)) + ORDER * np.repeat(np.arange(1, len(sizes) + 1), sizes)] = _LOWER[raw]
    return out, starts


def _codes(padded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each byte of each text, the bytes up to it from ORDER before, as one number."""
    code = np.zeros(len(padded) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        code = (code << np.uint64(8)) | padded[k : k + len(code)].astype(np.uint64)
    keep = np.zeros(len(padded), bool)
    at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
    keep[at] = True
    return code[keep[ORDER:]]


def build_model(texts: dict[str, list[str]]) -> LanguageModel:
    """The model of texts by language; a language without a byte of text has none."""
    languages = sorted(k for k, v in texts.items() if any(v))
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for language in languages:
        raw, offs = text_bytes(pa.array(texts[language], pa.large_string()))
        padded, starts = _padded(raw, offs)
        codes = _codes(padded, starts, np.diff(offs))
        counts.append([np.unique(codes & np.uint64((1 << (8 * n)) - 1), return_counts=True) for n in range(1, ORDER + 2)])
    grams, escapes = [], []
    shorter: tuple[_Table, np.ndarray] | None = None
    for n in range(1, ORDER + 2):
        union = np.unique(np.concatenate([c[n - 1][0] for c in counts])) if counts else np.empty(0, np.uint64)
        contexts = np.unique(union >> np.uint64(8)) if n > 1 else np.zeros(1, np.uint64)
        bits, escape = np.empty((len(languages), len(union)), np.float32), np.zeros((len(languages), len(contexts)), np.float32)
        for k, c in enumerate(counts):
            codes, count = c[n - 1]
            at = np.searchsorted(contexts, codes >> np.uint64(8)) if n > 1 else np.zeros(len(codes), int)
            total = np.bincount(at, count, len(contexts))
            distinct = np.bincount(at, minlength=len(contexts))
            seen = total > 0
            escape[k, seen] = -np.log2(distinct[seen] / (total + distinct)[seen])
            row = np.searchsorted(contexts, union >> np.uint64(8)) if n > 1 else np.zeros(len(union), int)
            if n > 1:
                below = shorter[1][k][shorter[0].find(union & np.uint64((1 << (8 * (n - 1))) - 1))]
            else:
                below = np.full(len(union), 8.0)
            line = escape[k][row] + below
            line[np.searchsorted(union, codes)] = -np.log2(count / (total + distinct)[at])
            bits[k] = line
        shorter = (_Table(union), bits)
        grams.append(shorter)
        escapes.append((_Table(contexts), escape))
    return LanguageModel(languages, grams, escapes)


def fit_language_id(docs: DataFrame, per_language: int = SAMPLE_ROWS) -> LanguageModel:
    """The model of docs (doc_id, text, lang, ...), from about per_language rows of each language.

    Rows with a null lang or text, or a text above SAMPLE_BYTES, teach nothing
    and don't count; the sample is by hash of doc_id, with ROWS_PER_KEY rows of
    an id at most, so it is bounded and alike on each run.
    """
    rows = with_columns(docs, ["doc_id", "text", "lang"]).where(F.col("lang").isNotNull() & F.octet_length("text").between(1, SAMPLE_BYTES))
    rows = few_of_a_key(label_sample(rows, "lang", per_language))
    texts: dict[str, list[str]] = {}
    for row in rows.select("lang", "text").collect():
        texts.setdefault(row.lang, []).append(row.text)
    return build_model(texts)


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte) for each row of docs (doc_id, text, ...).

    lang_pred is the language that codes the whole text in the fewest bits, the
    first by name among equals; score is its share of 2 ** (-8 * bits per byte)
    over all languages, 0 to 1.  A text that is null, empty or without a letter,
    and any text if the model has no language, is und with score 0 and null
    bits.  Repeated rows and null ids stay rows.  Other columns are ignored.
    """
    rows = with_columns(docs, ["doc_id", "text"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), "text"
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = sent.value
        raw, offs = text_bytes(batch.column(3))
        known = batch.column(2).to_numpy(zero_copy_only=False) & bool(model.languages)
        rate = model.bits(raw, offs) / np.maximum(1, np.diff(offs))[:, None]
        if model.languages:
            best = rate.argmin(axis=1)
            low = rate[np.arange(len(rate)), best]
            score = 1.0 / np.exp2(-8.0 * (rate - low[:, None])).sum(axis=1)
        else:
            best, low, score = np.zeros(len(rate), int), np.zeros(len(rate)), np.zeros(len(rate))
        names = [*model.languages, UNKNOWN]
        return pa.record_batch(
            {
                "doc_id": batch.column(0),
                "held_out": batch.column(1),
                "lang_pred": pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                "score": pa.array(np.where(known, score, 0.0), pa.float64()),
                "bits_per_byte": pa.array(low, pa.float64(), mask=~known),
            }
        )

    return map_batches(rows, one, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double", most=1 << 20)


def in_known_language(docs: DataFrame, model: LanguageModel, most_bits: float = 7.6) -> DataFrame:
    """The rows of docs, with all their columns, that identify_language doesn't call und and codes in fewer bits a byte than most_bits.

    That is little under the 8 bits of unknown bytes, so it keeps any text that
    has to do with a language of the model, junk and mixtures included.  Null and
    empty texts, and all texts if the model has no language, go; repeated rows
    and null ids stay as often as they are there; no rows in: none out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letter = regex.compile(r"\p{L}")

    def known(batch: pa.RecordBatch) -> np.ndarray:
        raw, offs = text_bytes(batch.column(0))
        if not sent.value.languages:
            return np.zeros(batch.num_rows, bool)
        low = sent.value.bits(raw, offs).min(axis=1) / np.maximum(1, np.diff(offs))
        letters = np.array([bool(t and letter.search(t)) for t in batch.column(0).to_pylist()], bool)
        return letters & (low < most_bits)

    return keep_rows(docs, ["text"], known, most=1 << 20)
