"""Chat formatting at the level of tokens: segments encoded apart, reserved ids spliced in, masks from prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, with_columns
from .tokenizer import encode, encoding, vocabulary_size


@dataclass(frozen=True)
class ChatTemplate:
    """Each turn is begin, role, middle, text, end; the three have reserved ids behind the vocabulary.

    All control strings are escaped where they come up in a role or a text: one
    more backslash goes behind the first character of each, and of each that
    has backslashes there already, so taking one away restores the text.  No
    control string may hold the start of another but at its own start.
    """

    begin: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "</s>"
    others: tuple[str, ...] = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
    learned: tuple[str, ...] = ("assistant",)
    _pattern: re.Pattern = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self) -> None:
        every = sorted({self.begin, self.middle, self.end, *self.others}, key=len, reverse=True)
        object.__setattr__(self, "_pattern", re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in every)))

    def _change(self, text: str, step) -> str:
        def one(m: re.Match) -> str:
            head, slashes, tail = (g for g in m.groups() if g is not None)
            return head + step(slashes) + tail

        return self._pattern.sub(one, text)

    def escape(self, text: str) -> str:
        return self._change(text, lambda s: s + "\\")

    def unescape(self, text: str) -> str:
        return self._change(text, lambda s: s[1:])


def format_turns(turns: DataFrame, vocabulary: bytes, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, turn, formatted, token_ids, loss_mask, role_tokens) for each row of turns (conv_id, turn, role, text, ...).

    A conversation is its rows' output end to end, by turn (in_order gives that
    order).  token_ids: begin, role, middle, text, end; role and text are escaped
    and encoded apart, so no token spans a border, and only the template gives
    reserved ids.  loss_mask is true on the text of learned roles.  A null role
    or text is empty; any string may be a role.  Null ids and repeated rows stay
    rows; no rows in: none out.  Other columns are ignored.
    """
    template = template or ChatTemplate()
    sent = turns.sparkSession.sparkContext.broadcast(vocabulary)
    size = vocabulary_size(vocabulary)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        formatted, ids, masks, heads = [], [], [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            head, body = template.escape(role or ""), template.escape(text or "")
            segments = [[size], encode(sent.value, head), [size + 1], encode(sent.value, body), [size + 2]]
            steps = np.zeros(sum(map(len, segments)) + 1, np.int8)
            starts = np.cumsum([0, *map(len, segments)])
            if role in template.learned:
                steps[starts[3]] += 1
                steps[starts[4]] -= 1
            formatted.append(f"{template.begin}{head}{template.middle}{body}{template.end}")
            ids.append(np.concatenate([np.asarray(s, np.int32) for s in segments]))
            masks.append(np.cumsum(steps[:-1]).astype(bool))
            heads.append(len(segments[1]))
        return pa.record_batch(
            {
                "conv_id": batch.column(0),
                "turn": batch.column(1),
                "formatted": pa.array(formatted, pa.string()),
                "token_ids": pa.array(ids, pa.list_(pa.int32())),
                "loss_mask": pa.array(masks, pa.list_(pa.bool_())),
                "role_tokens": pa.array(heads, pa.int32()),
            }
        )

    schema = "conv_id long, turn long, formatted string, token_ids array<int>, loss_mask array<boolean>, role_tokens int"
    return map_batches(with_columns(turns, ["conv_id", "turn", "role", "text"]), one, schema, most=1 << 20)


def in_order(formatted: DataFrame) -> DataFrame:
    """Conversations as runs of rows by turn; equal turns go by their formatted text.

    Rows are dealt by conversation and sorted in the partitions, so a reader sees
    a conversation row by row and need not hold it.
    """
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")


def read_back(formatted: DataFrame, vocabulary: bytes, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): digests of what the token ids say.

    Roles and texts are decoded from the ids between the reserved ones and
    unescaped; the loss text is what is decoded under the mask.  Rows stream
    through running digests, so memory doesn't grow with a conversation; a null
    conv_id is a conversation of its own.
    """
    template = template or ChatTemplate()
    sent = formatted.sparkSession.sparkContext.broadcast(vocabulary)
    size = vocabulary_size(vocabulary)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value)
        text = lambda ids: template.unescape(enc.decode_bytes(ids.tolist()).decode())
        now, began, out = None, False, []
        n, turns, loss, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0

        def record() -> dict:
            return {"conv_id": now, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

        kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for batch in batches:
            for conv, whole, ids, mask in zip(*(batch.column(c).to_pylist() if c < 2 else batch.column(c) for c in range(4)), strict=True):
                if not began or conv != now:
                    if began:
                        out.append(record())
                    now, began = conv, True
                    n, turns, loss, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                ids = ids.values.to_numpy()
                mask = mask.values.to_numpy(zero_copy_only=False).astype(bool)
                middle = int(np.flatnonzero(ids == size + 1)[0])
                if ids[0] != size or ids[-1] != size + 2 or (ids >= size).sum() != 3:
                    raise ValueError("a turn's reserved ids are not where the template puts them")
                role, body = text(ids[1:middle]), text(ids[middle + 1 : -1])
                turns.update(f"{role}\n{body}\n".encode())
                if mask.any():
                    learned = text(ids[mask])
                    loss.update(learned.encode())
                    loss_chars += len(learned)
                n += 1
                chars += len(whole)
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if began:
            out.append(record())
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    return in_order(formatted).select("conv_id", "formatted", "token_ids", "loss_mask").mapInArrow(run, schema)


def format_digests(turns: DataFrame, vocabulary: bytes, template: ChatTemplate | None = None) -> DataFrame:
    """read_back of format_turns of turns, one row for each conversation."""
    return read_back(format_turns(turns, vocabulary, template), vocabulary, template)


def control_conversation(like: DataFrame) -> DataFrame:
    """Conversation -1: a user's and an assistant's turn that say control strings."""
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    return like.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def all_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations (those columns among others) and of the control conversation.

    Nulls in any column and repeated rows are kept as they are; of no rows, the
    control conversation is left.
    """
    turns = with_columns(conversations, ["conv_id", "turn", "role", "text"]).withColumn("turn", F.col("turn").cast("long"))
    return turns.unionByName(control_conversation(conversations))
