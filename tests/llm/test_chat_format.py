import hashlib
import os
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from weftline.llm.chat_format import ChatTemplate, all_turns, format_digests, format_turns
from weftline.llm.tokenizer import DEFAULT_VOCABULARY, encode, encoding, read_vocabulary, vocabulary_size

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary")
T = ChatTemplate()
CONTROL = [T.begin, T.middle, T.end, *T.others]
PIECES = st.lists(st.sampled_from([*CONTROL, "\\", "<", "/", ">", "[", "|", "s>", "INST]", "<\\", "a", " ", "é", "\n", "SYS>>"]), max_size=12).map("".join)


@given(PIECES)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = T.escape(text)
    assert T.unescape(escaped) == text
    assert not any(c in escaped for c in CONTROL)


@given(st.text(max_size=200))
def test_tokens_round_trip(text):
    data = read_vocabulary()
    assert encoding(data).decode_bytes(encode(data, text)).decode() == text
    assert encoding(data).decode_bytes(encode(data, text, piece=7)).decode() == text


def want(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, f"{T.escape(r[2] or '')}{T.middle}{T.escape(r[3] or '')}"))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        chars = sum(len(T.begin + T.escape(r[2] or "") + T.middle + T.escape(r[3] or "") + T.end) for r in own)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out[conv] = (len(own), sha(said), len(loss), sha(loss), chars)
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(*r, [1], "x") for r in rows], "conv_id long, turn long, role string, text string, token_ids array<int>, formatted string")
    return {r.conv_id: tuple(r)[1:] for r in format_digests(all_turns(frame), read_vocabulary()).collect()}


def test_digests_against_plain(spark):
    rng = random.Random(1)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            text = " ".join(rng.choice([*CONTROL, "word", "é", "\\", "日本", "\n"]) for _ in range(rng.randrange(8)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "</s>"]), text))
    rows += [(100, 0, "user", None), (100, 1, "assistant", None), (101, 3, None, "x"), (101, None, "assistant", ""), (None, 0, "assistant", "lost"), (102, 0, "assistant", "w " * 200_000), (103, 1, "user", "b"), (103, 1, "user", "a"), (103, 1, "user", "a")]
    rng.shuffle(rows)
    control = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert run(spark, rows) == want(rows + control)
    assert run(spark, []) == want(control)


def test_tokens_and_masks(spark):
    data = read_vocabulary()
    size = vocabulary_size(data)
    frame = spark.createDataFrame([(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    a, b = sorted(format_turns(frame, data).collect(), key=lambda r: r.turn)
    assert [i for i in a.token_ids if i >= size] == [size, size + 1, size + 2] and not any(a.loss_mask)
    assert a.formatted == "<|turn|>user<|text|>hi <\\/s></s>"
    assert encoding(data).decode([i for i, m in zip(b.token_ids, b.loss_mask, strict=True) if m]) == "yo"
