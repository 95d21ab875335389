"""A public byte-level BPE vocabulary as a tokenizer: its file is read once and sent to the tasks."""

from __future__ import annotations

import base64

import regex

# Fixed value: the split of text before merges that byte-level BPE vocabularies of this kind were made with.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_BORDER = regex.compile(r"\p{L}(?=[^\p{L}])|\p{N}(?=[^\p{N}])|[^\s\p{L}\p{N}'](?=[\s\p{L}\p{N}])")

_BUILT: dict[int, object] = {}


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The vocabulary file: a line for each token, its bytes in base64 and its rank. Read on the driver."""
    with open(path, "rb") as file:
        return file.read()


def vocabulary_size(data: bytes) -> int:
    return 1 + max(int(line.split()[1]) for line in data.splitlines() if line)


def encoding(data: bytes):
    """The tokenizer of a vocabulary, built once in a process."""
    import tiktoken

    key = hash(data)
    if key not in _BUILT:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        _BUILT[key] = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _BUILT[key]


def _border(text: str, low: int, at: int) -> int:
    """The last place from low to at, else the first one after, that SPLIT never joins over; the end if there is none.

    It parts a space from what is no white space before it, or else a letter,
    a digit or a sign from one of another kind (but for a contraction's letters).
    """
    space = at
    while (space := text.rfind(" ", low, space)) > low:
        if not text[space - 1].isspace():
            return space
    last = None
    for found in _BORDER.finditer(text, low):
        if found.end() > at:
            return last or found.end()
        last = found.end()
    return last or len(text)


def encode(data: bytes, text: str, piece: int = 1 << 16) -> list[int]:
    """Token ids of a whole text; one above so many characters is cut where SPLIT cuts it anyway, which bounds time and memory."""
    enc = encoding(data)
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= piece else _border(text, at + 1, at + piece)
        out += enc.encode_ordinary(text[at:to])
        at = to
    return out
