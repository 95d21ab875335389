import random

from weftline.llm.tokenizer import encode, encoding, read_vocabulary

PARTS = ["a", "b", "s", "'s", "'", "'ll", " ", "  ", "   ", "\n", "\t", "1", "23", ".", "--", "中", "文", "é", "　", "\xa0", "\x1c"]


def test_pieces_give_the_tokens_of_the_whole_text():
    data = read_vocabulary()
    whole = encoding(data).encode_ordinary
    rng = random.Random(1)
    for _ in range(1000):
        text = "".join(rng.choice(PARTS) for _ in range(200))
        assert encode(data, text, rng.choice([3, 7, 20])) == whole(text)
    for text in ("字中文本" * 40_000, "a" * 70_000 + " " * 70_000 + "b", "QUJD+/" * 30_000, "the " * 16_383 + "  " * 9 + "end " * 9):
        assert encode(data, text) == whole(text)
