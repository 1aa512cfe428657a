"""Ids equal the default tokenizer's, added tokens of the file included."""

import random

import numpy as np
from freightlens.llm import packing
from tokenizers import Tokenizer


def test_added_tokens_in_texts():
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    encode, r = packing.id_bytes(packing.TOKENIZER, 40), random.Random(4)
    assert np.frombuffer(encode("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "endoftext", "|>", "a", "'s", "e", "́", "É", "İ", " ", "\n", "7"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
