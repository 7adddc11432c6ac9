"""Ids of texts that hold the strings of added tokens, against the tokenizer as it comes."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rangeloom.llm import packing
from rangeloom.llm.tokens import encoder

END = "<|endoftext|>"
TEXTS = [f"a {END} b", END, f"{END}{END}\n{END} x", f"no{END}gap", "<|endoftext|", f"<|{END}|>", "", "I'll  go\n\n été 12"]


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_those_of_the_tokenizer(vocabulary):
    plain, encode = Tokenizer.from_file(public_tokenizers.path(vocabulary)), encoder(vocabulary, added=True)
    rng = random.Random(1)
    for text in TEXTS + ["".join(rng.choice([END, " ", "\n", "ab", "'s", "é", "<|", "|>", "7"]) for _ in range(12)) for _ in range(500)]:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def test_pieces_count_an_added_token_once(make_docs):
    (row,) = packing.cut_pieces(make_docs([f"a {END} b"])).collect()
    assert row.length == 4 + 1
