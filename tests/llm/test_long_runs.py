"""Encoding of very long white-space runs for packing, as the library of the ``.json`` file does it."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing


@pytest.mark.parametrize("text", ["a" + " " * 999_999 + "b", " " * 2_000_000, "it's 12 " + "\n" * 3_000_000 + "\u00e9 \u4e16!?", "x\t" + "\r\n " * 500_000])
def test_white_space_runs(text):
    encode = packing.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)()
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.array_equal(encode(text), tool.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["ab <|endoftext|> cd", "<|endoftext|>", "a<|endoftext|><|endoftext|>\n b", "<|endoftext|" + " " * 1_000_001 + "x<|endoftext|>"])
def test_added_tokens(text):
    encode = packing.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)()
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.array_equal(encode(text), tool.encode(text, add_special_tokens=False).ids)
