"""Ids of texts that hold the strings of added tokens."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import packing

TEXTS = ["a<|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>\n x  <|endoftext|>  y", "<|endoftext|", "<|startoftext|>a", "it's  <|ENDOFTEXT|> ü", "plain"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_those_of_the_untouched_tokenizer(name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    for text, ids in zip(TEXTS, packing.encoder(path)(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_pack_counts_an_added_token_once(spark):
    rows = packing.pack(spark.createDataFrame([(1, "a<|endoftext|> b")], "doc_id long, text string")).collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == [[64, 50256, 275, 0]] and rows[0].doc_tokens == 4
