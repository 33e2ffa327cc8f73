"""Texts on which a pattern that backtracks gives up."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftgraph.llm import packing


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " "])
def test_a_very_long_run_of_blanks(blank):
    text = "before" + blank * 2_000_000 + "after"
    ids = np.frombuffer(next(packing.encoder(packing.default_tokenizer())([text])), "<u4")
    plain = Tokenizer.from_file(packing.default_tokenizer())
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_a_job_with_such_texts(spark):
    rows = [(1, "a b c"), (2, " " * 1_200_000), (3, None), (4, "\n" * 1_000_001 + "x"), (5, "word " * 300_000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    sizes = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start == sizes.get(r.doc_id, 0)
        sizes[r.doc_id] = r.start + r.length
        assert r.doc_tokens >= sizes[r.doc_id]
    assert all(r.doc_tokens == sizes[r.doc_id] for r in found) and sizes[3] == 1
