"""Decisions by filters against exact n-gram sets, and the evidence by which the pipeline drops texts."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import langid
from weftgraph.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_query_against_exact_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = {}
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(langid.grams(r.text).tolist())
    sets = {k: {g for g, n in c.items() if n >= langid.SHARE * sum(c.values())} for k, c in counts.items()}
    found = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, SF).collect()}
    differ = 0
    for r in docs:
        own = langid.grams(r.text).tolist()
        if not own:
            assert (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        shares = {k: sum(g in s for g in own) / len(own) for k, s in sets.items()}
        best = max(sorted(shares), key=shares.get)
        second = max(v for k, v in shares.items() if k != best)
        slack = 0.02 + 2 / len(own)  # what false positives may decide after their correction
        if shares[best] - second > slack:
            differ += found[r.doc_id].lang_pred != best
            assert abs(found[r.doc_id].score - shares[best] / (shares[best] + second)) < 2 * slack
    assert differ == 0


def test_ngrams_across_pieces(monkeypatch):
    text = "".join(chr(97 + k * k % 26) for k in range(500))
    whole = Counter(langid.grams(text).tolist())
    monkeypatch.setattr(langid, "_PIECE", 90)
    cut = Counter(np.concatenate(list(langid.pieces(text))).tolist())
    assert not whole - cut and sum((cut - whole).values()) <= 2 * 6


def test_share_and_languages_are_parameters(spark):
    rows = [(i, f"alpha beta gamma {'rare' if i == 0 else 'delta'}", f"l{i % 3 if i < 60 else 9}") for i in range(61)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.learn(df, most=3).languages == ["l0", "l1", "l2"]
    hashes = langid.grams("rare")
    few, all_ = langid.learn(df, share=0.02), langid.learn(df, share=0.0)
    known = lambda f: f.decide("rare")[2]
    assert known(all_) == 1.0 > known(few) and len(hashes)


@pytest.mark.parametrize("times", [1, 40])
def test_texts_go_by_evidence_whatever_their_length(spark, times):
    """One rule for all lengths: foreign letters go once they are enough to tell, prose stays."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    prose = docs.filter("lang = 'en' AND n_chars > 300").select(F.substring("text", 1, 50 * times).alias("text")).limit(5).collect()
    rows = [(10**6 + i, r.text) for i, r in enumerate(prose)] + [(10**6 + 50, "дом кот лес " * times), (10**6 + 51, "1 2 3 " * times)]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.language_id(spark, docs.unionByName(extra, allowMissingColumns=True), SF)
    ids = {r.doc_id for r in kept.filter("doc_id >= 1000000").collect()}
    assert ids >= {10**6 + i for i in range(5)} and 10**6 + 51 not in ids
    assert (10**6 + 50 in ids) == (times == 1)
