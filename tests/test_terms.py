"""The postings of files: made in each file's row, whatever the corpus."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import rank
from weftgraph.plans import catalog, fixtures, staging

#: Queries that read the postings.
SHARED = ["g19_score", "g32_context_pack", "g30_snippets", "g11_document_frequency", "p16_file_terms"]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def corpus(spark, *rows):
    return spark.createDataFrame(rows, "id string, path string, text string")


def test_terms_of_files_are_not_shuffled(spark):
    """g12_idf and all others that read postings: pairs of file and term stay where they are made."""
    files = corpus(spark, ("file:a/one.py", "a/one.py", "parseHTTPServer fooBar the running running_fast"), ("file:b/two.md", "b/two.md", None))
    terms = rank.file_terms(files)
    assert exchanges(terms) == 0
    own = {r[0] for r in files.select(F.explode(T.words(F.col("text"))).alias("w")).select(F.explode(T.pieces(F.col("w"))).alias("p")).select(T.stem(F.col("p"))).collect()}
    assert sorted((r.id, r.term) for r in terms.collect()) == sorted([("file:a/one.py", t) for t in own | {"one"}] + [("file:b/two.md", "two")])


def test_terms_of_repeated_ids_are_different(spark):
    rows = [("file:a", "a", "alpha beta"), ("file:a", "a", "beta gamma"), ("file:b", "b", "beta"), (None, "c", "beta"), (None, "c", "beta")]
    found = [tuple(r) for r in rank.file_terms(corpus(spark, *rows)).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {("file:a", t) for t in ("a", "alpha", "beta", "gamma")} | {("file:b", "b"), ("file:b", "beta"), (None, "c"), (None, "beta")}


def test_stems_of_arrays_are_those_of_words(spark):
    odd = "process Process PROCESS HTTPServer foo11 foo1111 x__running_fast runn realizations izations abccings bbbbb abss __init__ getHTTPResponse2Code aBcDeF dd_dd1dd statuses helping ingly stopped qqqq_qqqqed The".split()
    words = spark.createDataFrame([(w,) for w in odd], "w string")
    one = F.array_sort(F.array_distinct(F.transform(T.pieces(F.col("w")), T.stem)))
    assert words.filter(~one.eqNullSafe(F.array_sort(T.stems(F.array("w"))))).count() == 0


@pytest.mark.parametrize("name", SHARED)
def test_queries_make_postings_without_a_vocabulary(spark, monkeypatch, name):
    """No table of words or of a vocabulary is written for a query; its postings are one stage without a shuffle."""
    tags = []
    write = staging.stage
    for module in (staging, rank, fixtures):
        monkeypatch.setattr(module, "stage", lambda df, tag: tags.append((tag, exchanges(df))) or write(df, tag))
    monkeypatch.setattr(fixtures, "_WRITTEN", {})
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert not {"words", "vocabulary"} & {t for t, _ in tags}
    assert all(n == 0 for t, n in tags if t == "terms")
