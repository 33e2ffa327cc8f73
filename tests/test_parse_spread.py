"""Parsing keeps all cores busy, also when few tasks read the files."""

import pytest
from pyspark.sql import functions as F

from weftgraph.plans import text_queries
from weftgraph.sources import parse

SF = "/root/testdata/sf0.001"
READ = {
    "p09_calls": lambda parsed: parsed.select("path", F.explode("parsed.calls")),
    "p01_python_symbols": lambda parsed: parse.symbols(parsed),
    "p14_symbol_promotion": lambda parsed: parse.promote(parsed)[1],
    "p01_python_imports": lambda parsed: parse.dependencies(parsed),
}


@pytest.mark.parametrize("name", READ)
def test_a_small_table_is_parsed_by_all_cores(spark, name):
    parsed = parse.with_parsed(text_queries.modules(spark, SF))  # the table is one file, read by one task
    assert READ[name](parsed).select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_settings_are_read_by_all_cores(spark):
    files = spark.range(0, 200, 1, 1).select(F.concat(F.col("id").cast("string"), F.lit(".json")).alias("path"), F.lit(".json").alias("extension"), F.lit('{"a": {"b": 1}}').alias("text"))
    keys = parse.structured_keys(files)
    assert keys.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    assert keys.filter("keys = array('a', 'a.b')").count() == 200


@pytest.mark.parametrize("name", READ)
def test_a_file_is_parsed_once(spark, name):
    plan = READ[name](parse.with_parsed(text_queries.modules(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
