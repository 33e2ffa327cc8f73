"""Small graphs and files whose results are known."""

import pytest
from pyspark.sql import functions as F

from weftgraph import schema
from weftgraph.functions import text as T
from weftgraph.operators import enrich, lookups, resolve, runtime, store, traverse
from weftgraph.plans.numbering import numbered
from weftgraph.sources import scan


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "IMPORTS") for a, b in pairs], "from_node string, to_node string, type string")


def nodes(spark, *ids):
    return spark.createDataFrame([(i, "FILE", i, i, 1.0, None) for i in ids], schema.NODES)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_lookups_over_three_files(spark):
    n, e = nodes(spark, "main", "utils", "handlers"), edges(spark, ("main", "utils"), ("main", "handlers"), ("handlers", "utils"), ("ghost", "utils"))
    found, own = lookups.dependents(n, e, "utils")
    assert {r.id for r in found.collect()} == {"main", "handlers"} and own.count() == 3  # the missing node's edge counts
    assert {r.id for r in lookups.imports(n, e, "main")[0].collect()} == {"utils", "handlers"}
    assert {r.id for r in traverse.bfs(n, e, ids(spark, "main"), 1)[0].collect()} == {"main", "utils", "handlers"}
    assert lookups.all_edges_for(edges(spark, ("a", "a")), "a").count() == 2


def test_traversal(spark):
    chain = edges(spark, ("app", "lib2"), ("lib2", "lib"))
    assert traverse.shortest_path(chain, "app", "lib").first().path == ["app", "lib2", "lib"]
    assert traverse.shortest_path(chain, "x", "x").first().path == ["x"] and traverse.shortest_path(chain, "lib", "app").count() == 0
    assert {r.id for r in traverse.impact(nodes(spark, "app", "lib2", "lib"), chain, ids(spark, "lib")).collect()} == {"app", "lib2"}
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    assert [r.nodes for r in traverse.cycles(ring).collect()] == [["a", "b", "c"]]
    assert traverse.reach(ring, ids(spark, "a"), 10).count() == 4
    line = edges(spark, *[(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)])
    assert traverse.reach(line, ids(spark, "n00"), 12).agg(F.max("depth")).first()[0] == 12


@pytest.mark.parametrize(
    ("files", "source", "target", "level", "expected"),
    [
        (["pkg/sub/mod.py", "pkg/sub/helpers.py"], "pkg/sub/mod.py", ".helpers", 0, "pkg/sub/helpers.py"),
        (["pkg/sub/mod.py", "pkg/up.py"], "pkg/sub/mod.py", "..up", 0, "pkg/up.py"),
        (["pkg/sub/mod.py", "pkg/sub/sibling.py"], "pkg/sub/mod.py", "sibling", 1, "pkg/sub/sibling.py"),
        (["app/main.py", "app/subpkg/__init__.py"], "app/main.py", ".subpkg", 0, "app/subpkg/__init__.py"),
        (["db/main.py", "db/helpers.py", "db/__init__.py"], "db/main.py", "db.helpers", 0, "db/helpers.py"),
        (["src/app.ts", "src/utils.ts"], "src/app.ts", "./utils", 0, "src/utils.ts"),
        (["src/app.ts", "lib/mod.js"], "src/app.ts", "../lib/mod.js", 0, "lib/mod.js"),
        (["src/page.js", "src/components/button/index.tsx"], "src/page.js", "./components/button", 0, "src/components/button/index.tsx"),
    ],
)
def test_resolution(spark, files, source, target, level, expected):
    known = spark.createDataFrame([(f, f) for f in files], "path string, ord string")
    deps = spark.createDataFrame([(source, target, level, 1)], "source_file string, target_module string, level int, line int")
    assert [r.to_node for r in resolve.resolve(deps, known).collect()] == [f"file:{expected}"]


def test_store_round_trip(spark, tmp_path):
    own = store.SnapshotStore(spark, f"file://{tmp_path}/graph")
    assert own.read()[0].count() == 0
    own.commit(nodes(spark, "n1", "n2"), spark.createDataFrame([], schema.EDGES))
    batch = nodes(spark, "n1", "n3").withColumn("ord", F.lit(1)).union(nodes(spark, "n1").withColumns({"name": F.lit("second"), "ord": F.lit(2)}))
    own.apply(node_upserts=batch, node_deletes=ids(spark, "n2"))
    assert {r.id: r.name for r in own.read()[0].collect()} == {"n1": "second", "n3": "n3"}
    again = own.read()[0]
    assert store.diff(again, again, ["id"]).count() == 0
    assert {(r.id, r.change) for r in store.diff(nodes(spark, "a", "b"), nodes(spark, "b", "c"), ["id"]).collect()} == {("a", "deleted"), ("c", "added")}


def test_search_is_literal(spark):
    n = spark.createDataFrame([("a", "FILE", "100%_done", "", 1.0, None), ("b", "FILE", "100xdone", "", 1.0, None)], schema.NODES)
    for part in ("%", "_", "100%_done"):
        assert [r.id for r in lookups.search_by_name(n, part).collect()] == ["a"]


def test_stems(spark):
    pairs = {"budgeted": "budget", "resolves": "resolv", "resolve": "resolv", "trimming": "trim", "ranking": "rank", "bus": "bus", "class": "class", "Configuration": "config"}
    df = spark.createDataFrame(list(pairs.items()), "w string, s string")
    assert df.filter(T.stem(F.col("w")) != F.col("s")).count() == 0
    light = {"indexing": "index", "running": "run", "queries": "query", "classes": "class", "files": "file", "this": "", "bus": ""}
    df = spark.createDataFrame(list(light.items()), "w string, s string")
    assert df.filter(T.light_stem(F.col("w")) != F.col("s")).count() == 0
    assert spark.range(1).select(T.pieces(F.lit("parseHTTPServer_fooBar"))).first()[0] == ["parsehttpserver", "foobar", "parse", "http", "server", "foo", "bar"]


def test_naming(spark):
    files = spark.createDataFrame([("a/user_repo.py",), ("b/user_repo.py",), ("b/__init__.py",), ("c/__init__.py",)], "path string")
    assert [(r.source_a, r.source_b) for r in enrich.naming_conflicts(files).collect()] == [("a/user_repo.py", "b/user_repo.py")]
    assert {(r.pattern, r.part, r.n) for r in enrich.design_patterns(files).collect()} == {("repository", "user_repo.py", 2)}


def test_binary_and_encoding(spark):
    rows = [("a", b""), ("b", b"text\n"), ("c", b"a\0b"), ("d", bytes(range(128, 228))), ("e", "é".encode("latin-1") + b" plain text here"), ("f", b"x" * 9000 + b"\0")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    found = {r.path: (r.is_binary, r.encoding, r.lines_count) for r in scan.describe(df).collect()}
    assert found == {"a": (False, "utf-8", 0), "b": (False, "utf-8", 1), "c": (True, "", 0), "d": (True, "", 0), "e": (False, "latin-1", 1), "f": (False, "utf-8", 1)}


def test_latency_is_the_upper_median(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (4, 1, 3, 2)] + [("y", 5.0)], "event_type string, value double")
    assert {r.event_type: r.value for r in runtime.latency(df, 0.5).collect()} == {"x": 3.0, "y": 5.0}
    assert {r.event_type: r.value for r in runtime.latency(df, 0.99).collect()} == {"x": 4.0, "y": 5.0}


def test_numbers_over_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), (F.col("id") * 7919 % 5000).alias("k"))
    found = {}
    for r in numbered(df, "g", [F.col("k").asc()]).collect():
        found.setdefault(r.g, []).append((r.k, r.n))
    for own in found.values():
        assert [n for _, n in sorted(own)] == list(range(1, len(own) + 1))
