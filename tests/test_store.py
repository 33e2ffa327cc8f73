"""Snapshots under readers and rival writers, locks, versioned tables, listings of odd trees."""

import os
import threading

import pytest

from weftgraph import __main__ as cli
from weftgraph import schema
from weftgraph.api import Repository
from weftgraph.operators import runtime, store
from weftgraph.sources import export, scan


def tables(spark, n):
    nodes = spark.createDataFrame([(f"n{i}", "FILE", f"n{i}", "s", 1.0, None) for i in range(n)], schema.NODES)
    return nodes, spark.createDataFrame([], schema.EDGES)


def test_a_reader_always_finds_a_whole_snapshot(spark, tmp_path):
    own = store.open_store(spark, f"file://{tmp_path}/s")
    assert own.version() is None and own.read()[0].count() == 0
    own.commit(*tables(spark, 1), {"extra": spark.range(1)})
    seen, done = [], threading.Event()

    def read():
        while not done.is_set():
            version = own.version()
            seen.append((own.read(version)[0].count(), own.table("extra", version).count()))

    reader = threading.Thread(target=read)
    reader.start()
    for n in (2, 3, 4):
        own.commit(*tables(spark, n), {"extra": spark.range(n)})
    done.set()
    reader.join()
    assert seen and all(a == b and a >= 1 for a, b in seen) and own.read()[0].count() == 4
    assert own.vacuum(keep=1) == 3 and own.read()[0].count() == 4 and own.table("none") is None
    with pytest.raises(ValueError):
        store.open_store(spark, f"file://{tmp_path}/s", "other")


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    one, two = (store.SnapshotStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.commit(*tables(spark, 1))
    before = two._pointers()
    one.commit(*tables(spark, 2))
    calls = iter([before])
    real = two._pointers
    monkeypatch.setattr(two, "_pointers", lambda: next(calls, None) or real())
    with pytest.raises(store.ConflictError):
        two.commit(*tables(spark, 3))
    assert one.read()[0].count() == 2
    # a claim whose writer died is taken over
    os.remove(next(tmp_path.glob("s/CURRENT-000000000002-*")))
    with pytest.raises(store.ConflictError):
        one.commit(*tables(spark, 3))
    monkeypatch.setattr(store, "ABANDONED", -1.0)
    one.commit(*tables(spark, 3))
    assert one.read()[0].count() == 3


def test_lock(spark, tmp_path):
    own = store.SnapshotStore(spark, f"file://{tmp_path}/s")
    with own.lock():
        with pytest.raises(TimeoutError):
            own.lock(wait=0.3).__enter__()
        left = store.Lock(spark, f"file://{tmp_path}/s", wait=2.0, stale=-1.0)
        with left:
            pass
    with own.lock(wait=0.1):
        pass


def test_versioned_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert export.read_table(spark, path) is None and export.read_checkpoint(spark, path).count() == 0
    for n in (1, 2, 3):
        export.write_table(spark.range(n), path)
        assert export.read_table(spark, path).count() == n
    assert len(list(tmp_path.glob("t/v*"))) == 2
    files = spark.createDataFrame([("a", 1, None, "h", "more")], "path string, size_bytes long, modified_at timestamp, hash_value string, text string")
    export.write_checkpoint(files, f"{path}2")
    assert [tuple(r) for r in export.read_checkpoint(spark, f"{path}2").collect()] == [("a", 1, None, "h")]
    export.write_json_lines(spark.createDataFrame([(2, None, "x")], "b int, c string, a string"), f"{path}3")
    assert [r.value for r in spark.read.text(f"{path}3").collect()] == ['{"a":"x","b":2,"c":null}']


def test_journal(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"event_type":"a","payload":"x","timestamp":1.5,"sequence":2}\n{"event_type":"b","sequence":1}\n')
    journal = runtime.read_journal(spark, f"file://{tmp_path}/j.jsonl")
    seen = []
    assert runtime.replay(journal, lambda r: seen.append(r.event_type)) == 2 and seen == ["b", "a"]
    assert runtime.replay(journal, seen.append, 2) == 1 and runtime.flush(journal).count() == 0
    (tmp_path / "bad.jsonl").write_text('{"event_type":"a"}\nno json\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        runtime.read_journal(spark, f"file://{tmp_path}/bad.jsonl").collect()
    run = runtime.Lifecycle()
    run.record("files_read", 3)
    run.record("unknown")
    assert run.advance() == "classification" and run.advance("complete") == run.advance() == "complete" and run.stats["files_read"] == 3
    with pytest.raises(ValueError):
        run.advance("nowhere")


def test_odd_trees(spark, tmp_path, monkeypatch):
    tree = tmp_path / "a tree"
    for path, text in {"x/_p.py": "a = 1\n", "x/é.py": "b = 2\n", "x/y/z/deep.py": "", "node_modules/n.js": "", ".git/c": "", "big.py": "#" * 3000, "skip.log": "l"}.items():
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(text)
    (tree / ".gitignore").write_text("*.log\n")
    os.symlink(tree, tree / "x" / "loop")
    root = f"file://{tree}"
    for entries in (20_000, 1):
        monkeypatch.setattr(scan, "_ENTRIES", entries)
        rows = {r.path: r for r in scan.list_tree(spark, root).collect()}
        assert set(rows) == {"x/_p.py", "x/é.py", "x/y/z/deep.py", "big.py", "skip.log", ".gitignore", "x/loop"} and rows["x/loop"].is_symlink
    assert scan.ignore_file(spark, root) == ("*.log",) and scan.ignore_file(spark, f"file://{tmp_path}") == ()
    found = {r.path: r for r in scan.with_content(scan.list_tree(spark, root).filter("NOT is_dir"), root, max_kb=1).collect()}
    assert found["big.py"].content is None and "larger" in found["big.py"].error and bytes(found["x/é.py"].content) == b"b = 2\n" and found["x/y/z/deep.py"].error is None

    repo = Repository(spark, f"file://{tmp_path}/store")
    assert repo.index(root, max_kb=1) == {"added": 4, "changed": 0, "unchanged": 0, "deleted": 0}  # the ignore file is one of them
    assert [r.path for r in repo.failures.collect()] == ["big.py"]
    version = repo.store.version()
    (tree / "big.py").write_text("def small(): pass\n")
    (tree / "x/_p.py").write_text("def broken(:\n")
    assert repo.index(root, max_kb=1) == {"added": 1, "changed": 1, "unchanged": 3, "deleted": 0} and repo.store.version() != version
    version = repo.store.version()
    assert repo.index(root, max_kb=1)["unchanged"] == 5 and repo.store.version() == version  # nothing is written
    os.utime(tree / "big.py", (1, 1))
    assert repo.index(root, max_kb=1) == {"added": 0, "changed": 0, "unchanged": 5, "deleted": 0}
    terms = {(r.id, r.term) for r in repo.store.table("terms").collect()}
    assert ("file:big.py", "small") in terms and ("file:big.py", "big") in terms


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "count.py").write_text("def count_tokens(text):\n    return len(text)\n")
    store_ = ["--store", f"file://{tmp_path}/store"]
    assert cli.main([*store_, "index", f"file://{tmp_path}/tree"]) == 0
    assert cli.main([*store_, "context", "where are tokens counted"]) == 0
    out = capsys.readouterr().out
    assert '"added": 1' in out and "count.py" in out
