"""What packing holds in a Python worker."""

import types

import pyarrow as pa

from weftgraph.llm import packing


def test_pieces_are_given_out_in_small_batches(spark, monkeypatch):
    df, held, freed = spark.createDataFrame([], "doc_id long, text string"), [], []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: held.append(f) or self)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(packing, "give_back", lambda: freed.append(1))
    monkeypatch.setattr(packing, "_ENCODERS", {})
    packing.pack(df)
    rows = pa.record_batch({"doc_id": [1, 2], "text": [" a" * (1024 * 1500), "b"]})
    found = list(held[0](iter([rows])))
    assert sum(b.num_rows for b in found) == 1502 and max(b.nbytes for b in found) < 3 << 20
    assert freed  # memory of earlier operators goes before the tokenizer comes
    sequences = [x for b in found for x in b.column(5).to_pylist()]
    assert sorted(sequences) == [*range(1501), 1500]
