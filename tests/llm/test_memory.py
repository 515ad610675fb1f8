"""What a Python worker holds at once."""

from types import SimpleNamespace
from unittest.mock import MagicMock

import public_tokenizers
import pyarrow as pa
import pyspark
from tokenizers import Tokenizer

from tidelane.llm import chunk_encoder, near_copies, packing, pii
from tidelane.llm.chunk_encoder import ChunkEncoder


def test_workers_take_texts_in_pieces(monkeypatch):
    """Rows behind a worker's answers come in pieces of about a megabyte of text, however many a batch has."""
    texts = ["the " * 75_000] * 6 + [None, "", "the " * 400_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(batch.columns, names=["doc_id", "text"]), pa.array(range(9)), pa.array(range(9))], names=["row", "near_id", "near_row"])

    class Docs:
        columns, schema = ["doc_id", "text"], SimpleNamespace(fields=[])
        sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda model: SimpleNamespace(value=model)))
        select = join = lambda self, *a: self

        def __init__(self, batch):
            self.batch = batch

        def mapInArrow(self, run, schema):
            return list(run([self.batch]))

    for module in (near_copies, packing, pii):
        monkeypatch.setattr(module, "F", MagicMock())
    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    taken = []
    model = SimpleNamespace(names=[])
    for found in (near_copies.with_classes(Docs(rows)), near_copies._sets(Docs(batch), Docs(batch)), pii.redact(Docs(batch), model), pii.detect(Docs(batch), model)):
        assert [b.num_rows for b in found] == [3, 5, 1] and pa.Table.from_batches(found).column(0).length() == 9
    encode = ChunkEncoder.encode
    monkeypatch.setattr(ChunkEncoder, "encode", lambda self, column, end_id: taken.append(len(column)) or encode(self, column, end_id))
    found = pa.Table.from_batches(packing.pack(Docs(batch), public_tokenizers.path("byte_bpe_50k.json")))
    assert taken == [3, 5, 1] and sorted(set(found.column("doc_id").to_pylist())) == list(range(9))
    own = chunk_encoder._encoders[public_tokenizers.path("byte_bpe_50k.json"), True]
    assert sum(isinstance(x, Tokenizer) for x in vars(own).values()) == 1  # the vocabulary is in memory once
