"""What tasks hold in memory. Packing: a shard's ids, narrow, and neither the texts nor a second copy of the ids."""

from __future__ import annotations

import io
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from tokenizers import Tokenizer

from spoorline.llm import langid, packing
from spoorline.llm.queries import tokenizer_path

WORDS = "the of and to in that it is was for on are as with his they at be this from".split()


def arrow_stream(texts, rows):
    sink = io.BytesIO()
    batches = [pa.record_batch([pa.array(range(i, i + len(texts[i : i + rows]))), pa.array(texts[i : i + rows])], ["__id", "__text"]) for i in range(0, len(texts), rows)]
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue()


@pytest.fixture
def task(monkeypatch):
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 3)))


def test_a_shard_is_held_once_and_leaves_in_small_batches(task):
    text = " ".join(np.random.default_rng(5).choice(WORDS, 20_000))
    stream, largest, tokens = arrow_stream([text] * 400, 20), 0, 0
    run = packing._pack(tokenizer_path(), 2048, 1, packing.SHARD_TOKENS)
    # a first run loads the vocabulary
    list(run(iter(pa.ipc.open_stream(arrow_stream(["the"], 1)))))
    tracemalloc.start()
    try:
        # through a Python file every batch gets memory of its own, which is counted, as in a worker
        for out in run(iter(pa.ipc.open_stream(pa.PythonFile(io.BytesIO(stream), "r")))):
            largest = max(largest, out.get_total_buffer_size())
            tokens += int(np.sum(out.column("length").to_numpy()))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert tokens >= 400 * 20_001
    assert largest < 4_000_000
    assert peak < 6 * tokens


@pytest.mark.parametrize("end_id", [1, 65_535, 65_536, 70_000])
def test_ids_of_any_width_come_back(task, end_id):
    texts = ["the of", "", "and to in " * 400, "that"] * 3
    pieces: dict[int, dict[int, list[int]]] = {}
    for out in packing._pack(tokenizer_path(), 64, end_id, 700)(iter(pa.ipc.open_stream(io.BytesIO(arrow_stream(texts, 5))))):
        for r in out.to_pylist():
            pieces.setdefault(r["__id"], {})[r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    whole = Tokenizer.from_file(tokenizer_path())
    for i, text in enumerate(texts):
        got = [x for start in sorted(pieces[i]) for x in pieces[i][start]]
        assert got == [*whole.encode(text, add_special_tokens=False).ids, end_id]


def test_language_learning_needs_no_second_kind_of_python_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "hello hello hello", "aa"), (2, "world world world world", "bb")], "doc_id long, text string, lang string")

    def parallelize(*args, **kwargs):
        raise AssertionError("rows given as a list go through Python workers apart from those of mapInArrow")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", parallelize)
    assert langid.learn(docs).langs == ["bb", "aa"]
