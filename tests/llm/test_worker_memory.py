"""What a Python worker keeps stays small: workers outlive their tasks, and an executor's limit holds for all of them."""

import gc
import random
import subprocess
import sys
import tracemalloc

import pyarrow as pa
from pyspark import SparkContext
from quadloom.llm import bpe, quality, queries


def test_a_remembered_fragment_takes_few_bytes(monkeypatch):
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(bpe, "small_batches", lambda spark: None)
    monkeypatch.setattr(bpe, "pick", lambda docs, **columns: Rows())

    class Docs:
        sparkSession = None

    run = bpe.encode(Docs(), queries.vocabulary("word_bpe_49k.json"))
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(8)) for _ in range(20_000)]
    texts = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]

    def encoded(some):
        return sum(b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(some)), pa.int64()), "text": pa.array(some)})])))

    encoded(["a " * 100_000])  # as many bytes: tables that all texts share grow once
    gc.collect()
    tracemalloc.start()
    assert encoded(texts) == len(texts)
    gc.collect()
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept / len(set(words)) < 100


def test_the_stages_load_no_pandas():
    code = "import sys, corpus_pipeline; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], env={"PYTHONPATH": ":".join(p for p in sys.path if p)}).returncode == 0


def test_training_starts_no_python_workers_of_its_own(spark, monkeypatch):
    rows = [(k, f"{'good words of a whole text' if k % 2 else '$ # buy now |'} number {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    expected = quality.model_from(docs, labels)

    def refused(*_):
        raise AssertionError("a list of Python objects goes through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert (quality.model_from(docs, labels).weights == expected.weights).all()
