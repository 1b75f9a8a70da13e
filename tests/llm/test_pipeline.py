import re

import corpus_pipeline
from pyspark.sql import functions as F
from quadloom.llm import bpe, queries, secrets

from .test_operators import brute_base, brute_leaks
from .test_similar import brute_heads


def test_stages_take_effect(spark, sf):
    docs = queries.table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scan", "token ids"]

    good = stages["quality rules"](spark, docs, sf).cache()
    assert good.columns == docs.columns
    labels = queries.table(spark, sf, "labels")
    marked = labels.join(good.select("doc_id", F.lit(1).alias("kept")).distinct(), "doc_id", "left").join(docs.select("doc_id", "text"), "doc_id")
    clean = [r.kept for r in marked.where("quality = 1").collect() if len(re.findall(r"\S+", r.text or "")) >= 10]
    assert sum(k is not None for k in clean) >= 0.97 * len(clean)

    single = stages["near duplicates"](spark, good, sf).cache()
    rows = [(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(brute_heads(rows).values()))

    fresh = stages["decontamination"](spark, single, sf).cache()
    rows = [(r.doc_id, r.text) for r in single.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    leaks = {d for d, _ in brute_leaks(rows, items)}
    assert {r.doc_id for r in fresh.collect()} == {d for d, _ in rows} - leaks

    bare = stages["secret scan"](spark, fresh, sf).cache()
    assert bare.columns == docs.columns and bare.count() == fresh.count()
    assert not any(brute_base(r.text or "") for r in bare.collect())

    ids = stages["token ids"](spark, bare, sf)
    path = queries.vocabulary("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in bare.collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for r in ids.collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    assert bpe.WordVocabulary and secrets.KINDS
    assert corpus_pipeline.run(spark, sf).count() == bare.count()


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, names that operators use, and empty tables beside them or alone."""
    long = " ".join(f"word{k} is here" for k in range(40))
    rows = [(None, None, None, "h", 1), (1, None, None, "h", 2), (2, "", "", "", 0), (3, long, "en", "x", None), (3, long, "en", "x", None), (4, long + " end", "en", "x", 3), (None, "another text of some length " + " ".join(f"t{k}" for k in range(30)), "en", "x", 3)]
    schema = "doc_id long, text string, lang string, th string, n_chars int"
    for name, some in (("odd", rows), ("none", [])):
        d = tmp_path / name
        docs = spark.createDataFrame(some, schema)
        docs.write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
        at = docs
        for stage, run in corpus_pipeline.STAGES[:-1]:
            at = run(spark, at, str(d)).cache()
            assert at.columns == docs.columns, stage
        kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in at.collect())
        if some:
            assert corpus_pipeline.run(spark, str(d)).count() == len(kept)
            # texts of under ten words go, one row of the repeated text and its near copy stays, and the one without an id
            assert [i for i, _ in kept] == [-1, 3]
