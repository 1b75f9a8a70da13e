"""The pipeline's near-duplicate stage against a brute-force version."""

import random

import corpus_pipeline
import pytest
from quadloom.llm import queries, similar

from .test_operators import WORD


def brute_set(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return {tuple(words[k : k + 5]) for k in range(max(min(1, len(words)), len(words) - 4))}


def brute_heads(rows):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x == y or len(x & y) >= 0.8 * len(x | y):
                parent[find(a)] = find(b)
    return {i: min(rows[k][0] for k in range(len(rows)) if find(k) == find(n)) for n, (i, _) in enumerate(rows)}


def grown(n_copies):
    """An original, copies of it that are not near one another, chains, and texts that share half their words."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    base = [word() for _ in range(200)]
    texts = [base]
    for k in range(n_copies):
        copy = list(base)
        for p in rnd.sample(range(5, 195), 4):
            copy[p] = word()
        texts.append(copy)
    for _ in range(6):
        copy = list(texts[-1])
        copy[rnd.randrange(200)] = word()
        texts.append(copy)
    texts += [base[:100] + [word() for _ in range(100)] for _ in range(30)]
    rnd.shuffle(texts)
    return [*enumerate(" ".join(t) for t in texts), (900, None), (901, " "), (902, "Two words"), (903, "two  WORDS"), (904, "two")]


@pytest.mark.parametrize("block", [3, similar.BLOCK])
def test_groups_are_those_of_exact_similarity(spark, block):
    rows = grown(40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs, block=block).collect()}
    assert got == brute_heads(rows)


def test_stage_links_by_similarity(spark, sf):
    docs = queries.table(spark, sf, "documents")
    kept = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, sf)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    heads = brute_heads(rows)
    assert heads[177] == 1 and heads[145] == 6  # similarity 0.830 and 0.833
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(heads.values()))


def test_rows_without_text_or_id(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (2, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id) for r in similar.keep_one(docs).collect())
    assert kept == [(False, 2), (False, 3), (True, None), (True, None)]
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def test_full_filters_lose_nothing(spark, monkeypatch):
    """Filters with room for one key let nearly all rows through to the joins; groups and kept rows are the same."""
    monkeypatch.setattr(similar.urls, "FILTER_KEYS", 1)
    rows = grown(7)
    rows += [(1000 + i, t) for i, t in rows[:40]] + [(5000, rows[3][1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = brute_heads(rows)
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()} == heads
    assert sorted(r.doc_id for r in similar.keep_one(docs).collect()) == sorted(set(heads.values()))
    twice = docs.union(docs.where("doc_id < 20"))
    assert sorted(r.doc_id for r in similar.keep_one(twice).collect()) == sorted(set(heads.values()))


def test_balls_find_candidates(spark, monkeypatch):
    """Fingerprints that are equal or at three or fewer bits are candidates, and one that no band finds is still linked."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(1500)]
    texts = [base, [*base, "end"], ["head", *base], base[:700], [f"v{k}" for k in range(90)], []]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = similar.with_keys(docs, "doc_id", "text").cache()
    named = {r.fp: r for r in nodes.collect()}
    met = {(r.a, r.b) for r in similar.met_in_balls(nodes).collect()}
    bits = lambda a, b: ((named[a].print ^ named[b].print) & (1 << 64) - 1).bit_count()
    assert met and all(a < b and bits(a, b) <= 3 for a, b in met)
    reached = {named[x].doc_id for pair in met for x in pair}
    assert reached >= {0, 1, 2} and 5 not in reached

    # keys that meet in no band
    bare = nodes.withColumn("keys", similar.F.expr("array(xxhash64(fp))"))
    monkeypatch.setattr(similar, "with_keys", lambda docs, id_col, text_col: bare)
    got = {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}
