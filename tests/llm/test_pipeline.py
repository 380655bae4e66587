"""The pipeline against a version without Spark's operators' shortcuts."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attrisieve.llm import decontaminate, nearcopies, packing, simhash, toxicity
from attrisieve.llm.common import table


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_of(rows):
    """Indices of the rows that stay: one of each group of texts with a five-word similarity of 0.8 or more."""
    sets = [shingle_set(r["text"]) for r in rows]
    root = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]), key=lambda k: rows[k]["doc_id"])
            root = [low if x == high else x for x in root]
    return [i for i, x in enumerate(root) if i == x]


def test_stages_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    chain = toxicity.fit(docs, table(spark, sf, "labels"))
    at = chain.categories.index(toxicity.DECIDES)
    rows = [r for r in docs.orderBy("doc_id").collect() if chain.predict([r["text"]])[0, at] < 0.5]
    rows = [rows[i] for i in kept_of(rows)]
    bench = decontaminate.Block([(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()], 5)
    rows = [r for r in rows if next(bench.match(bench.number(r["text"]), 0.5), None) is None]
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert set(got["doc_id"]) == {r["doc_id"] for r in rows}
    assert got["sequence_id"].nunique() == -(-got["length"].sum() // packing.CAPACITY)


def test_stages_on_odd_rows(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, "two words", None, None, None), (900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (900_003, "word " * 30_000, "en", "s", 1), (900_003, "word " * 30_000, "en", "s", 1)], docs.schema)
    odd = odd.withColumn("rank", F.lit(1)).withColumn("text_key", F.lit("x")).withColumn("shard", F.lit(2)).withColumn("toxic", F.lit(None).cast("int"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns
        assert got.count() == (3 if name == "simhash_near_dedup" else 5)
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, sf).toPandas()
    assert packed["length"].sum() == 3 + 1 + 1 + 2 * 30_001


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("tree_rows", [nearcopies.TREE_ROWS, 4])
def test_near_dedup_equals_brute_force_similarity(spark, sf, monkeypatch, tree_rows):
    monkeypatch.setattr(nearcopies, "TREE_ROWS", tree_rows)  # 4: shards are cut into sub-trees
    base = [r["text"].split() for r in table(spark, sf, "documents").collect() if 60 <= len((r["text"] or "").split()) <= 600][:12]
    edit = lambda words, step: " ".join("changed" + str(k) if k % step == 7 else w for k, w in enumerate(words))
    texts = [" ".join(w) for w in base] + [edit(w, step) for w in base for step in (30, 42, 47, 51, 60, 110)] + ["", None, "two words", "Two  words"]
    schema = table(spark, sf, "documents").schema
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], schema)

    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    apart = sum((simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 3 for a, b in pairs)
    assert apart > 20  # links that SimHash within 3 bits doesn't see
    got = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, sf).collect()}
    assert got == set(kept_of([{"doc_id": i, "text": t} for i, t in enumerate(texts)]))
