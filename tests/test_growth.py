"""What must not grow faster than the input: broadcasts, dealt tiles, rows of a hot key."""

import io
import random
import re

import numpy as np
from pyspark.sql import functions as F

from attrisieve.operators import encoding, losses, ranking, runs
from attrisieve.plans import fixtures, registry
from attrisieve.sources import readers


def broadcast_joins(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin \[[^\]]*\]", plan)


def test_tables_that_grow_are_not_broadcast(spark, sf):
    """However small the file of a table is: its products meet their negatives by sorting."""
    for df in (fixtures.examples(spark, sf), registry.queries()["query_split"](spark, sf), registry.queries()["catalogue_hard_negatives"](spark, sf)):
        assert not [j for j in broadcast_joins(df) if re.search(r"\b(key|hard_key|easy_key|place)#", j)]


def test_deleted_queries_are_not_taken_apart(spark):
    """A query without a reference serves as what is left of another, and gives no probes, so it isn't exploded either."""
    queries = spark.createDataFrame([(["a:1", "b:1"], [1.0, 1.0], 1), (["a:1"], [1.0, 0.0], None), (["b:1"], [0.0, 1.0], None), ([], [0.0, 0.0], None)], "conditions array<string>, f array<double>, reference long")
    taken = losses._deletions(queries, F.col("reference").isNotNull())
    assert sorted((r["attribute"], r["b"]) for r in taken.collect()) == [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    products = spark.createDataFrame([(1, ["a", "b"], [1.0, 1.0])], "key long, attributes array<string>, f array<double>")
    assert sorted((r["reference"], r["attribute"], r["beta"]) for r in losses.probes_with_intercept(queries, products).collect()) == [(1, "a", 0.0), (1, "b", 0.0)]


def test_ranking_over_many_tiles_and_rounds(spark, monkeypatch):
    """Tiles, rounds, blocks and sampled columns give what a plain sort gives, ties included, and so do hits of a group."""
    for name, value in {"BASE_TILE": 37, "QUERY_BLOCK": 8, "CORPUS_BLOCK": 64, "LISTED": 90, "SAMPLED": 3}.items():
        monkeypatch.setattr(ranking, name, value)
    rng = np.random.default_rng(1)
    vectors = rng.integers(-2, 3, (300, 3)).astype(float)  # many equal cosines, some without length
    labels = [None if i % 11 == 0 else i % 4 for i in range(300)]
    rows = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(zip(vectors.tolist(), labels, strict=True))], "corpus_id long, v array<float>, group int")
    queries = rows.where("corpus_id < 21").withColumnRenamed("corpus_id", "query_id")
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, length, out=np.full_like(vectors, np.nan), where=length > 0)
    scores = np.einsum("id,jd->ij", unit, unit).round(ranking.DECIMALS)
    for k in (1, 10, 60):
        wanted = {q: [c for _, c in sorted((-scores[q, c], c) for c in range(300) if c != q and not np.isnan(scores[q, c]))[:k]] for q in range(21)}
        found, hits = {}, {}
        for r in ranking.top_k(queries, rows, k, True).orderBy("rank").collect():
            found.setdefault(r["query_id"], []).append(r["corpus_id"])
        assert found == {q: w for q, w in wanted.items() if w}
        for r in ranking.group_hits(queries, rows, k, True).orderBy("rank").collect():
            hits.setdefault(r["query_id"], []).append((r["rank"], r["hit"]))
        own = {q: [n + 1 for n, c in enumerate(w) if labels[q] is not None and labels[c] == labels[q]] for q, w in wanted.items()}
        assert hits == {q: [(r, h + 1) for h, r in enumerate(o)] for q, o in own.items() if o}


def test_equal_vectors_are_ranked_once(spark, monkeypatch):
    """Encoded texts often have equal vectors; each is compared once, and lists are those of all texts, ties and members cut off included."""
    rng = np.random.default_rng(2)
    vectors = rng.integers(-1, 2, (240, 3)).astype(float)  # 27 different ones, one without length, some in one direction
    vectors[:40] *= 2
    base = spark.createDataFrame([(int(i), None if i % 31 == 0 else v) for i, v in zip(rng.permutation(240), vectors.tolist(), strict=True)], "corpus_id long, v array<double>")
    queries = base.where("corpus_id < 90").withColumnRenamed("corpus_id", "query_id")
    seen = []
    for k in (1, 7, 100):
        wanted = sorted(tuple(r) for r in ranking.top_k(queries, base, k).select("query_id", "corpus_id", "rank", "score").collect())
        with monkeypatch.context() as m:
            m.setattr(ranking, "top_k", lambda q, b, k, plain=ranking.top_k: seen.append((q.count(), b.count())) or plain(q, b, k))
            kinds, ranked = ranking.top_k_by_kind(queries, base, k)
        assert sorted(tuple(r) for r in kinds.join(ranked, "kind").select("query_id", "corpus_id", "rank", "score").collect()) == wanted
        assert kinds.count() == queries.where("v is not null").count()
    different = [df.where("v is not null").select("v").distinct().count() for df in (queries, base)]
    assert seen == [tuple(different)] * 3 and different[1] < 60


def test_encoded_metrics_compares_different_vectors(spark, monkeypatch):
    """Two hundred texts of which many have one vector: as many are ranked as vectors differ."""
    dealt = []
    monkeypatch.setattr(ranking.tiles, "deal", lambda rows, *more, deal=ranking.tiles.deal: dealt.append(rows.count()) or deal(rows, *more))
    words = ["red", "blue", "green", "small"]
    rows = spark.createDataFrame([(i, f"{words[i % 4]} {' ' * (i // 4)}", words[i % 4] + " " * i, words[(i + 1) % 4] + " " * i) for i in range(100)], "row_id long, anchor string, positive string, negative string")
    found = {(r["query_id"], r["k"]): r["recall"] for r in ranking.encoded_metrics(rows, encoding.stand_in, (1, 50)).collect()}
    assert sorted(dealt) == [4, 4] and len(found) == 200
    assert {q for (q, k), recall in found.items() if k == 50 and recall == 1.0} == set(range(100))


def test_vectors_are_sent_to_few_tiles(spark, monkeypatch):
    """There are about as many pairs of tiles as tasks, so a vector is sent no more often when there are more of them."""
    met = []
    monkeypatch.setattr(ranking.tiles, "meet", lambda queries, base, query_tiles, span, *more, meet=ranking.tiles.meet: met.append((query_tiles, span)) or meet(queries, base, query_tiles, span, *more))
    rows = spark.range(9000).select(F.col("id").alias("corpus_id"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    ranking.top_k(rows.withColumnRenamed("corpus_id", "query_id"), rows, 3)
    assert met == [(4, (0, 1))]  # 4 shuffle partitions; it was 5 query tiles by 8 base tiles


def test_driver_holds_no_files_of_run_folders(spark, tmp_path, monkeypatch):
    """Tasks list run folders and read them, long logs in splits; a list of a run's files is never the driver's."""
    monkeypatch.setattr(readers, "SPLIT", 50)
    monkeypatch.setattr(readers, "HANDED", 100)
    for k in range(30):
        folder = tmp_path / f"run-20250101_1-{k}" / "files"
        folder.mkdir(parents=True)
        (folder / "output.log").write_bytes(b"\r\n".join(b"%d {'val/recall@5': %d.5, 'x': None}\r\n" % (n, n) for n in range(k + 1)))
        (folder / ".output.log").write_text("{'val/recall@5': -1.0}")
        (folder / "w-summary.json").write_text('{"recall@10": %d, "recall@5": -1}' % k)
    newer = tmp_path / "run-20250201_1-3" / "files"
    newer.mkdir(parents=True)
    (newer / "output.log").write_text("")  # holds nothing, so the older folder counts
    listed = spark.createDataFrame([(str(k),) for k in range(0, 31, 3)], "run_id string")
    for base in (str(tmp_path), f"file:{tmp_path}/"):
        table = runs.read_recalls(spark, base, listed)
        assert not [f for f in table.inputFiles() if "run-" in f] and not broadcast_joins(table)
        assert {r["run_id"]: (r["recall_at_5"], r["recall_at_10"]) for r in table.collect()} == {str(k): (k + 0.5, float(k)) if k < 30 else (None, None) for k in range(0, 31, 3)}


def test_lines_of_splits():
    """Every line is in one split, wherever splits are cut and whatever ends lines."""
    draw = random.Random(1)
    for _ in range(500):
        data, step = bytes(draw.choice(b"ab\r\n\n") for _ in range(draw.randrange(1, 30))), draw.randrange(1, 9)
        lines = [x for at in range(0, len(data), step) for x in readers.lines_from(io.BytesIO(data), at, at + step) if x]
        assert lines == [x for x in re.split(rb"[\r\n]+", data) if x]
