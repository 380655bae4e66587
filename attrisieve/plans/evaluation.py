"""Retrieval evaluation plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..operators import losses, ranking, reshape
from ..session import table
from . import fixtures

#: Cut-offs of the breakdown by query shape.
SHAPE_CUTOFFS = (5, 10, 20)


def vector_ranks(spark: SparkSession, sf: str, k: int, exclude_same_id: bool = True) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return ranking.top_k(v.select(F.col("vec_id").alias("query_id"), "v"), v.select(F.col("vec_id").alias("corpus_id"), "v"), k, exclude_same_id)


def label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every metric at every cut-off per query: all vectors ask, those with the same label are relevant.

    Relevant documents form groups (labels), so a query's hits are found by comparing labels, and how many are relevant is
    a count per label: the pairs within a label are never listed.
    """
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("v"), F.col("label").alias("group"))
    cutoffs = ranking.clamp_cutoffs(ranking.CUTOFFS, v.count())
    hits = ranking.group_hits(v.drop("corpus_id"), v.drop("query_id"), max(cutoffs), True)
    totals = v.groupBy("group").agg((F.count("*") - 1).alias("n_relevant")).where("n_relevant > 0")
    asked = v.join(totals, "group").select("query_id", "n_relevant")
    return ranking.metrics_from_hits(hits, asked, cutoffs)


def shape_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Per query and model: attribute count, distance, and accuracy and recall at the cut-offs.

    Queries are the distinct texts of the generated conjunctions; one that occurs again keeps what it had last. Two stand-in
    models encode them: as the vector at key mod N, and at 3 key + 1 mod N; a positive is the vector at 7 key + 3 mod N.
    """
    n = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    own = fixtures.generated(spark, sf).select("key", "nl_query", "num_attributes", "query_distance", ((F.col("key") * 7 + 3) % n).alias("corpus_id"))
    asked = own.groupBy("nl_query").agg(F.max_by(F.struct("key", "num_attributes", "query_distance"), "key").alias("m")).select("nl_query", "m.*")
    relevant = own.select("nl_query", "corpus_id").distinct()
    totals = relevant.groupBy("nl_query").agg(F.count("*").alias("n_relevant"))
    ranks = vector_ranks(spark, sf, max(SHAPE_CUTOFFS), exclude_same_id=False)
    models = F.array(F.struct(F.lit("direct").alias("model"), (F.col("key") % n).alias("query_id")), F.struct(F.lit("shifted").alias("model"), ((F.col("key") * 3 + 1) % n).alias("query_id")))
    encoded = asked.select("nl_query", "num_attributes", "query_distance", F.inline(models))
    met = encoded.join(relevant, "nl_query").join(ranks.select("query_id", "corpus_id", "rank"), ["query_id", "corpus_id"])
    hits = met.groupBy("model", "nl_query").agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in SHAPE_CUTOFFS])
    joined = encoded.join(totals, "nl_query").join(hits, ["model", "nl_query"], "left")
    h = lambda k: F.coalesce(f"h{k}", F.lit(0))
    accuracy = [F.when(h(k) > 0, 1.0).otherwise(0.0).alias(f"acc_at_{k}") for k in SHAPE_CUTOFFS]
    recall = [(h(k) / F.col("n_relevant")).alias(f"recall_at_{k}") for k in SHAPE_CUTOFFS]
    return joined.select("model", "nl_query", "num_attributes", "query_distance", *accuracy, *recall)


def by_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Means by model and attribute count, by model and distance, and by model, in one pass of grouping sets."""
    rows = shape_rows(spark, sf)
    names = [f"{m}_at_{k}" for m in ("acc", "recall") for k in SHAPE_CUTOFFS]
    sets = [[F.col("model"), F.col("num_attributes")], [F.col("model"), F.col("query_distance")], [F.col("model")]]
    return rows.groupingSets(sets, "model", "num_attributes", "query_distance").agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("n_queries"), F.grouping_id().alias("_g")).withColumn(
        "breakdown", F.when(F.col("_g") == 1, "attributes").when(F.col("_g") == 2, "distance").otherwise("overall")
    ).drop("_g")


SHAPE_SQL = f"""{fixtures.GENERATED_SQL},
n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
own AS (SELECT key, nl_query, num_attributes, query_distance, (key * 7 + 3) % n AS corpus_id FROM generated, n),
asked AS (SELECT nl_query, max(key) AS key, arg_max(num_attributes, key) AS num_attributes, arg_max(query_distance, key) AS query_distance FROM own GROUP BY nl_query),
relevant AS (SELECT DISTINCT nl_query, corpus_id FROM own),
totals AS (SELECT nl_query, count(*) AS n_relevant FROM relevant GROUP BY nl_query),
ranks AS (
  SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS rk
  FROM embeddings q CROSS JOIN embeddings c QUALIFY rk <= 20),
encoded AS (SELECT 'direct' AS model, asked.*, key % n AS query_id FROM asked, n UNION ALL SELECT 'shifted', asked.*, (key * 3 + 1) % n FROM asked, n),
hits AS (
  SELECT model, e.nl_query, {", ".join(f"count(*) FILTER (WHERE rk <= {k}) AS h{k}" for k in SHAPE_CUTOFFS)}
  FROM encoded e JOIN relevant r ON e.nl_query = r.nl_query JOIN ranks k ON k.query_id = e.query_id AND k.corpus_id = r.corpus_id GROUP BY ALL),
shaped AS (
  SELECT e.model, e.nl_query, e.num_attributes, e.query_distance, {", ".join(f"CASE WHEN coalesce(h{k}, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acc_at_{k}, coalesce(h{k}, 0) / n_relevant AS recall_at_{k}" for k in SHAPE_CUTOFFS)}
  FROM encoded e JOIN totals t ON e.nl_query = t.nl_query LEFT JOIN hits h ON h.model = e.model AND h.nl_query = e.nl_query)"""

_MEANS = ", ".join(f"avg({m}_at_{k}) AS {m}_at_{k}" for m in ("acc", "recall") for k in SHAPE_CUTOFFS)
BY_SHAPE_SQL = f"""WITH {SHAPE_SQL}
SELECT model, num_attributes, query_distance, {_MEANS}, count(*) AS n_queries,
       CASE WHEN grouping(num_attributes) = 0 THEN 'attributes' WHEN grouping(query_distance) = 0 THEN 'distance' ELSE 'overall' END AS breakdown
FROM shaped GROUP BY GROUPING SETS ((model, num_attributes), (model, query_distance), (model))"""
SHAPE_ROWS_SQL = f"WITH {SHAPE_SQL} SELECT * FROM shaped"

LABEL_METRICS_SQL = """WITH ranks AS (
  SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, q.label = c.label AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS rk
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id QUALIFY rk <= 1000),
totals AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM embeddings QUALIFY n_relevant > 0),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS hit FROM ranks WHERE rel),
ks AS (SELECT DISTINCT least(k, (SELECT count(*) FROM embeddings)) AS k FROM (VALUES (1), (5), (10), (50), (100), (1000)) t(k)),
agg AS (
  SELECT t.query_id, k, n_relevant, count(h.rk) AS h, min(h.rk) AS r, sum(1 / log2(h.rk + 1)) AS d, sum(h.hit / h.rk) AS p
  FROM totals t CROSS JOIN ks LEFT JOIN hits h ON h.query_id = t.query_id AND h.rk <= ks.k GROUP BY ALL)
SELECT query_id, CAST(k AS INTEGER) AS k, CASE WHEN h > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy, h / n_relevant AS recall, h / k AS precision, coalesce(1 / r, 0.0::DOUBLE) AS mrr,
       coalesce(d, 0) / list_sum(list_transform(range(1, least(k, n_relevant) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(p, 0) / least(k, n_relevant) AS map
FROM agg"""


def encoded_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with stand-in vectors: q at key mod N, p and n at products' keys times 7 plus 3 mod N; labels scaled."""
    n = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    ex = fixtures.examples(spark, sf)
    hard = ex.select("key", F.col("hard_key").alias("other"), "query_distance", F.lit(False).alias("easy"))
    easy = ex.select("key", F.col("easy_key").alias("other"), F.lit(-1).alias("query_distance"), F.lit(True).alias("easy"))
    rows = hard.unionByName(easy).withColumn("label", reshape.label(F.col("query_distance").cast("double"), 15.0, 25.0))
    v = table(spark, sf, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"))
    place = {"q": F.col("key") % n, "p": (F.col("key") * 7 + 3) % n, "n": (F.col("other") * 7 + 3) % n}
    for name, at in place.items():
        rows = rows.withColumn(f"{name}_at", at).join(v.select(F.col("vec_id").alias(f"{name}_at"), F.col("v").alias(name)), f"{name}_at")
    return losses.with_cosines(rows)


ENCODED_SQL = f"""{fixtures.EXAMPLES_SQL}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
lab AS (
  SELECT key, hard_key AS other, false AS easy, CAST(query_distance / 25.0 AS FLOAT) AS label FROM examples UNION ALL SELECT key, easy_key, true, CAST(15.0 / 25.0 AS FLOAT) FROM examples),
enc AS (
  SELECT l.*, q.embedding::DOUBLE[] AS q, p.embedding::DOUBLE[] AS p, m.embedding::DOUBLE[] AS m, list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS pos_sim, list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS neg_sim
  FROM lab l, n JOIN embeddings q ON q.vec_id = l.key % n JOIN embeddings p ON p.vec_id = (l.key * 7 + 3) % n JOIN embeddings m ON m.vec_id = (l.other * 7 + 3) % n)"""
