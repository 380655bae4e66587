"""The logical tables of the engine, derived from the fixture tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sampling import merge_join
from ..functions.vectors import doubles
from ..operators import attributes, catalogue
from ..session import table

SEED = 42


def judged(spark: SparkSession, sf: str) -> DataFrame:
    """Judged product rows: labelled documents; the source stands for the query."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    esci = F.when(F.col("quality") == 1, "Exact").when(F.col("toxic") == 1, "Irrelevant").otherwise("Substitute")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("query_id"), F.col("source").alias("query"), F.col("doc_id").cast("string").alias("product_id"), F.substring("text", 1, 40).alias("product_title"),
        F.col("text").alias("product_text"), F.when(F.col("lang") == "en", "us").otherwise(F.col("lang")).alias("product_locale"), esci.alias("esci_label"), "lang",
    )


JUDGED_SQL = """judged AS (
  SELECT d.doc_id AS row_id, d.source AS query_id, d.source AS query, CAST(d.doc_id AS VARCHAR) AS product_id, substr(d.text, 1, 40) AS product_title, d.text AS product_text,
         CASE WHEN d.lang = 'en' THEN 'us' ELSE d.lang END AS product_locale, d.lang,
         CASE WHEN l.quality = 1 THEN 'Exact' WHEN l.toxic = 1 THEN 'Irrelevant' ELSE 'Substitute' END AS esci_label
  FROM documents d JOIN labels l USING (doc_id))"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue records: key, category (second word of the name), color (first word), attributes."""
    words = F.split("p_name", " ")
    size = F.concat(F.lit("size "), F.floor((F.col("p_size") - 1) / 10).cast("string"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_partkey").alias("product_id"), F.get(words, F.lit(1)).alias("category"), F.get(words, F.lit(0)).alias("color"), F.array(F.get(words, F.lit(0)), "p_brand", "p_type", size).alias("attributes"),
    )


PARTS_SQL = """parts AS (
  SELECT p_partkey AS key, p_partkey AS product_id, split_part(p_name, ' ', 2) AS category, split_part(p_name, ' ', 1) AS color,
         [split_part(p_name, ' ', 1), p_brand, p_type, 'size ' || CAST(floor((p_size - 1) / 10) AS INTEGER)] AS attributes FROM part)"""


def draw_sql(key: str, name: str) -> str:
    return f"('0x' || substr(md5('{SEED}:' || {key} || ':{name}'), 1, 8))::BIGINT"


HARD_SQL = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY key) - 1 AS place, count(*) OVER (PARTITION BY category) AS n FROM parts),
hard AS (
  SELECT a.key, b.key AS hard_key FROM (
    SELECT key, category, CASE WHEN pick >= place THEN pick + 1 ELSE pick END AS place FROM (SELECT *, {draw_sql("key", "hard_key")} % (n - 1) AS pick FROM ranked WHERE n > 1)) a
  JOIN ranked b ON a.category = b.category AND a.place = b.place)"""


def bucket_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Products beside their hard negative, with the four buckets of their attributes."""
    own = parts(spark, sf)
    hard = catalogue.hard_negatives(own, SEED)
    vocabulary = own.select(F.explode("attributes").alias("a")).distinct().agg(F.sort_array(F.collect_list("a")).alias("vocabulary"))
    other = own.select(F.col("key").alias("hard_key"), F.col("attributes").alias("b"))
    both = merge_join(merge_join(own, hard, "key"), other, "hard_key").join(F.broadcast(vocabulary))  # one row: a few dozen attributes
    a, b = F.col("attributes"), F.col("b")
    return both.select(
        "key", "hard_key", F.col("category").alias("item"), "attributes", "b", attributes.common(a, b).alias("full_common"), attributes.only_first(a, b).alias("full_pos"), attributes.only_first(b, a).alias("full_neg"), attributes.neither(a, b, F.col("vocabulary")).alias("full_neither"),
    )


BUCKETS_SQL = f"""{PARTS_SQL}, {HARD_SQL},
vocabulary AS (SELECT list_sort(list(DISTINCT a)) AS v FROM (SELECT unnest(attributes) AS a FROM parts)),
pairs AS (
  SELECT h.key, h.hard_key, p.category AS item, p.attributes, o.attributes AS b,
         list_filter(p.attributes, lambda x: list_contains(o.attributes, x)) AS full_common, list_filter(p.attributes, lambda x: NOT list_contains(o.attributes, x)) AS full_pos,
         list_filter(o.attributes, lambda x: NOT list_contains(p.attributes, x)) AS full_neg,
         list_filter(v, lambda x: NOT list_contains(p.attributes, x) AND NOT list_contains(o.attributes, x)) AS full_neither
  FROM hard h JOIN parts p ON h.key = p.key JOIN parts o ON h.hard_key = o.key CROSS JOIN vocabulary)"""


def generated(spark: SparkSession, sf: str) -> DataFrame:
    """A conjunction per product; row_id is its key."""
    return attributes.generate_queries(bucket_pairs(spark, sf), "key", SEED).withColumn("row_id", F.col("key"))


def _sample_sql(bucket: str) -> str:
    return f"list_transform(list_sort(list_transform(range(len(full_{bucket})), lambda i: {{'k': md5('{SEED}:' || key || ':{bucket}:' || i), 'v': full_{bucket}[i + 1]}})), lambda t: t.v)[1:n_{bucket}] AS selected_{bucket}"


GENERATED_SQL = f"""{BUCKETS_SQL},
g1 AS (SELECT *, CAST(1 + {draw_sql("key", "target")} % 10 AS INTEGER) AS target FROM pairs),
g2 AS (SELECT *, least({draw_sql("key", "pos")} % (target + 1), len(full_pos)) AS p0, least({draw_sql("key", "common")} % (target + 1), len(full_common)) AS c0, least({draw_sql("key", "neither")} % (target + 1), len(full_neither)) AS e0 FROM g1),
g3 AS (SELECT *, least(target - p0, len(full_neg)) AS n0 FROM g2),
g4 AS (SELECT *, CASE WHEN p0 = 0 AND c0 = 0 THEN least(1, len(full_pos)) ELSE p0 END AS n_pos, CASE WHEN p0 = 0 AND c0 = 0 AND len(full_pos) = 0 THEN least(1, len(full_common)) ELSE c0 END AS n_common,
         CASE WHEN n0 = 0 AND e0 = 0 THEN least(1, len(full_neg)) ELSE n0 END AS n_neg, CASE WHEN n0 = 0 AND e0 = 0 AND len(full_neg) = 0 THEN least(1, len(full_neither)) ELSE e0 END AS n_neither FROM g3),
g5 AS (SELECT *, {", ".join(_sample_sql(b) for b in attributes.BUCKETS)} FROM g4),
g6 AS (SELECT *, list_concat(selected_pos, selected_common) AS required, list_concat(selected_neg, selected_neither) AS forbidden FROM g5),
generated AS (
  SELECT *, key AS row_id, 'I am looking for: "' || item || '" that has: ' || coalesce(array_to_string(required, ', '), '') || '; and does not have: ' || coalesce(array_to_string(forbidden, ', '), '') AS nl_query,
         CAST(len(selected_pos) + len(selected_neg) AS INTEGER) AS query_distance, CAST(len(required) + len(forbidden) AS INTEGER) AS num_attributes FROM g6)"""


def examples(spark: SparkSession, sf: str) -> DataFrame:
    """Generated examples with texts of the positive, the hard and an easy negative, ready to become training rows."""
    own = generated(spark, sf)
    easy = catalogue.easy_negatives(parts(spark, sf), SEED)
    text = lambda c: F.concat(F.lit("product "), F.col(c).cast("string"))
    return merge_join(own, easy, "key").select("row_id", F.col("item").alias("original_query"), "nl_query", F.lit(None).cast("string").alias("rephrased_query"), text("key").alias("positive_text"), text("hard_key").alias("hard_text"), text("easy_key").alias("easy_text"), F.lit("hard").alias("negative_example_source"), "query_distance", "key", "hard_key", "easy_key")


EXAMPLES_SQL = f"""{GENERATED_SQL},
blocks AS (SELECT category, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(count(*)) OVER () AS total FROM parts GROUP BY category),
numbered AS (SELECT r.key, r.category, b.start + r.place AS place, b.start, b.n, b.total FROM ranked r JOIN blocks b USING (category)),
easy AS (
  SELECT w.key, x.key AS easy_key FROM (SELECT key, CASE WHEN pick >= start THEN pick + n ELSE pick END AS place FROM (SELECT *, {draw_sql("key", "easy")} % (total - n) AS pick FROM numbered WHERE total > n)) w
  JOIN numbered x ON w.place = x.place),
examples AS (
  SELECT row_id, item AS original_query, nl_query, 'product ' || g.key AS positive_text, 'product ' || hard_key AS hard_text, 'product ' || easy_key AS easy_text, 'hard' AS negative_example_source, query_distance, g.key, hard_key, easy_key
  FROM generated g JOIN easy e ON g.key = e.key),
rows_ AS (
  SELECT row_id, original_query, nl_query, positive_text AS positive_example, hard_text AS negative_example, negative_example_source, CAST(query_distance AS DOUBLE) AS query_distance FROM examples
  UNION ALL
  SELECT row_id, original_query, nl_query, positive_text, easy_text, 'random', -1.0::DOUBLE FROM examples),
anchored AS (SELECT row_id, nl_query AS anchor, positive_example AS positive, negative_example AS negative, negative_example_source, query_distance FROM rows_ WHERE positive_example <> negative_example)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("v"), "label")


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """history(run_id, metric, value, step struct, knob)."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("metric"), "value", F.struct("ts", "event_id").alias("step"), F.get_json_object("props", "$.k").cast("int").alias("knob"))


HISTORY_SQL = "history AS (SELECT user_id AS run_id, event_type AS metric, value, ts, event_id, CAST(props->>'$.k' AS INTEGER) AS knob FROM events)"
RUN_GROUPS = ("sweep_a", "sweep_b", "other")


def run_table(spark: SparkSession, sf: str) -> DataFrame:
    """runs(run_id, name, group, created_at, config): names carry a size and a multiplier, as experiment names do."""
    first = run_history(spark, sf).groupBy("run_id").agg(F.min_by("knob", "step").alias("knob"), F.min("step.ts").alias("t"))
    r = F.col("run_id")
    group = F.element_at(F.array(*[F.lit(g) for g in RUN_GROUPS]), (r % 3 + 1).cast("int"))
    mark = F.when(r % 4 == 0, F.concat(F.lit("_baseline_"), F.repeat(F.lit("x"), (r % 5).cast("int")))).otherwise(F.concat(F.lit("_synthetic_multiplier-"), (r % 7 / 2.0).cast("string"), F.lit("_run")))
    style = F.when(r % 2 == 0, "ours-mse").otherwise("triplet")
    name = F.concat(style, F.lit("_"), ((r % 3 + 1) * 1000).cast("string"), mark)
    config = F.create_map(F.lit("V"), (F.col("knob") % 5 * 5 + 5).cast("string"), F.lit("style"), F.when(r % 6 == 0, "").otherwise(style))
    return first.select("run_id", name.alias("name"), group.alias("group"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), config.alias("config"))


RUNS_SQL = f"""{HISTORY_SQL}, firsts AS (SELECT run_id, arg_min(knob, (ts, event_id)) AS knob, min(ts) AS t FROM history GROUP BY run_id),
runs AS (
  SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'ours-mse' ELSE 'triplet' END || '_' || CAST((run_id % 3 + 1) * 1000 AS VARCHAR)
         || CASE WHEN run_id % 4 = 0 THEN '_baseline_' || repeat('x', CAST(run_id % 5 AS INTEGER)) ELSE '_synthetic_multiplier-' || CAST(CAST(run_id % 7 / 2.0 AS DOUBLE) AS VARCHAR) || '_run' END AS name,
         ['sweep_a', 'sweep_b', 'other'][CAST(run_id % 3 + 1 AS INTEGER)] AS "group", strftime(t, '%Y-%m-%dT%H:%M:%S') AS created_at, t,
         CAST(knob % 5 * 5 + 5 AS VARCHAR) AS v, CASE WHEN run_id % 6 = 0 THEN '' WHEN run_id % 2 = 0 THEN 'ours-mse' ELSE 'triplet' END AS style FROM firsts)"""
