"""Every query of the engine by name, and the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sampling import merge_join

from ..operators import attributes, boolean, catalogue, costs, language, losses, mining, models, profiling, ranking, reshape, runs, splits
from ..session import shared_dir, table
from ..streaming import metrics as streaming
from . import evaluation, fixtures, round_trips
from .fixtures import BUCKETS_SQL, EXAMPLES_SQL, GENERATED_SQL, HARD_SQL, HISTORY_SQL, JUDGED_SQL, PARTS_SQL, RUNS_SQL, SEED, draw_sql

_Q: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _joined(c: str):
    return F.array_join(F.array_sort(c), "|").alias(c)


def _joined_sql(c: str) -> str:
    return f"coalesce(array_to_string(list_sort({c}), '|'), '') AS {c}"


@_query(f"WITH {JUDGED_SQL} SELECT esci_label, count(*) AS n FROM judged WHERE product_locale = 'us' GROUP BY 1")
def mining_label_counts(spark, sf):
    return mining.label_counts(fixtures.judged(spark, sf))


_PAIRED = """own AS (SELECT * FROM judged WHERE product_locale = 'us'), exact AS (SELECT query_id, min(row_id) AS exact_id FROM own WHERE esci_label = 'Exact' GROUP BY 1),
paired AS (SELECT o.*, e.exact_id FROM own o JOIN exact e USING (query_id) WHERE esci_label IN ('Substitute', 'Irrelevant'))"""


@_query(f"WITH {JUDGED_SQL}, {_PAIRED} SELECT (SELECT count(*) FROM own) AS rows, (SELECT count(*) FROM paired) AS kept, (SELECT count(*) FROM paired) / (SELECT count(*) FROM own) AS share")
def mining_reduction(spark, sf):
    return mining.reduction(fixtures.judged(spark, sf))


@_query(f"""WITH {JUDGED_SQL}, {_PAIRED}, pool AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS n FROM own WHERE lang = 'en'),
kept AS (SELECT p.*, {draw_sql("p.row_id", "easy")} % (SELECT max(n) FROM pool) AS place FROM paired p JOIN judged e ON e.row_id = p.exact_id WHERE p.lang = 'en' AND e.lang = 'en')
SELECT k.row_id, k.query, k.exact_id AS positive_id, e.product_title AS positive_title, k.product_id AS hard_id, length(k.product_text) AS hard_chars, o.product_id AS easy_id, k.esci_label AS negative_example_source
FROM kept k JOIN pool o ON o.place = k.place JOIN judged e ON e.row_id = k.exact_id""")
def mining_triplets(spark, sf):
    t = mining.triplets(fixtures.judged(spark, sf), SEED)
    return t.select("row_id", "query", F.col("positive_product.product_id").cast("bigint").alias("positive_id"), F.col("positive_product.product_title").alias("positive_title"), F.col("hard_neg_product.product_id").alias("hard_id"),
                    F.length("hard_neg_product.product_text").cast("bigint").alias("hard_chars"), F.col("easy_neg_product.product_id").alias("easy_id"), "negative_example_source")


@_query(f"WITH {JUDGED_SQL} SELECT product_locale, esci_label, count(*) AS n, min(row_id) AS first_row FROM judged WHERE row_id < 500 GROUP BY ALL")
def scan_prefix(spark, sf):
    """A scan of the first 500 source rows, the limit asked for, before other filters."""
    return mining.first_rows(fixtures.judged(spark, sf), 500).groupBy("product_locale", "esci_label").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@_query(f"WITH {BUCKETS_SQL} SELECT key, hard_key, item, {', '.join(_joined_sql(f'full_{b}') for b in attributes.BUCKETS)} FROM pairs")
def attribute_buckets(spark, sf):
    return fixtures.bucket_pairs(spark, sf).select("key", "hard_key", "item", *[_joined(f"full_{b}") for b in attributes.BUCKETS])


@_query(f"WITH {GENERATED_SQL} SELECT key, target, nl_query, query_distance, num_attributes FROM generated")
def generated_queries(spark, sf):
    return fixtures.generated(spark, sf).select("key", "target", "nl_query", "query_distance", "num_attributes")


_DIST = "len(list_filter(required, lambda x: NOT list_contains({a}, x))) + len(list_filter(forbidden, lambda x: list_contains({a}, x)))"


@_query(f"""WITH {GENERATED_SQL} SELECT key, hard_key, CAST({_DIST.format(a="attributes")} AS INTEGER) AS own_distance, CAST({_DIST.format(a="b")} AS INTEGER) AS hard_distance,
({_DIST.format(a="attributes")}) = 0 AS own_fits, ({_DIST.format(a="b")}) = 0 AS hard_fits, query_distance FROM generated""")
def conjunctive_distance(spark, sf):
    g = fixtures.generated(spark, sf)
    r, f = F.col("required"), F.col("forbidden")
    return g.select("key", "hard_key", attributes.distance(F.col("attributes"), r, f).alias("own_distance"), attributes.distance(F.col("b"), r, f).alias("hard_distance"),
                    attributes.satisfies(F.col("attributes"), r, f).alias("own_fits"), attributes.satisfies(F.col("b"), r, f).alias("hard_fits"), "query_distance")


@_query(f"""WITH {GENERATED_SQL} SELECT CASE WHEN list_contains(attributes, a) THEN 1 ELSE 0 END AS present, CASE WHEN list_contains(required, a) THEN 1 ELSE -1 END AS sign, count(*) AS n,
sum(CASE WHEN list_contains(required, a) <> list_contains(attributes, a) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS violated
FROM (SELECT attributes, required, unnest(list_concat(required, forbidden)) AS a FROM generated) GROUP BY ALL""")
def condition_violations(spark, sf):
    """The violation of every condition of every query by its own product, by polarity."""
    g = fixtures.generated(spark, sf).select("attributes", "required", F.explode(F.concat("required", "forbidden")).alias("a"))
    z, s = F.when(F.array_contains("attributes", F.col("a")), 1).otherwise(0), F.when(F.array_contains("required", F.col("a")), 1).otherwise(-1)
    return g.select(z.alias("present"), s.alias("sign")).groupBy("present", "sign").agg(F.count("*").alias("n"), F.sum(attributes.violation(F.col("sign"), F.col("present"))).cast("double").alias("violated"))


@_query(f"WITH {GENERATED_SQL} SELECT key, CAST({_DIST.format(a='b')} AS INTEGER) AS distance FROM generated")
def brute_force_distance(spark, sf):
    """Distances of hard negatives by trying every assignment, for all queries; the SQL is the closed form."""
    conditions = F.concat("required", "forbidden")
    rows = fixtures.generated(spark, sf).select("key", F.transform(conditions, lambda a: F.array_contains(F.col("b"), a)).alias("features"), F.transform(conditions, lambda a: F.when(F.array_contains(F.col("required"), a), 1).otherwise(-1)).alias("signs"))
    return attributes.brute_force_distance(rows, "key", "features", "signs")


@_query(f"WITH {GENERATED_SQL} SELECT key, CAST(len(list_filter(selected_pos, lambda x: NOT list_contains(b, x))) + len(list_filter(selected_neg, lambda x: list_contains(b, x) AND NOT list_contains(attributes, x))) AS INTEGER) AS difference FROM generated")
def signed_difference(spark, sf):
    """Sum over conditions of sign times the change of its attribute from the hard negative to the product."""
    g = fixtures.generated(spark, sf)
    conditions = F.concat("required", "forbidden")
    has = lambda c: F.transform(conditions, lambda a: F.when(F.array_contains(F.col(c), a), 1).otherwise(0))
    signs = F.transform(conditions, lambda a: F.when(F.array_contains(F.col("required"), a), 1).otherwise(-1))
    return g.select("key", attributes.signed_difference(signs, has("attributes"), has("b")).alias("difference"))


@_query(f"""WITH {BUCKETS_SQL}, bits AS (SELECT a, a & 1 <> 0 AS z0, a & 2 <> 0 AS z1, a & 4 <> 0 AS z2, a & 8 <> 0 AS z3 FROM range(16) t(a)),
ok AS (SELECT a FROM bits WHERE NOT z0 OR (z1 AND (NOT z2 OR z3))),
own AS (SELECT key, attributes, list_sum(list_transform(range(4), lambda i: CASE WHEN list_contains(b, attributes[i + 1]) THEN 1 << i ELSE 0 END))::BIGINT AS z FROM pairs)
SELECT key, CAST((SELECT min(bit_count(xor(a, z))) FROM ok) AS INTEGER) AS distance,
'not ' || attributes[1] || ' or ( ( ( ' || attributes[2] || ' and ( ( not ' || attributes[3] || ' ) or ( ' || attributes[4] || ' ) ) ) ) )' AS expression FROM own""")
def random_boolean_distance(spark, sf):
    """Distances to a random Boolean expression over the first four attributes' presence in the hard negative."""
    tokens = boolean.random_tokens(4, SEED)
    rows = fixtures.bucket_pairs(spark, sf).select("key", F.transform("attributes", lambda a: F.array_contains(F.col("b"), a)).alias("z"), "attributes")
    told = rows.select("key", boolean.to_text(F.array(*[F.lit(t) for t in tokens]), F.col("attributes")).alias("expression"))
    return boolean.edit_distances(rows, "key", "z", 4, boolean.to_sql(tokens, "z")).join(told, "key")


@_query(f"WITH {EXAMPLES_SQL} SELECT row_id, original_query, nl_query, positive_example, negative_example, negative_example_source, query_distance FROM rows_")
def training_rows(spark, sf):
    return reshape.training_rows(fixtures.examples(spark, sf)).drop("rephrased_query")


def _anchored(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.anchors(reshape.training_rows(fixtures.examples(spark, sf)), "nl_query", drop_blank=True)


@_query(f"WITH {EXAMPLES_SQL}, l AS (SELECT negative_example_source, CAST(CASE WHEN query_distance = -1 THEN 15.0 ELSE query_distance END / 25.0 AS FLOAT) AS label, query_distance FROM anchored) SELECT negative_example_source, label, count(*) AS n, CAST(count_if(query_distance = -1) AS BIGINT) AS sentinels FROM l GROUP BY ALL")
def label_scaling(spark, sf):
    rows = _anchored(spark, sf).withColumn("label", reshape.label(F.col("query_distance"), 15.0, 25.0))
    return rows.groupBy("negative_example_source", "label").agg(F.count("*").alias("n"), F.count_if(F.col("query_distance") == -1).alias("sentinels"))


@_query(f"""WITH {EXAMPLES_SQL}, l AS (SELECT *, CAST(CASE WHEN query_distance = -1 THEN 15.0 ELSE query_distance END / 25.0 AS FLOAT) AS label FROM anchored)
SELECT row_id, anchor AS "sentence_A", positive AS "sentence_B", 1.0::FLOAT AS label FROM l UNION ALL SELECT row_id, anchor, negative, CAST(1 - label AS FLOAT) FROM l""")
def training_pairs(spark, sf):
    rows = _anchored(spark, sf).withColumn("label", reshape.label(F.col("query_distance"), 15.0, 25.0))
    return reshape.pairs(rows)


_SHUFFLED = f"shuffled AS (SELECT anchor, row_number() OVER (ORDER BY md5('{SEED}:' || anchor), anchor) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT anchor FROM anchored))"


@_query(f"""WITH {EXAMPLES_SQL}, {_SHUFFLED}, s AS (SELECT a.*, CASE WHEN place < ceil(ceil(n / 5) / 2) THEN 'test' WHEN place < ceil(n / 5) THEN 'validation' ELSE 'train' END AS split FROM anchored a JOIN shuffled USING (anchor))
SELECT row_id, anchor, negative_example_source, split FROM s""")
def query_split(spark, sf):
    return splits.split_by_query(_anchored(spark, sf), SEED).select("row_id", "anchor", "negative_example_source", "split")


@_query(f"WITH {EXAMPLES_SQL}, {_SHUFFLED} SELECT row_id, anchor, negative_example_source FROM anchored JOIN shuffled USING (anchor) WHERE place < greatest(1, round_even(n * 0.3, 0))")
def query_fraction(spark, sf):
    """Rows of a seeded 0.3 of the queries, which is what the operator is for."""
    return splits.query_fraction(_anchored(spark, sf), 0.3, SEED).select("row_id", "anchor", "negative_example_source")


@_query(f"""WITH RECURSIVE {JUDGED_SQL}, r AS (SELECT row_id, query_id || '/' || product_title AS query, md5(product_text) AS product FROM judged),
reach AS (SELECT DISTINCT product, product AS root FROM r UNION SELECT y.product, w.root FROM reach w JOIN r x ON x.product = w.product JOIN r y ON y.query = x.query),
roots AS (SELECT product, 'product=' || min(root) AS root FROM reach GROUP BY product),
u AS (SELECT r.*, ('0x' || substr(md5('{SEED}:' || coalesce(root, '')), 1, 8))::BIGINT / 4294967296 AS u FROM r LEFT JOIN roots USING (product))
SELECT row_id, query, product, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'validation' ELSE 'test' END AS split FROM u""")
def leakage_free_split(spark, sf):
    """Judged rows split by components over query and product text; no value is in two splits."""
    rows = fixtures.judged(spark, sf).select("row_id", F.concat("query_id", F.lit("/"), "product_title").alias("query"), F.md5(F.col("product_text").cast("binary")).alias("product"))
    return splits.split_without_leakage(rows, ["query", "product"], SEED).select("row_id", "query", "product", "split")


@_query(f"""WITH {EXAMPLES_SQL}, docs AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS corpus_id FROM (SELECT positive AS text FROM anchored UNION SELECT negative FROM anchored)),
ids AS (SELECT anchor, row_number() OVER (ORDER BY min(row_id)) - 1 AS query_id FROM anchored GROUP BY anchor)
SELECT DISTINCT i.query_id, d.corpus_id, a.anchor, a.positive AS text FROM anchored a JOIN ids i USING (anchor) JOIN docs d ON d.text = a.positive""")
def qrels(spark, sf):
    """Query ids in first-seen order, corpus ids in text order, and which document is relevant to which query."""
    rows = _anchored(spark, sf)
    docs, ids = ranking.corpus(rows, ["positive", "negative"]), ranking.query_ids(rows)
    return ranking.qrels(rows, ids, docs).join(ids, "query_id").join(docs, "corpus_id").select("query_id", "corpus_id", "anchor", "text")


@_query("""WITH r AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, c.vec_id) AS rank
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id QUALIFY rank <= 50) SELECT query_id, corpus_id, round(s, 6) AS score, rank FROM r""")
def cosine_top_k(spark, sf):
    found = evaluation.vector_ranks(spark, sf, 50)
    return found.select("query_id", "corpus_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _rounded_sql(sql: str, columns: str) -> str:
    names = columns.split()
    return f"SELECT {', '.join(f'round({n[:-1]}, 6) AS {n[:-1]}' if n.endswith('~') else n for n in names)} FROM ({sql})"


_METRICS = "accuracy~ recall~ precision~ mrr~ ndcg~ map~"


@_query(_rounded_sql(evaluation.LABEL_METRICS_SQL, f"query_id k {_METRICS}"))
def ir_metrics_per_query(spark, sf):
    return _rounded(evaluation.label_metrics(spark, sf))


@_query(f"SELECT k, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('accuracy', 'recall', 'precision', 'mrr', 'ndcg', 'map'))}, count(*) AS n_queries FROM ({evaluation.LABEL_METRICS_SQL}) GROUP BY k")
def ir_metrics(spark, sf):
    return _rounded(ranking.mean_metrics(evaluation.label_metrics(spark, sf)))


_SHAPED = "acc_at_5~ acc_at_10~ acc_at_20~ recall_at_5~ recall_at_10~ recall_at_20~"


@_query(_rounded_sql(evaluation.SHAPE_ROWS_SQL, f"model nl_query num_attributes query_distance {_SHAPED}"))
def metrics_per_query_shape(spark, sf):
    return _rounded(evaluation.shape_rows(spark, sf))


@_query(_rounded_sql(evaluation.BY_SHAPE_SQL, f"model num_attributes query_distance {_SHAPED} n_queries breakdown"))
def metrics_by_query_shape(spark, sf):
    """The flagship: accuracy and recall by attribute count, by distance and overall."""
    return _rounded(evaluation.by_shape(spark, sf))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return metrics_by_query_shape(spark, sf)


@_query(f"""WITH {EXAMPLES_SQL}, seen AS (
  SELECT anchor, negative AS text, CASE WHEN negative_example_source = 'random' THEN 'Easy' ELSE 'Hard' END AS kind, query_distance, row_id, 0 AS side FROM anchored UNION ALL SELECT anchor, positive, 'Positive', query_distance, row_id, 1 FROM anchored)
SELECT anchor, text, arg_max(kind, (row_id, side, query_distance)) AS kind, arg_max(query_distance, (row_id, side, query_distance)) AS query_distance FROM seen GROUP BY ALL""")
def last_seen_metadata(spark, sf):
    return ranking.last_metadata(_anchored(spark, sf))


@_query("""WITH r AS (SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, c.label, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, c.vec_id) AS rank
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id QUALIFY rank <= 50)
SELECT 'vector ' || query_id AS anchor, string_agg('[' || printf('%.4f', s) || '] vector ' || corpus_id || ' (Type: ' || CASE WHEN label = query_id % 10 THEN 'Positive' ELSE 'Random' END || ', Distance: ' || CASE WHEN label = query_id % 10 THEN '0.0' ELSE 'N/A' END || ')', chr(10) ORDER BY rank) AS predictions FROM r GROUP BY query_id""")
def prediction_listing(spark, sf):
    """The best 50 documents of each query as text; documents with the label of the query's last digit count as known."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.concat(F.lit("vector "), "vec_id").alias("text"))
    docs = v.select(F.col("vec_id").alias("corpus_id"), "text", "label")
    ids = v.select(F.col("vec_id").alias("query_id"), F.col("text").alias("anchor"))
    ranked = evaluation.vector_ranks(spark, sf, 50)
    known = ranked.join(docs, "corpus_id").join(ids, "query_id").where(F.col("label") == F.col("query_id") % 10).select("anchor", "text", F.lit("Positive").alias("kind"), F.lit(0.0).alias("query_distance"))
    return ranking.prediction_listing(ranked, docs.drop("label"), ids, known)


_SUMMARY = "avg_pos_sim~ avg_neg_sim~ triplet_accuracy~ avg_easy_neg_sim~ triplet_accuracy_easy~ avg_hard_neg_sim~ triplet_accuracy_hard~"


@_query(_rounded_sql(f"""WITH {evaluation.ENCODED_SQL} SELECT avg(pos_sim) AS avg_pos_sim, avg(neg_sim) AS avg_neg_sim, avg((pos_sim > neg_sim)::INT) AS triplet_accuracy,
avg(neg_sim) FILTER (WHERE easy) AS avg_easy_neg_sim, avg((pos_sim > neg_sim)::INT) FILTER (WHERE easy) AS triplet_accuracy_easy, avg(neg_sim) FILTER (WHERE NOT easy) AS avg_hard_neg_sim, avg((pos_sim > neg_sim)::INT) FILTER (WHERE NOT easy) AS triplet_accuracy_hard,
CAST(count_if(easy) AS BIGINT) AS n_easy, CAST(count_if(NOT easy) AS BIGINT) AS n_hard FROM enc""", _SUMMARY + " n_easy n_hard"))
def cosine_summary(spark, sf):
    return _rounded(losses.cosine_summary(evaluation.encoded_rows(spark, sf)))


@_query(_rounded_sql(f"""WITH {evaluation.ENCODED_SQL} SELECT avg(greatest(0, (1 - pos_sim) - (1 - neg_sim) + 0.2)) AS triplet_loss, avg(pow(pos_sim - neg_sim - label::DOUBLE, 2)) AS margin_loss, avg(pow(neg_sim - pos_sim - label::DOUBLE, 2)) AS reversed_margin_loss,
avg((pow(pos_sim - 1, 2) + pow(neg_sim - (1 - label::DOUBLE), 2)) / 2) AS pairwise_loss, avg(pow(list_dot_product(q, p) - list_dot_product(q, m) - label::DOUBLE, 2)) AS attribute_hamming_loss FROM enc""", "triplet_loss~ margin_loss~ reversed_margin_loss~ pairwise_loss~ attribute_hamming_loss~"))
def training_losses(spark, sf):
    return _rounded(losses.losses(evaluation.encoded_rows(spark, sf)))


@_query("SELECT 'a' || label AS attribute, bool_and(abs(CAST(embedding[1] AS DOUBLE) - 1) < 1e-6) AS holds FROM embeddings GROUP BY label")
def probe_residuals(spark, sf):
    """Is a vector's first coordinate, as a probe, equal to its label's bit to a millionth? (It isn't, for any label.)"""
    v = fixtures.vectors(spark, sf)
    one = F.transform("v", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    rows = v.select(F.concat(F.lit("a"), "label").alias("attribute"), one.alias("b"), F.col("v").alias("f"), F.lit(0.0).alias("beta"), F.lit(1).alias("z"))
    return losses.probe_residuals(rows, 1e-6).select("attribute", "holds")


@_query(f"WITH {PARTS_SQL}, {HARD_SQL}, e AS (SELECT 1) SELECT h.key, h.hard_key, a.category AS category, b.category AS hard_category FROM hard h JOIN parts a ON a.key = h.key JOIN parts b ON b.key = h.hard_key")
def catalogue_hard_negatives(spark, sf):
    p = fixtures.parts(spark, sf)
    other = p.select(F.col("key").alias("hard_key"), F.col("category").alias("hard_category"))
    return merge_join(merge_join(catalogue.hard_negatives(p, SEED), p.select("key", "category"), "key"), other, "hard_key").select("key", "hard_key", "category", "hard_category")


_COLOR = f"""r2 AS (SELECT *, row_number() OVER (PARTITION BY category, color ORDER BY key) - 1 AS place2, count(*) OVER (PARTITION BY category, color) AS n2 FROM parts),
same AS (SELECT a.key, b.key AS same_key FROM (SELECT key, category, color, CASE WHEN pick >= place2 THEN pick + 1 ELSE pick END AS place2 FROM (SELECT *, {draw_sql("key", "same_key")} % (n2 - 1) AS pick FROM r2 WHERE n2 > 1)) a
  JOIN r2 b ON a.category = b.category AND a.color = b.color AND a.place2 = b.place2)"""


@_query(f"WITH {EXAMPLES_SQL}, {_COLOR} SELECT h.key, coalesce(s.same_key, h.hard_key) AS hard_key, e.easy_key FROM hard h LEFT JOIN same s ON s.key = h.key JOIN easy e ON e.key = h.key")
def catalogue_triplets(spark, sf):
    """Triplets whose hard negative has the product's colour where one does, with an easy negative of another category."""
    return catalogue.triplets(fixtures.parts(spark, sf), SEED, match_color=True)


@_query(f"WITH {PARTS_SQL} SELECT category, key AS chosen FROM parts QUALIFY row_number() OVER (PARTITION BY category ORDER BY md5('{SEED}:' || key), key) = 1")
def catalogue_representatives(spark, sf):
    """One record per product, with the category standing for the product."""
    p = fixtures.parts(spark, sf).select(F.col("category").alias("product_id"), "key", "color")
    return catalogue.representatives(p, SEED).select(F.col("product_id").alias("category"), F.col("key").alias("chosen"))


@_query(f"WITH {PARTS_SQL} SELECT color, count(*) AS n, CAST(min(key) AS BIGINT) AS first_key, CAST(max(key) AS BIGINT) AS last_key FROM parts GROUP BY 1")
def catalogue_groups(spark, sf):
    members = catalogue.group_members(fixtures.parts(spark, sf), "color")
    ends = [F.max(F.when(F.col("place") == at, F.col("key"))) for at in (F.lit(0), F.col("n") - 1)]
    return members.groupBy("color", "n").agg(ends[0].alias("first_key"), ends[1].alias("last_key"))


@_query("""WITH last_box AS (SELECT l_partkey, arg_max(l_linenumber, (l_orderkey, l_linenumber)) AS t, arg_max(l_returnflag, (l_orderkey, l_linenumber)) AS pose, arg_max(l_quantity, (l_orderkey, l_linenumber)) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey AS key, coalesce(CAST(t AS VARCHAR), '') AS clothes_type, coalesce(pose, '') AS pose_type, CASE WHEN t IS NULL THEN '' ELSE CAST(q AS INTEGER) || ',' || (CAST(q AS INTEGER) + 1) END AS bbox,
CASE t WHEN 1 THEN 'upper_body' WHEN 2 THEN 'lower_body' WHEN 3 THEN 'full_body' ELSE 'unknown' END AS type_name FROM part LEFT JOIN last_box ON p_partkey = l_partkey""")
def catalogue_boxes(spark, sf):
    """Parts with the last of their boxes; returned line items stand for boxes, so a part may have none."""
    boxes = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("image_name"), F.struct("l_orderkey", "l_linenumber").alias("row_id"), F.col("l_linenumber").cast("string").alias("clothes_type"), F.col("l_returnflag").alias("pose_type"), F.array(F.col("l_quantity").cast("int"), F.col("l_quantity").cast("int") + 1).alias("bbox"),
    )
    out = catalogue.with_boxes(table(spark, sf, "part").select(F.col("p_partkey").alias("image_name")), boxes)
    return out.select(F.col("image_name").alias("key"), "clothes_type", "pose_type", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"), catalogue.clothes_type_name(F.col("clothes_type")).alias("type_name"))


@_query(f"WITH {HISTORY_SQL} SELECT run_id, metric, arg_max(value, (ts, event_id)) FILTER (WHERE value IS NOT NULL AND NOT isnan(value)) AS last_value, arg_min(value, (ts, event_id)) AS first_value FROM history GROUP BY ALL")
def run_last_metrics(spark, sf):
    h = fixtures.run_history(spark, sf)
    first = runs.first_values(h, F.col("step")).withColumnRenamed("value", "first_value")
    return first.join(runs.last_values(h, F.col("step")).withColumnRenamed("value", "last_value"), ["run_id", "metric"], "left")


@_query(f"""WITH {RUNS_SQL}, l AS (SELECT run_id, metric, arg_max(value, (ts, event_id)) AS value FROM history GROUP BY ALL)
SELECT r.run_id, r.name, CASE WHEN coalesce(nullif(style, ''), split_part(name, '_', 1)) = 'ours-mse' THEN 'marginal-mse' ELSE coalesce(nullif(style, ''), split_part(name, '_', 1)) END AS style, max(value) FILTER (WHERE metric = 'purchase') AS purchase, max(value) FILTER (WHERE metric = 'view') AS view, CAST(NULL AS DOUBLE) AS missing
FROM runs r LEFT JOIN l USING (run_id) GROUP BY ALL""")
def run_comparison(spark, sf):
    """A row per run: name, style with its fallback, last metrics as columns, null where missing, and a column no run has."""
    last = runs.last_values(fixtures.run_history(spark, sf), F.col("step"))
    wide = runs.ensure_columns(runs.wide(last, ["purchase", "view"]), ["missing"])
    r = fixtures.run_table(spark, sf)
    return r.join(wide, "run_id", "left").select("run_id", "name", runs.style_of(F.col("config")["style"], F.col("name")).alias("style"), "purchase", "view", "missing")


@_query(f"""WITH {RUNS_SQL} SELECT run_id, name, "group", TRY_CAST(split_part(split_part(name, 'synthetic_multiplier-', 2), '_', 1) AS DOUBLE) AS x FROM runs WHERE "group" IN ('sweep_a', 'sweep_b') AND TRY_CAST(split_part(split_part(name, 'synthetic_multiplier-', 2), '_', 1) AS DOUBLE) IS NOT NULL""")
def run_sweep(spark, sf):
    return runs.sweep(fixtures.run_table(spark, sf), ["sweep_a", "sweep_b"], "synthetic_multiplier").select("run_id", "name", "group", "x")


@_query(f"""WITH {RUNS_SQL}, b AS (SELECT run_id, name, CAST(split_part(name, '_', 2) AS BIGINT) AS dataset_size, row_number() OVER (PARTITION BY split_part(name, '_', 2) ORDER BY length(name), epoch(t) DESC, run_id) AS k FROM runs WHERE contains(name, 'baseline'))
SELECT dataset_size, run_id, name FROM b WHERE k = 1""")
def run_baselines(spark, sf):
    return runs.best_baselines(fixtures.run_table(spark, sf))


@_query(f"""WITH {RUNS_SQL}, b AS (SELECT run_id, CAST(split_part(name, '_', 2) AS BIGINT) AS dataset_size, row_number() OVER (PARTITION BY split_part(name, '_', 2) ORDER BY length(name), epoch(t) DESC, run_id) AS k FROM runs WHERE contains(name, 'baseline'))
SELECT r.run_id, CAST(split_part(r.name, '_', 2) AS BIGINT) AS dataset_size, b.run_id AS baseline_id FROM runs r LEFT JOIN b ON b.dataset_size = CAST(split_part(r.name, '_', 2) AS BIGINT) AND b.k = 1""")
def run_with_baseline(spark, sf):
    r = fixtures.run_table(spark, sf)
    sized = r.withColumn("dataset_size", T.first_number_token(F.col("name")))
    return runs.with_baseline(sized, runs.best_baselines(r)).select("run_id", "dataset_size", "baseline_id")


@_query(f"WITH {HISTORY_SQL} SELECT metric, knob, round(avg(value), 6) AS value FROM history GROUP BY ALL")
def run_line_means(spark, sf):
    return _rounded(runs.mean_per_x(fixtures.run_history(spark, sf), "knob", "value", ["metric"]))


@_query(f"""WITH {RUNS_SQL}, l AS (SELECT run_id, metric, arg_max(value, (ts, event_id)) AS value FROM history GROUP BY ALL), s AS (SELECT *, TRY_CAST(split_part(split_part(name, 'synthetic_multiplier-', 2), '_', 1) AS DOUBLE) AS x,
CASE WHEN coalesce(nullif(style, ''), split_part(name, '_', 1)) = 'ours-mse' THEN 'marginal-mse' ELSE coalesce(nullif(style, ''), split_part(name, '_', 1)) END AS st FROM runs WHERE "group" IN ('sweep_a', 'sweep_b'))
SELECT CAST(v AS VARCHAR) AS row_value, metric, st AS style, x, value AS y FROM s JOIN l USING (run_id) WHERE x IS NOT NULL AND metric IN ('purchase', 'view') AND value IS NOT NULL""")
def run_grid_series(spark, sf):
    r = runs.sweep(fixtures.run_table(spark, sf), ["sweep_a", "sweep_b"], "synthetic_multiplier")
    wide = runs.wide(runs.last_values(fixtures.run_history(spark, sf), F.col("step")), ["purchase", "view"])
    rows = r.join(wide, "run_id").withColumn("style", runs.style_of(F.col("config")["style"], F.col("name"))).withColumn("v", F.col("config")["V"])
    return runs.grid_series(rows, "x", "v", ["purchase", "view"])


@_query("SELECT p_brand AS value, row_number() OVER (ORDER BY TRY_CAST(p_brand AS DOUBLE) IS NULL, TRY_CAST(p_brand AS DOUBLE), p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT CAST(p_size AS VARCHAR) FROM part)")
def mixed_type_order(spark, sf):
    """Distinct sweep values, numbers first by value, then texts; a few dozen values, so one window orders them."""
    from pyspark.sql import Window as W

    p = table(spark, sf, "part")
    values = p.select(F.col("p_brand").alias("value")).union(p.select(F.col("p_size").cast("string"))).distinct()
    return values.withColumn("place", F.row_number().over(W.orderBy(*runs.mixed_order("value"))).cast("bigint"))


@_query(f"""WITH {HISTORY_SQL}, m AS (SELECT run_id, map_from_entries(list((('val/recall@' || CAST(knob % 3 AS VARCHAR)), value) ORDER BY ts, event_id)) AS x FROM (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY run_id, knob % 3 ORDER BY ts DESC, event_id DESC) = 1) GROUP BY run_id)
SELECT run_id, round(x['val/recall@1'], 6) AS recall FROM m""")
def run_recall_fallback(spark, sf):
    """Recall at 1 from the log dicts of a run merged over its summary, under the first key it is held by."""
    h = fixtures.run_history(spark, sf).withColumn("k", F.concat(F.lit("val/recall@"), (F.col("knob") % 3).cast("string")))
    last = h.groupBy("run_id", "k").agg(F.max_by("value", "step").alias("v"))
    logged = last.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    summary = F.create_map(F.lit("recall@1"), F.lit(-1.0), F.lit("val/recall@9"), F.lit(-2.0))
    told = logged.select("run_id", runs.merge_maps(summary, F.col("m")).alias("m"), "m")
    picked = told.toDF("run_id", "merged", "m")
    value = F.when(F.map_contains_key("m", "val/recall@1"), runs.recall_at(F.col("merged"), 1))  # the summary's own key comes last
    return picked.select("run_id", F.round(value, 6).alias("recall"))


def _profile(spark, sf):
    e = table(spark, sf, "events")
    name = F.element_at(F.array(F.lit("app.py"), F.lit("load.py"), F.lit("lib/wait.py"), F.lit("/usr/lib/python3/json.py")), (F.col("event_id") % 4 + 1).cast("int"))
    micro = F.col("event_id") % 9973
    seconds = lambda x: F.format_string("%d.%06d", F.floor(x / 1000000), x % 1000000)
    line = F.format_string("  %d/%d %s %s %s %s %s:%d(%s)", F.col("user_id") + 2, F.lit(1), seconds(micro), seconds(micro % 97), seconds(micro * 3), seconds(micro % 89), name, (F.col("event_id") % 500).cast("int"), F.col("event_type"))
    return e.select(line.alias("value"))


_PROFILE_SQL = """prof AS (SELECT (user_id + 2) || '/1' AS ncalls, user_id + 2 AS calls, CAST(event_id % 9973 AS DOUBLE) / 1e6 AS tottime, CAST(event_id % 9973 * 3 AS DOUBLE) / 1e6 AS cumtime,
['app.py', 'load.py', 'lib/wait.py', '/usr/lib/python3/json.py'][CAST(event_id % 4 + 1 AS INTEGER)] AS filename, CAST(event_id % 500 AS INTEGER) AS lineno, event_type AS funcname FROM events)"""
_FILES = ("app.py", "load.py", "lib/wait.py", "lib/none.py")


@_query(f"WITH {_PROFILE_SQL} SELECT ncalls, tottime, cumtime, filename, lineno, funcname, calls FROM prof WHERE filename NOT LIKE '/usr%' AND (tottime > 0.001 OR cumtime > 0.001)")
def profile_significant(spark, sf):
    p = profiling.significant(profiling.parse(_profile(spark, sf), only=_FILES))
    return p.select("ncalls", "tottime", "cumtime", "filename", "lineno", "funcname", "calls")


@_query(f"""WITH {_PROFILE_SQL}, own AS (SELECT * FROM prof WHERE filename NOT LIKE '/usr%')
{" UNION ALL ".join(f"(SELECT '{m}' AS measure, filename, lineno, funcname, CAST({c} AS DOUBLE) AS amount FROM own ORDER BY {c} DESC, filename, lineno, funcname LIMIT 10)" for m, c in profiling.MEASURES.items())}""")
def profile_top(spark, sf):
    return profiling.top(profiling.parse(_profile(spark, sf), only=_FILES))


def _calls(spark, sf):
    c = table(spark, sf, "conversations")
    tokens = (F.length("text") / 4).cast("bigint")
    model = F.element_at(F.array(F.lit("gemini-2.5-flash"), F.lit("gpt-5-mini"), F.lit("gemini-unknown"), F.lit("local-model")), (F.col("conv_id") % 4 + 1).cast("int"))
    return c.select(model.alias("model_id"), F.when(F.col("role") == "assistant", 0).otherwise(tokens).alias("tokens_in"), F.when(F.col("role") == "assistant", tokens).otherwise(0).alias("tokens_out"))


@_query("""WITH c AS (SELECT ['gemini-2.5-flash', 'gpt-5-mini', 'gemini-unknown', 'local-model'][CAST(conv_id % 4 + 1 AS INTEGER)] AS model_id, CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS i, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS o FROM conversations),
s AS (SELECT model_id, CAST(sum(i + o) AS BIGINT) AS total_tokens, count(*) AS total_calls, sum(CASE model_id WHEN 'gemini-2.5-flash' THEN i / 1e6 * 0.3 + o / 1e6 * 2.5 WHEN 'gpt-5-mini' THEN i / 1e6 * 0.25 + o / 1e6 * 2.0 ELSE 0 END) AS total_cost FROM c WHERE model_id <> 'local-model' GROUP BY 1)
SELECT model_id, total_tokens, total_calls, round(total_cost, 6) AS total_cost, round(total_tokens / total_calls, 6) AS tokens_per_call, round(total_cost / total_calls, 9) AS cost_per_call, CASE WHEN total_cost > 0 THEN round(total_cost * 1e6 / total_tokens, 6) END AS cost_per_million FROM s""")
def token_costs(spark, sf):
    s = costs.summary(costs.ledger(_calls(spark, sf), costs.price_table(spark)), ["model_id"])
    return s.select("model_id", "total_tokens", "total_calls", F.round("total_cost", 6).alias("total_cost"), F.round("tokens_per_call", 6).alias("tokens_per_call"), F.round("cost_per_call", 9).alias("cost_per_call"), F.round("cost_per_million", 6).alias("cost_per_million"))


def _messages(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return c.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))


@_query("""SELECT conv_id, CASE WHEN count(*) = 1 AND min(role) = 'user' THEN min(text) ELSE string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn, role, text) END AS prompt FROM conversations GROUP BY conv_id""")
def message_flattening(spark, sf):
    return _messages(spark, sf).select("conv_id", models.flatten_messages(F.col("messages")).alias("prompt"))


@_query("SELECT sha256(role || '|' || 'gemini-2.5-flash') AS key, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY role")
def memo_misses(spark, sf):
    """Requests not in the memo yet, each once, with how often they were asked: one request per role, the system's already known."""
    asked = table(spark, sf, "conversations").select(models.memo_key(F.col("role"), F.lit("gemini-2.5-flash")).alias("key"), "role")
    memo = asked.where("role = 'system'").select("key").distinct()
    times = asked.groupBy("key").agg(F.count("*").alias("n"))
    return models.misses(asked, memo).select("key").join(times, "key")


@_query("""SELECT p_partkey AS key, p_partkey % 5 <> 1 AND p_partkey % 5 <> 2 AND p_partkey % 5 <> 3 AS valid FROM part""")
def reply_validation(spark, sf):
    """Bucket replies of five kinds: good, a key too few, a number among the features, a negation, good with empty lists."""
    k, name = F.col("p_partkey") % 5, F.to_json(F.array("p_name"))
    reply = F.when(k == 1, F.format_string('{"common_features": %s, "unique_features_a": [], "unique_features_b": []}', name)).when(
        k == 2, F.format_string('{"common_features": [1], "unique_features_a": %s, "unique_features_b": [], "neither_features": []}', name)
    ).when(k == 3, F.format_string('{"common_features": %s, "unique_features_a": ["No sleeves"], "unique_features_b": [], "neither_features": []}', name)).when(
        k == 4, F.lit('{"common_features": [], "unique_features_a": [], "unique_features_b": [], "neither_features": []}')
    ).otherwise(F.format_string('{"common_features": %s, "unique_features_a": ["x"], "unique_features_b": ["y"], "neither_features": ["z"]}', name))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), models.buckets_reply_valid(reply).alias("valid"))


@_query(f"WITH {BUCKETS_SQL} SELECT key, {', '.join(_joined_sql(f'full_{b}') for b in attributes.BUCKETS)} FROM pairs")
def model_bucket_extraction(spark, sf):
    """Buckets through the model boundary, with the stub as the model."""
    pairs = fixtures.bucket_pairs(spark, sf).select("key", F.col("attributes").alias("a"), "b", F.concat("full_neither", "full_common", "full_pos", "full_neg").alias("vocabulary"))
    return models.extract_buckets(pairs, "stub").select("key", *[_joined(f"full_{b}") for b in attributes.BUCKETS])


@_query(f"WITH {GENERATED_SQL} SELECT key, p_asked AS original_query, item, nl_query, query_distance, num_attributes FROM (SELECT g.*, p.color || ' ' || p.category AS p_asked FROM generated g JOIN parts p USING (key))")
def example_pipeline(spark, sf):
    """Item, then buckets, then a conjunction for every product beside its hard negative, with the stub as the model."""
    pairs = fixtures.bucket_pairs(spark, sf).select("key", F.col("attributes").alias("a"), "b", F.array_sort(F.concat("full_neither", "full_common", "full_pos", "full_neg")).alias("vocabulary"))
    asked = fixtures.parts(spark, sf).select("key", F.concat_ws(" ", "color", "category").alias("query"))
    return models.process_examples(merge_join(pairs, asked, "key"), "stub", SEED).select("key", "original_query", "item", "nl_query", "query_distance", "num_attributes")


@_query(f"WITH {GENERATED_SQL} SELECT key, nl_query, query_distance, 'gemini-stub' AS hard_negative_distance_source FROM generated")
def visual_distances(spark, sf):
    """Hard negatives scored through the image model's boundary, with the stub as the model."""
    pairs = fixtures.bucket_pairs(spark, sf).select("key", "item", F.col("attributes").alias("a"), "b", F.array_sort(F.concat("full_neither", "full_common", "full_pos", "full_neg")).alias("vocabulary"))
    return models.score_visually(pairs, "gemini-stub", SEED).select("key", "nl_query", "query_distance", "hard_negative_distance_source")


_HITS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)}))) AS n_{lang}" for lang, words in language.COMMON.items())


@_query(f"""WITH t AS (SELECT doc_id, string_split_regex(trim(regexp_replace(lower(text), '[^a-zà-öø-ÿ]+', ' ', 'g')), ' ') AS w FROM documents), h AS (SELECT doc_id, {_HITS} FROM t)
SELECT doc_id, CASE WHEN greatest({", ".join(f"n_{x}" for x in language.COMMON)}) = 0 THEN NULL {" ".join(f"WHEN n_{x} = greatest({', '.join(f'n_{y}' for y in language.COMMON)}) THEN '{x}'" for x in language.COMMON)} END AS detected FROM h""")
def detected_language(spark, sf):
    """Languages told by the stand-in detector over whole texts; null where it fails, which the filters reject."""
    return language.detect(table(spark, sf, "documents").select("doc_id", "text"), "text", "detected").select("doc_id", "detected")


_LISTED = [("words", "ranked", "words", 1), ("words", "squared", "words", 2), ("words", "gap", "words", 3), ("both", "ranked", "pictures", 4), ("both", "gap", "pictures", 5), ("pictures", "ranked", "pictures", -1)]


@_query(f"""WITH {HISTORY_SQL}, l AS (SELECT run_id, metric, arg_max(value, (ts, event_id)) AS value FROM history GROUP BY ALL), listed(trained_on, method, evaluated_on, run_id) AS (VALUES {", ".join(map(str, _LISTED))})
SELECT trained_on, method, evaluated_on, run_id, (SELECT value FROM l WHERE l.run_id = listed.run_id AND metric = 'view') AS "view", (SELECT value FROM l WHERE l.run_id = listed.run_id AND metric = 'purchase') AS purchase FROM listed""")
def listed_runs(spark, sf):
    """A given list of runs beside their last metrics; a run that isn't there keeps its row."""
    last = runs.last_values(fixtures.run_history(spark, sf), F.col("step"))
    return runs.listed(runs.run_list(spark, _LISTED, "bigint"), last, ["view", "purchase"])


@_query("SELECT p_partkey AS key, 'Find ' || p_name AS rephrased_query, split_part(p_name, ' ', -1) AS item FROM part")
def model_rephrase(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("nl_query"), F.lit(None).cast("string").alias("rephrased_query"))
    items = models.infer_items(rows.select("key", F.col("nl_query").alias("query")), "stub").select("key", "item")
    return merge_join(models.rephrase(rows, "stub"), items, "key").select("key", "rephrased_query", "item")


@_query(f"""WITH {GENERATED_SQL} SELECT 'documents' AS what, count(*) AS n, round(avg(len(regexp_split_to_array(trim(text), '\\s+'))), 6) AS words, CAST(NULL AS DOUBLE) AS attributes FROM documents
UNION ALL SELECT 'queries', count(*), round(avg(len(regexp_split_to_array(trim(nl_query), '\\s+'))), 6), round(avg(num_attributes), 6) FROM generated""")
def corpus_statistics(spark, sf):
    words = lambda c: F.avg(F.size(F.split(F.trim(c), r"\s+")))
    d = table(spark, sf, "documents").agg(F.count("*").alias("n"), words("text").alias("words")).select(F.lit("documents").alias("what"), "n", "words", F.lit(None).cast("double").alias("attributes"))
    q = fixtures.generated(spark, sf).agg(F.count("*").alias("n"), words("nl_query").alias("words"), F.avg("num_attributes").alias("attributes")).select(F.lit("queries").alias("what"), "n", "words", "attributes")
    return _rounded(d.union(q))


@_query(r"""SELECT p_partkey AS key, regexp_replace(p_name || '_01_1_front', '_\d+_(front|back|side|full|additional|flat)$', '') AS product_id, trim(regexp_replace(p_name || '#', '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS file_name, split_part('a/b/' || p_name, '/', -1) AS last_part,
p_size AS from_file, lower(CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'no' END) IN ('true', '1', 't', 'y', 'yes') AS flag, abs(p_retailprice - p_retailprice * 1.000001) <= 1e-8 + 1e-5 * abs(p_retailprice * 1.000001) AS close FROM part""")
def text_functions(spark, sf):
    p = table(spark, sf, "part")
    name = F.col("p_name")
    return p.select(
        F.col("p_partkey").alias("key"), T.product_of_view(F.concat(name, F.lit("_01_1_front"))).alias("product_id"), T.safe_filename(F.concat(name, F.lit("#"))).alias("file_name"), T.last_path_part(F.concat(F.lit("a/b/"), name)).alias("last_part"),
        T.size_of_file(F.concat(F.lit("data_"), F.col("p_size").cast("string"), F.lit(".jsonl"))).cast("int").alias("from_file"), T.truthy(F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("no")).alias("flag"), T.close_to(F.col("p_retailprice"), F.col("p_retailprice") * 1.000001).alias("close"),
    )


@_query(f"WITH {HISTORY_SQL} SELECT run_id, metric, arg_max(value, (ts, event_id)) AS value FROM history WHERE value IS NOT NULL GROUP BY ALL")
def streaming_last_metrics(spark, sf):
    """The same as a stream over the event files, driven until nothing is left."""
    import uuid

    name = f"stream_{uuid.uuid4().hex}"
    return streaming.run_available(spark, f"{sf}/events.parquet", streaming.last_metrics, name, f"{shared_dir(spark)}/{name}").select("run_id", "metric", "value")


def queries() -> dict:
    return _Q | round_trips.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | round_trips.SQL
