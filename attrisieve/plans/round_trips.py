"""Queries that write what a source or a sink holds to the shared folder and read it back, and those of whole plans over it.

Everything written comes from the given tables, in folders of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sampling import draw, merge_join, rank_in_groups
from ..operators import boolean, catalogue, costs, encoding, language, losses, mining, models, profiling, ranking, reshape, runs, splits
from ..session import shared_dir, table
from ..sources import readers, writers
from ..streaming import metrics as streaming
from . import fixtures
from .fixtures import EXAMPLES_SQL, GENERATED_SQL, HISTORY_SQL, JUDGED_SQL, RUNS_SQL, SEED, draw_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, label: str) -> str:
    """A folder of the shared one that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# ---- languages

_HELD = f"{draw_sql('doc_id', 'held')} % 7 = 2"
_TOLD_SQL = rf"""plain AS (SELECT doc_id, lang, {_HELD} AS held, ' ' || trim(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
letters AS (SELECT *, string_split(t, '') AS c FROM plain WHERE length(t) > 2),
grams AS (SELECT doc_id, lang, held, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS g FROM letters),
counted AS (SELECT lang, g, count(*) AS n FROM grams WHERE NOT held AND lang IS NOT NULL GROUP BY ALL), totals AS (SELECT lang, sum(n) + {language.TRIPLES} AS total FROM counted GROUP BY lang),
kept AS (SELECT g FROM counted GROUP BY g ORDER BY sum(n) DESC, g LIMIT {language.TRIPLES}),
weights AS (SELECT t.lang, k.g, CAST(round(1000 * ln((coalesce(n.n, 0) + 1) / t.total)) AS BIGINT) AS w FROM totals t CROSS JOIN kept k LEFT JOIN counted n ON n.lang = t.lang AND n.g = k.g),
scores AS (SELECT doc_id, t.lang, sum(coalesce(w.w, CAST(round(1000 * ln(1 / t.total)) AS BIGINT))) AS score FROM grams CROSS JOIN totals t LEFT JOIN weights w ON w.g = grams.g AND w.lang = t.lang GROUP BY ALL),
told AS (SELECT doc_id, arg_max(lang, (score, lang)) AS detected FROM scores GROUP BY doc_id)"""


def _language_model(spark: SparkSession, sf: str) -> language.Model:
    """Fitted on all documents but those held out."""
    return language.fit(table(spark, sf, "documents").where(draw(SEED, F.col("doc_id"), "held") % 7 != 2))


@_query(f"WITH {_TOLD_SQL} SELECT doc_id, held, lang, detected FROM plain LEFT JOIN told USING (doc_id)")
def language_by_triples(spark, sf):
    """The language of every document by a model fitted on six sevenths of them; null where there is no letter, which the filters reject."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", (draw(SEED, F.col("doc_id"), "held") % 7 == 2).alias("held"))
    return language.tell(docs, "text", _language_model(spark, sf), "detected").select("doc_id", "held", "lang", "detected")


@_query(f"""WITH {_TOLD_SQL}, {JUDGED_SQL}, own AS (SELECT j.* EXCLUDE (lang), detected AS lang FROM judged j LEFT JOIN told ON told.doc_id = j.row_id WHERE product_locale = 'us'),
exact AS (SELECT query_id, min(row_id) AS exact_id FROM own WHERE esci_label = 'Exact' GROUP BY 1),
paired AS (SELECT o.*, e.exact_id FROM own o JOIN exact e USING (query_id) WHERE esci_label IN ('Substitute', 'Irrelevant')),
pool AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS n FROM own WHERE lang = 'en'),
drawn AS (SELECT p.*, {draw_sql("p.row_id", "easy")} % (SELECT max(n) FROM pool) AS place FROM paired p JOIN own e ON e.row_id = p.exact_id WHERE p.lang = 'en' AND e.lang = 'en')
SELECT k.row_id, k.exact_id AS positive_id, k.product_id AS hard_id, o.product_id AS easy_id FROM drawn k JOIN pool o ON o.place = k.place""")
def triplets_in_detected_english(spark, sf):
    """Triplets whose positive, hard and easy negative are English by the language model; a text it can't tell rejects the row."""
    judged = language.tell(fixtures.judged(spark, sf), "product_text", _language_model(spark, sf))
    t = mining.triplets(judged, SEED)
    return t.select("row_id", F.col("positive_product.product_id").cast("bigint").alias("positive_id"), F.col("hard_neg_product.product_id").alias("hard_id"), F.col("easy_neg_product.product_id").alias("easy_id"))


# ---- images


def _drawn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(name, content): an image file per row (key, width, height, channels, samples in hex); every fifth one is cut off."""
    for pdf in frames:
        made = [writers.png(w, h, bytes.fromhex(x)[: w * h * c], c) for w, h, c, x in zip(pdf["width"], pdf["height"], pdf["channels"], pdf["samples"], strict=True)]
        yield pd.DataFrame({"name": [f"view {k}.png" for k in pdf["key"]], "content": [m[:40] if k % 5 == 0 else m for k, m in zip(pdf["key"], made, strict=True)]})


@_query("""WITH s AS (SELECT s_suppkey AS key, 1 + s_suppkey % 4 AS w, 1 + s_suppkey % 3 AS h, [1, 3, 4][CAST(s_suppkey % 3 + 1 AS INTEGER)] AS c, repeat(md5(CAST(s_suppkey AS VARCHAR)), 3) AS x FROM supplier),
p AS (SELECT *, list_transform(range(CAST(w * h AS BIGINT)), lambda i: CASE c WHEN 1 THEN repeat(substr(x, 2 * i + 1, 2), 3) ELSE substr(x, 2 * c * i + 1, 6) END) AS pixels FROM s)
SELECT key, CASE WHEN key % 5 <> 0 THEN CAST(w AS INTEGER) END AS width, CASE WHEN key % 5 <> 0 THEN CAST(h AS INTEGER) END AS height, CASE WHEN key % 5 <> 0 THEN upper(array_to_string(pixels, '')) END AS rgb FROM p""")
def images_as_rgb(spark, sf):
    """Grey, coloured and half-transparent images written to the shared folder and decoded to RGB; files that are cut off give nulls."""
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        key.alias("key"), (1 + key % 4).alias("width"), (1 + key % 3).alias("height"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (key % 3 + 1).cast("int")).alias("channels"), F.repeat(F.md5(key.cast("string").cast("binary")), 3).alias("samples"),
    )
    folder = _folder(spark, "images")
    writers.materialise(rows.mapInPandas(_drawn, "name string, content binary"), folder).write.format("noop").mode("overwrite").save()
    number = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint")
    return readers.images(spark, folder).select(number.alias("key"), "width", "height", F.hex("rgb").alias("rgb"))


@_query("""SELECT s_suppkey AS key, CAST(1 + s_suppkey % 4 AS INTEGER) AS width, CAST(1 + s_suppkey % 3 AS INTEGER) AS height, upper(array_to_string(list_transform(range(CAST((1 + s_suppkey % 4) * (1 + s_suppkey % 3) AS BIGINT)), lambda i: substr(repeat(md5(CAST(s_suppkey AS VARCHAR)), 3), 8 * i + 1, 6)), '')) AS rgb FROM supplier WHERE s_suppkey % 5 <> 0""")
def images_kept_as_rgb(spark, sf):
    """Half-transparent images decoded, kept as RGB files under safe names, and decoded again; those that can't be decoded aren't kept."""
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(key.alias("key"), (1 + key % 4).alias("width"), (1 + key % 3).alias("height"), F.lit(4).alias("channels"), F.repeat(F.md5(key.cast("string").cast("binary")), 3).alias("samples"))
    first, second = _folder(spark, "images"), _folder(spark, "images")
    writers.materialise(rows.mapInPandas(_drawn, "name string, content binary"), first).write.format("noop").mode("overwrite").save()
    decoded = readers.images(spark, first).select(T.last_path_part(F.col("path")).alias("name"), "width", "height", "rgb")
    writers.materialise_rgb(decoded, second).write.format("noop").mode("overwrite").save()
    number = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint")
    return readers.images(spark, second).select(number.alias("key"), "width", "height", F.hex("rgb").alias("rgb"))


# ---- annotation files


@_query("""SELECT row_number() OVER (ORDER BY p_partkey) + 1 AS row_id, 'img/' || p_partkey || '.jpg' AS image_name, 'id_' || p_size AS item_id, CASE WHEN p_partkey % 4 = 0 THEN 'query' ELSE 'gallery' END AS split,
coalesce(t, '') AS clothes_type, coalesce(pose, '') AS pose_type, coalesce(box, '') AS bbox FROM part
LEFT JOIN (SELECT l_partkey, arg_max(CAST(l_linenumber AS VARCHAR), (l_orderkey, l_linenumber)) AS t, arg_max(l_returnflag, (l_orderkey, l_linenumber)) AS pose, arg_max(CAST(l_quantity AS INTEGER) || ',1,2,' || l_linenumber, (l_orderkey, l_linenumber)) AS box
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey""")
def annotated_images(spark, sf):
    """Partition and box tables written as annotation files of many parts, scanned in splits with global line numbers, and joined."""
    part = table(spark, sf, "part")
    folder = _folder(spark, "annotations")
    line = F.format_string("img/%d.jpg   id_%d\t%s", "p_partkey", "p_size", F.when(F.col("p_partkey") % 4 == 0, "query").otherwise("gallery"))
    writers.whitespace_table(part.select("p_partkey", line.alias("value")), f"{folder}/partition", "image_name item_id evaluation_status", "p_partkey")
    item = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    box = F.format_string(" img/%d.jpg %d %s  %d 1 2 %d ", "l_partkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("int"), "l_linenumber")
    writers.whitespace_table(item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"), box.alias("value")), f"{folder}/boxes", "image_name clothes_type pose_type x_1 y_1 x_2 y_2", "place")
    partition, boxes = readers.annotated_images(spark, f"{folder}/partition", f"{folder}/boxes")
    joined = catalogue.with_boxes(partition, boxes)
    return joined.select("row_id", "image_name", "item_id", "split", "clothes_type", "pose_type", F.array_join(F.col("bbox").cast("array<string>"), ",").alias("bbox"))


# ---- run folders


def _run_files(spark: SparkSession, sf: str) -> DataFrame:
    """(name, content): folders of runs. Every seventh run has none, every third an older one with other numbers, every fifth no
    summary, every eleventh a summary that isn't JSON; logs print a dict per event."""
    h = fixtures.run_history(spark, sf).where("value is not null")
    r = F.col("run_id")
    k = F.element_at(F.array(F.lit(5), F.lit(10), F.lit(100)), (F.col("knob") % 3 + 1).cast("int"))
    printed = F.format_string("step %d {'%s_accuracy@5': %s, 'val/recall@%d': %s, 'epoch': None}", F.col("step.event_id"), "metric", F.col("value").cast("string"), k, F.col("value").cast("string"))
    noise = F.format_string("loss: {'loss': %s}\n", F.col("value").cast("string"))
    log = h.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("step", F.concat(noise, printed).alias("line")))).alias("l"), F.max("value").alias("most"))  # an event list a run
    content = F.concat(F.lit("started\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    summary = F.when(r % 11 == 0, "{not json").otherwise(F.concat(F.lit('{"test_recall@10": 0.5, "accuracy@100": '), F.col("most").cast("string"), F.lit(', "note": "x", "recall@100": 0.25}')))
    arguments = F.format_string("meta:\n    value:\n        e:\n            a1:\n                args:\n                    - --run\n                    - \"%d\"\n                os: linux\n", r)
    newer, older = (F.format_string(f"run-2025{month}01_120000-r%d/files", r) for month in ("07", "02"))
    file = lambda folder, name, text, there: F.struct(F.concat(folder, F.lit(f"/{name}")).alias("name"), F.when(there, text).alias("content"))
    files = F.array(
        file(newer, "output.log", content, r % 4 != 1), file(newer, "run-summary.json", summary, r % 5 != 0), file(newer, "config.yaml", arguments, F.lit(True)),
        file(older, "output.log", F.lit("{'val/recall@5': -1.0}\n"), r % 3 == 0), file(older, "run-summary.json", F.lit('{"val/recall@100": -2.0}'), r % 3 == 0),
    )
    return log.where(r % 7 != 0).select(F.inline(files)).where("content is not null")


@_query(f"""WITH {HISTORY_SQL}, h AS (SELECT *, [5, 10, 100][CAST(knob % 3 + 1 AS INTEGER)] AS k FROM history WHERE value IS NOT NULL),
top AS (SELECT run_id, max(value) AS most FROM h GROUP BY 1),
printed AS (SELECT run_id, 'val/recall@' || k AS key, value, ts, event_id FROM h WHERE run_id % 4 <> 1 UNION ALL SELECT run_id, metric || '_accuracy@5', value, ts, event_id FROM h WHERE run_id % 4 <> 1),
logged AS (SELECT run_id, key, arg_max(value, (ts, event_id)) AS value FROM printed GROUP BY ALL),
told AS (SELECT run_id, unnest(['test_recall@10', 'accuracy@100', 'recall@100']) AS key, unnest([0.5::DOUBLE, most, 0.25::DOUBLE]) AS value FROM top WHERE run_id % 5 <> 0 AND run_id % 11 <> 0),
merged AS (SELECT * FROM logged UNION ALL SELECT * FROM told WHERE (run_id, key) NOT IN (SELECT run_id, key FROM logged)),
m AS (SELECT run_id, map_from_entries(list((key, value))) AS x FROM merged GROUP BY run_id)
SELECT 'r' || t.run_id AS run_id, CASE WHEN t.run_id % 7 <> 0 THEN 'run-20250701_120000-r' || t.run_id END AS folder,
CASE WHEN t.run_id % 7 <> 0 THEN {{}} END AS recall_at_5, CASE WHEN t.run_id % 7 <> 0 THEN {{}} END AS recall_at_10, CASE WHEN t.run_id % 7 <> 0 THEN {{}} END AS recall_at_100, CASE WHEN t.run_id % 7 <> 0 THEN '--run ' || t.run_id ELSE '' END AS verified_args
FROM top t LEFT JOIN m ON m.run_id = t.run_id""".format(*[f"round(coalesce({', '.join(f'''x['{key.format(k=k)}']''' for key in runs.RECALL_KEYS)}), 6)" for k in (5, 10, 100)]))
def run_recalls(spark, sf):
    """Run folders written from events and read back: the newest folder of a run, its summary, its logged dicts over it, the first recall key there, its arguments."""
    base = _folder(spark, "runs")
    writers.files(_run_files(spark, sf), base).write.format("noop").mode("overwrite").save()
    listed = fixtures.run_history(spark, sf).where("value is not null").select(F.concat(F.lit("r"), F.col("run_id").cast("string")).alias("run_id")).distinct()
    found = runs.read_recalls(spark, base, listed)
    return found.select("run_id", F.element_at(F.split("run_dir", "/"), -1).alias("folder"), *[F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in (5, 10, 100)], "verified_args")


# ---- distances to any Boolean function

_N = 10
_TOKENS = boolean.random_tokens(_N, SEED + 1)
_BITS_SQL = f"""own AS (SELECT p_partkey AS key, ('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 4))::BIGINT % {1 << _N} AS own FROM part),
every AS (SELECT a, list_transform(range({_N}), lambda i: (a >> CAST(i AS INTEGER)) & 1 = 1) AS z FROM range({1 << _N}) t(a)),
ok AS (SELECT a FROM every WHERE {" ".join(f"z[{int(t[5:-1]) + 1}]" if t.startswith("args") else t for t in _TOKENS)})"""


@_query(f"WITH {_BITS_SQL}, apart AS (SELECT own, min(bit_count(xor(a, own))) AS distance FROM (SELECT DISTINCT own FROM own) CROSS JOIN ok GROUP BY own) SELECT key, CAST(distance AS INTEGER) AS distance FROM own JOIN apart USING (own)")
def boolean_distance_table(spark, sf):
    """Distances of ten feature bits to a random Boolean function, by a distance transform of the hypercube and one lookup a row; the SQL tries all assignments."""
    number = F.conv(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 4), 16, 10).cast("bigint")
    bits = F.array(*[F.call_function("shiftright", number, F.lit(i)).bitwiseAND(F.lit(1).cast("bigint")) == 1 for i in range(_N)])
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), bits.alias("z"))
    return boolean.edit_distances(rows, "key", "z", _N, boolean.to_sql(_TOKENS, "z"))


# ---- encoders

_DIMS = 24


def hashed_words(texts: list[str]) -> list[list[float]]:
    """Signed counts of words by their MD5, so that SQL can encode, too."""
    from hashlib import md5

    out, known = [], {}
    for text in texts:
        v = [0.0] * encoding.DIM
        for word in text.split():
            h = known.get(word)
            if h is None:
                h = known[word] = int(md5(word.encode()).hexdigest()[:8], 16)
            v[h % encoding.DIM] += 1.0 if h & 0x8000 else -1.0
        out.append(v)
    return out


def _product_text(key: str) -> str:
    return f"(SELECT key AS {key}, array_to_string(attributes, ' ') || ' number ' || key % 97 AS text FROM parts)"


_ENCODED_SQL = f"""{EXAMPLES_SQL}, product AS {_product_text("key")}, rows2 AS (SELECT a.row_id, a.anchor, p.text AS positive, n.text AS negative FROM (SELECT row_id, nl_query AS anchor, key, hard_key FROM examples) a JOIN product p ON p.key = a.key JOIN product n ON n.key = a.hard_key),
docs AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS corpus_id FROM (SELECT positive AS text FROM rows2 UNION SELECT negative FROM rows2)),
ids AS (SELECT anchor, row_number() OVER (ORDER BY min(row_id)) - 1 AS query_id FROM rows2 GROUP BY anchor),
words AS (SELECT text, unnest(string_split_regex(trim(text), '\\s+')) AS word FROM (SELECT text FROM docs UNION SELECT anchor FROM ids)),
parts_of AS (SELECT text, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM words),
summed AS (SELECT text, h % {encoding.DIM} AS d, sum(CASE WHEN h & 32768 <> 0 THEN 1 ELSE -1 END) AS x FROM parts_of GROUP BY ALL),
heads AS (SELECT text, list(d) AS ds, list(x) AS xs FROM summed WHERE d < {_DIMS} GROUP BY text),
vectors AS (SELECT text, list_transform(range({_DIMS}), lambda i: CASE WHEN list_contains(ds, i) THEN CAST(xs[list_position(ds, i)] AS DOUBLE) ELSE 0.0::DOUBLE END) AS v FROM heads),
q AS (SELECT query_id, v FROM ids JOIN vectors ON vectors.text = ids.anchor WHERE list_dot_product(v, v) > 0), c AS (SELECT corpus_id, v FROM docs JOIN vectors USING (text) WHERE list_dot_product(v, v) > 0),
ranks AS (SELECT query_id, corpus_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, corpus_id) AS rk FROM q CROSS JOIN c QUALIFY rk <= 10),
relevant AS (SELECT DISTINCT query_id, corpus_id FROM rows2 JOIN ids USING (anchor) JOIN docs ON docs.text = rows2.positive),
totals AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY 1), hits AS (SELECT query_id, rk, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS hit FROM ranks JOIN relevant USING (query_id, corpus_id)),
each AS (SELECT t.query_id, k, n, count(h.rk) AS hits, min(h.rk) AS first, sum(1 / log2(h.rk + 1)) AS gain, sum(h.hit / h.rk) AS precisions FROM totals t CROSS JOIN (VALUES (1), (5), (10)) ks(k) LEFT JOIN hits h ON h.query_id = t.query_id AND h.rk <= k GROUP BY ALL)"""


@_query(f"""WITH {_ENCODED_SQL} SELECT CAST(k AS INTEGER) AS k, round(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, round(avg(hits / n), 6) AS recall, round(avg(hits / k), 6) AS precision, round(avg(coalesce(1 / first, 0.0::DOUBLE)), 6) AS mrr,
round(avg(coalesce(gain, 0) / list_sum(list_transform(range(1, least(k, n) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(coalesce(precisions, 0) / least(k, n)), 6) AS map, count(*) AS n_queries FROM each GROUP BY k""")
def encoded_metrics(spark, sf):
    """Retrieval metrics over encoded texts: distinct queries and products encoded once, vectors cut to their first dimensions, ranked by cosine."""
    e = fixtures.examples(spark, sf).select("row_id", F.col("nl_query").alias("anchor"), "key", "hard_key")
    text = F.concat(F.array_join("attributes", " "), F.lit(" number "), (F.col("key") % 97).cast("string"))
    product = fixtures.parts(spark, sf).select("key", text.alias("positive"))
    other = product.select(F.col("key").alias("hard_key"), F.col("positive").alias("negative"))
    rows = merge_join(merge_join(e, product, "key"), other, "hard_key").select("row_id", "anchor", "positive", "negative")
    means = ranking.mean_metrics(ranking.encoded_metrics(rows, hashed_words, (1, 5, 10), dims=_DIMS))
    return means.select("k", *[F.round(c, 6).alias(c) for c in ("accuracy", "recall", "precision", "mrr", "ndcg", "map")], "n_queries")


# ---- probes


@_query(f"""WITH {GENERATED_SQL}, conditions AS (SELECT key, unnest(list_concat(required, forbidden)) AS attribute FROM generated WHERE len(required) + len(forbidden) > 0),
vocabulary_ AS (SELECT DISTINCT unnest(attributes) AS attribute FROM parts)
SELECT attribute, true AS holds, 0.0::DOUBLE AS largest, count(DISTINCT key) AS n FROM conditions GROUP BY attribute""")
def probe_recovery(spark, sf):
    """Probes with intercepts from queries with and without a condition, and whether they give back the attribute's bit of every query's product and hard negative.

    Products are encoded so that the theorem's hypothesis holds: a unit vector per attribute plus an offset all share.
    """
    shared_dir(spark)
    g = fixtures.generated(spark, sf).select("key", "hard_key", "attributes", "b", "required", "forbidden").where("size(required) + size(forbidden) > 0").checkpoint()
    names = [r[0] for r in fixtures.parts(spark, sf).select(F.explode("attributes").alias("a")).distinct().orderBy("a").collect()]  # a few dozen attributes
    every = F.array(*[F.lit(n) for n in names])
    vector = lambda has: F.concat(F.array(F.lit(1.0)), F.transform(every, lambda a: F.when(F.array_contains(has, a), 1.5).otherwise(0.5)))
    conditions = F.concat(F.transform("required", lambda a: F.concat(a, F.lit(":1"))), F.transform("forbidden", lambda a: F.concat(a, F.lit(":-1"))))
    asked = g.select("key", F.array_sort(conditions).alias("conditions"), "required", "forbidden")
    deleted = asked.select("key", F.explode("conditions").alias("gone"), "conditions").select("key", F.array_remove("conditions", F.col("gone")).alias("conditions"))
    sign = lambda c, a: F.when(F.array_contains(c, F.concat(a, F.lit(":1"))), 1.0).when(F.array_contains(c, F.concat(a, F.lit(":-1"))), -1.0).otherwise(0.0)
    encoded = F.concat(F.array(F.lit(0.25)), F.transform(every, lambda a: sign(F.col("conditions"), a)))
    whole, rest = asked.select(F.col("key").alias("reference"), "conditions"), deleted.select(F.lit(None).cast("bigint").alias("reference"), "conditions")
    queries = whole.union(rest).select("reference", "conditions", encoded.alias("f"))
    fits = g.select("key", F.array_sort(F.array_union(F.array_except("attributes", F.col("forbidden")), F.col("required"))).alias("attributes"))  # a product that fits
    products = fits.select("key", "attributes", vector(F.col("attributes")).alias("f"))
    own = losses.probes_with_intercept(queries, products).select(F.col("reference").alias("key"), "attribute", "b", "beta")
    seen = g.select("key", F.explode(F.array("attributes", "b")).alias("has")).select("key", "has", vector(F.col("has")).alias("f"))
    rows = own.join(seen, "key").select("key", "attribute", "b", "beta", "f", F.when(F.array_contains("has", F.col("attribute")), 1.0).otherwise(0.0).alias("z"))
    told = losses.probe_residuals(rows, 1e-6, F.countDistinct("key").alias("n"))
    return told.select("attribute", "holds", F.round("largest", 6).alias("largest"), "n")


# ---- sources and sinks


@_query("SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, n_chars FROM documents WHERE doc_id % 2 = 0 OR doc_id % 2 = 1")
def json_lines_round_trip(spark, sf):
    """All documents as JSON lines and back: nulls and characters past ASCII stay, blank lines and missing files are no rows."""
    folder = _folder(spark, "lines")
    d = table(spark, sf, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), "n_chars")
    writers.jsonl(d, f"{folder}/rows")
    spark.createDataFrame([("",), ("",)], "value string").write.mode("append").text(f"{folder}/rows")
    return readers.jsonl(spark, f"{folder}/rows", d.schema).unionByName(readers.jsonl(spark, f"{folder}/none", d.schema))


_CALLS_SQL = """calls AS (SELECT ['gemini-2.5-flash', 'gpt-5-mini'][CAST(conv_id % 2 + 1 AS INTEGER)] AS model_id, conv_id % 3 AS run, length(text) AS i, turn AS o FROM conversations)"""


@_query(f"""WITH {_CALLS_SQL} SELECT 'run ' || run AS run, CAST(sum(i + o) AS BIGINT) AS total_tokens, count(*) AS total_calls,
round(sum(CASE model_id WHEN 'gemini-2.5-flash' THEN i / 1e6 * 0.3 + o / 1e6 * 2.5 ELSE i / 1e6 * 0.25 + o / 1e6 * 2.0 END), 8) AS total_cost FROM calls GROUP BY run""")
def cost_ledger(spark, sf):
    """A CSV ledger of runs' costs, a record appended per run, one of them twice as a retried call would: it counts once."""
    c = table(spark, sf, "conversations")
    calls = c.select(F.element_at(F.array(F.lit("gemini-2.5-flash"), F.lit("gpt-5-mini")), (F.col("conv_id") % 2 + 1).cast("int")).alias("model_id"), (F.col("conv_id") % 3).alias("run"), F.length("text").alias("tokens_in"), F.col("turn").alias("tokens_out"))
    priced = costs.ledger(calls, costs.price_table(spark))
    path = _folder(spark, "ledger")
    for run in (0, 1, 1, 2):
        record = costs.summary(priced.where(F.col("run") == run)).select("total_tokens", "total_calls", F.format_string("%.8f", "total_cost").alias("total_cost"))
        writers.append_ledger(record, path, f"run {run}")
    back = readers.csv(spark, path, "total_tokens bigint, total_calls bigint, total_cost double, run string")
    return back.where("total_calls > 0").select("run", "total_tokens", "total_calls", "total_cost")


@_query("""SELECT model, count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM (SELECT 'm' || label AS model, CASE WHEN label = 3 THEN 2 * vec_id ELSE vec_id END AS x FROM embeddings WHERE label <> 3 OR vec_id % 2 = 0) GROUP BY model""")
def keyed_overwrite(spark, sf):
    """Results per model, those of one model written again with other rows: they replace its own and leave all others."""
    path = _folder(spark, "results")
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), F.col("vec_id").alias("x"))
    writers.overwrite_partition(e, path, "model")
    writers.overwrite_partition(e.where("model = 'm3' and x % 2 = 0").withColumn("x", F.col("x") * 2), path, "model")
    return readers.parquet(spark, path).groupBy("model").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


@_query("SELECT p_partkey, p_size + 1 AS size FROM part")
def made_once(spark, sf):
    """A table that is made where it isn't there and read where it is: the second maker, which would give other rows, is never asked."""
    path = _folder(spark, "made")
    p = table(spark, sf, "part")
    writers.cached(spark, path, lambda: p.select("p_partkey", (F.col("p_size") + 1).alias("size")))
    return writers.cached(spark, path, lambda: p.select("p_partkey", F.lit(0).alias("size")))


@_query("""WITH m AS (SELECT avg(value) AS a, max(value) AS b, CAST(count(*) AS DOUBLE) AS c FROM events)
SELECT 'val' AS split, unnest(['val/accuracy@5', 'val/recall@10', 'val/n']) AS metric, round(unnest([a, b, c]), 6) AS value FROM m""")
def logged_metrics(spark, sf):
    """A row of metrics as log rows: a prefix per split, and without the cosine_ of older names."""
    one = table(spark, sf, "events").agg(F.avg("value").alias("cosine_accuracy@5"), F.max("value").alias("cosine_recall@10"), F.count("*").alias("n"), F.max(F.lit(None).cast("double")).alias("none"))
    return writers.log_rows(one, "val").select("split", "metric", F.round("value", 6).alias("value"))


@_query(f"""WITH {EXAMPLES_SQL} SELECT row_id, anchor, negative, positive, CAST(CASE WHEN query_distance = -1 THEN 15.0 ELSE query_distance END / 25.0 AS FLOAT) AS label, negative_example_source = 'random' AS easy,
CAST(CASE WHEN query_distance = -1 THEN 15.0 ELSE query_distance END / 25.0 AS FLOAT) >= (SELECT max(CAST(CASE WHEN query_distance = -1 THEN 15.0 ELSE query_distance END / 25.0 AS FLOAT)) FROM anchored) - 1e-5 AS at_most FROM anchored""")
def reversed_rows(spark, sf):
    """The reversed style's columns in its order, with which rows are easy by their source and which hold the largest label."""
    rows = reshape.anchors(reshape.training_rows(fixtures.examples(spark, sf)), "nl_query", drop_blank=True)
    labelled = rows.withColumn("label", reshape.label(F.col("query_distance"), 15.0, 25.0))
    swapped = reshape.swap_sides(labelled).withColumn("easy", reshape.is_easy(labelled))
    return reshape.drop_auxiliary(swapped.withColumn("at_most", reshape.is_easy(labelled.drop("negative_example_source")))).select("row_id", "anchor", "negative", "positive", "label", "easy", "at_most")


@_query("SELECT event_id, event_type, value FROM events")
def stream_written_once(spark, sf):
    """Events appended by a stream whose every batch is written a second time, as after a restart: each event is there once."""
    name = f"appended-{uuid.uuid4().hex}"
    return streaming.run_available(spark, f"{sf}/events.parquet", lambda s: s.select("event_id", "event_type", "value"), name, f"{shared_dir(spark)}/{name}", "append", repeat=2).select("event_id", "event_type", "value")


# ---- scans, runs and models


@_query(r"""WITH raw AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'id_' || p_size || '_' || p_partkey || '_front' END AS upper_id, CASE WHEN p_partkey % 5 <> 0 THEN 'id_' || p_partkey || '_2_full' END AS lower_id, p_brand, CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN '' ELSE p_type END AS kind FROM part),
named AS (SELECT *, coalesce(nullif(trim(upper_id), ''), nullif(trim(lower_id), ''), '') AS item FROM raw)
SELECT row_id, item AS item_id, regexp_replace(item, '_\d+_(front|back|side|full|additional|flat)$', '') AS product_id, coalesce(kind, '') AS category1, coalesce(nullif(lower(kind), ''), 'unknown') AS category, '' AS description, p_brand AS color FROM named WHERE item <> ''""")
def catalogue_scan(spark, sf):
    """Catalogue records: the item under either of its names, rows without one left out, absent texts blank, categories unknown where blank."""
    key = F.col("p_partkey")
    kind = F.when(key % 4 == 1, "").when(key % 4 > 1, F.col("p_type"))
    upper = F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("id_"), F.col("p_size"), F.lit("_"), key, F.lit("_front")))
    raw = table(spark, sf, "part").select(key.alias("row_id"), upper.alias("item_ID"), F.when(key % 5 != 0, F.concat(F.lit("id_"), key, F.lit("_2_full"))).alias("item_id2"), F.col("p_brand").alias("Color"), kind.alias("category1"))
    found = readers.catalogue(raw, names=("item_ID", "item_id2"))
    return found.select("row_id", "item_id", "product_id", "category1", T.category_or_unknown(F.col("category1")).alias("category"), "description", "color")


@_query(f"""WITH {RUNS_SQL} SELECT DISTINCT "group" AS source, v AS value FROM runs WHERE "group" IN ('sweep_b', 'other') UNION SELECT 'style', nullif(style, '') FROM runs WHERE nullif(style, '') IS NOT NULL AND "group" IN ('sweep_b', 'other')""")
def run_values(spark, sf):
    """Distinct settings of the runs of two groups, which the scan asks for, and their distinct styles."""
    own = readers.runs(fixtures.run_table(spark, sf), ["sweep_b", "other"])
    scales = own.select(F.col("group").alias("source"), F.col("config")["V"].alias("value")).distinct()
    styles = runs.distinct_values(own.select(F.nullif(F.col("config")["style"], F.lit("")).alias("value")), "value").select(F.lit("style").alias("source"), "value")
    return scales.unionByName(styles)


@_query(f"""WITH {RUNS_SQL}, last AS (SELECT run_id, metric, arg_max(value, (ts, event_id)) AS value FROM history WHERE value IS NOT NULL AND metric IN ('view', 'purchase') GROUP BY ALL),
p AS (SELECT CAST(v AS DOUBLE) AS row_value, metric, coalesce(nullif(style, ''), split_part(name, '_', 1)) AS style, CAST(split_part(name, '_', 2) AS DOUBLE) AS x, avg(value) AS y FROM runs JOIN last USING (run_id) GROUP BY ALL)
SELECT row_value, metric, CASE WHEN style = 'ours-mse' THEN 'marginal-mse' ELSE style END AS style, string_agg(printf('%.0f:%.6f', x, y), ' ' ORDER BY x) AS points FROM p GROUP BY ALL""")
def run_series(spark, sf):
    """The lines of a grid of plots: per setting, metric and style its points by size, the mean where runs share a size."""
    last = runs.wide(runs.last_values(fixtures.run_history(spark, sf), F.col("step")), ["view", "purchase"])
    rows = fixtures.run_table(spark, sf).join(last, "run_id").select(F.col("config")["V"].cast("double").alias("scale"), runs.style_of(F.col("config")["style"], F.col("name")).alias("style"), T.first_number_token(F.col("name")).cast("double").alias("size"), "view", "purchase")
    lines = runs.ordered_series(runs.grid_series(rows, "size", "scale", ["view", "purchase"]))
    return lines.select("row_value", "metric", "style", F.array_join(F.transform("points", lambda p: F.format_string("%.0f:%.6f", p["x"], p["y"])), " ").alias("points"))


@_query(f"""WITH {EXAMPLES_SQL}, shuffled AS (SELECT anchor, row_number() OVER (ORDER BY md5('{SEED}:' || anchor), anchor) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT anchor FROM anchored))
SELECT a.row_id, a.anchor, a.negative_example_source FROM anchored a JOIN shuffled USING (anchor) WHERE place >= ceil(ceil(n / 5) / 2) AND place < ceil(n / 5)""")
def evaluation_split(spark, sf):
    """The rows of the validation split alone, as evaluating without training reads them."""
    rows = reshape.anchors(reshape.training_rows(fixtures.examples(spark, sf)), "nl_query", drop_blank=True)
    return splits.only(splits.split_by_query(rows, SEED), "validation").select("row_id", "anchor", "negative_example_source")


@_query("""SELECT p_partkey AS key, p_brand || '/part_' || p_partkey || '_rephrased.jsonl' AS rephrased, CASE WHEN p_partkey % 2 = 0 THEN 'img/part ' || p_partkey || '.jpg' ELSE '../shared/img/part ' || p_partkey || '.jpg' END AS seen FROM part""")
def file_names(spark, sf):
    """Names of rephrased files beside their own, and image paths as a report in another folder sees them."""
    p, key = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    name = F.concat("p_brand", F.lit("/part_"), key, F.lit(".jsonl"))
    image = F.concat(F.when(F.col("p_partkey") % 2 == 0, "/data/out/img/part ").otherwise("/data/./shared/img/part "), key, F.lit(".jpg"))
    return p.select(F.col("p_partkey").alias("key"), T.with_suffix(name, ".jsonl", "_rephrased.jsonl").alias("rephrased"), T.relative_path(image, F.lit("/data/out")).alias("seen"))


@_query("""SELECT p_partkey AS id, split_part(p_name, ' ', -1) AS item, true AS asked, 0 AS calls_again FROM part""")
def remembered_replies(spark, sf):
    """Items told by a model with a memo: equal prompts are asked once, a few at a time, and asked again after the memo was compacted they make no call."""
    path = _folder(spark, "memo")
    requests = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Query: "), "p_name").alias("prompt"))
    first = models.ask_remembered(requests, "item", "stub", path).checkpoint()
    models.compact_memo(spark, path, 0)
    again = models.ask_remembered(requests, "item", "stub", path).select("id", F.col("calls").alias("calls_again"))
    told = first.select("id", F.get_json_object("reply", "$.item").alias("item"), (F.col("calls") == 1).alias("asked"))
    return told.join(again, "id").select("id", "item", "asked", "calls_again")


_ORDERED = "/usr/lib/python3/abc.py"


@_query("""SELECT row_number() OVER (ORDER BY cumtime DESC, filename, lineno, funcname) AS place, filename, lineno, funcname, cumtime FROM (
SELECT 'app.py' AS filename, CAST(event_id AS INTEGER) AS lineno, event_type AS funcname, CAST(event_id % 991 AS DOUBLE) / 1000 AS cumtime FROM events WHERE event_id % 3 <> 0)""")
def profile_order(spark, sf):
    """Profile lines of the files asked for, by cumulative time."""
    e = table(spark, sf, "events")
    seconds = F.format_string("%d.%03d", F.floor(F.col("event_id") % 991 / 1000), F.col("event_id") % 991 % 1000)
    line = F.format_string(" 1 0.001 0.001 %s 0.001 %s:%d(%s)", seconds, F.when(F.col("event_id") % 3 == 0, _ORDERED).otherwise("app.py"), F.col("event_id").cast("int"), F.col("event_type"))
    ordered = profiling.by_cumulative_time(profiling.parse(e.select(line.alias("value")), only=("app.py",)))
    keyed = ordered.select(F.struct((-F.col("cumtime")).alias("down"), "filename", "lineno", "funcname").alias("order"), "filename", "lineno", "funcname", "cumtime")
    return rank_in_groups(keyed, [], "order", "place").select((F.col("place") + 1).alias("place"), "filename", "lineno", "funcname", "cumtime")
