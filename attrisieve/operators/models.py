"""The boundary to language models: routing, retries with validation, memo, and the extraction steps built on it.

The client is a function (messages, model_id) -> reply given by the caller; the default needs no network and answers from
the prompt alone, always the same way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NEGATIONS, starts_with_negation
from ..session import shared_dir
from ..sources.readers import path_exists
from . import attributes, reshape

Client = Callable[[list[dict], str], str]
Result = TypeVar("Result")
#: Requests a task has under way at once; digits of its key that name the folder a remembered reply lies in.
WINDOW, SHARD_DIGITS = 8, 2
#: Keys of each kind of reply: required, then optional (fixed values).
REPLIES = {
    "item": (("item",), ("features",)),
    "buckets": (("common_features", "unique_features_a", "unique_features_b", "neither_features"), ()),
    "rephrase": (("rephrased_query",), ()),
}


def route(model_id: str) -> str:
    return "gpt" if model_id.startswith("gpt-") else "gemini" if model_id.startswith("gemini-") else "local"


def stub_client(messages: list[dict], model_id: str) -> str:
    """A deterministic stand-in: splits what follows 'A:' and 'B:' at commas, or returns what follows 'Query:'."""
    text = messages[-1]["content"]
    parts = {k: [x.strip() for x in v.split(",") if x.strip()] for k, _, v in (line.partition(":") for line in text.splitlines()) if v}
    if "A" in parts and "B" in parts:
        a, b, rest = parts["A"], parts["B"], parts.get("Vocabulary", [])
        return json.dumps({"common_features": [x for x in a if x in b], "unique_features_a": [x for x in a if x not in b], "unique_features_b": [x for x in b if x not in a], "neither_features": [x for x in rest if x not in a and x not in b]})
    query = text.partition("Query:")[2].strip()
    if "rephrase" in text.lower():
        return json.dumps({"rephrased_query": f"Find {query}"})
    words = query.split()
    return json.dumps({"item": words[-1] if words else "", "features": words[:-1]})


def valid_reply(text: str | None, kind: str) -> bool:
    """Is a reply a JSON object of just the right keys and types, with no feature that opens with a negation?"""
    try:
        value = json.loads(text or "")
    except ValueError:
        return False
    required, optional = REPLIES[kind]
    if not isinstance(value, dict) or not set(required) <= set(value) <= {*required, *optional}:
        return False
    for key, own in value.items():
        if key in ("item", "rephrased_query"):
            if not isinstance(own, str):
                return False
        elif not isinstance(own, list) or not all(isinstance(x, str) for x in own) or any(x.lower().startswith(NEGATIONS) for x in own):
            return False
    return True


def buckets_reply_valid(reply: Column) -> Column:
    """The same check of a bucket reply without Python, for replies that are one JSON object."""
    keys = REPLIES["buckets"][0]
    parsed = F.try_parse_json(reply)
    kinds = F.schema_of_variant(parsed)
    fields = [F.from_json(F.get_json_object(reply, f"$.{k}"), "array<string>") for k in keys]
    whole = F.array_sort(F.json_object_keys(reply)) == F.array(*[F.lit(k) for k in sorted(keys)])
    shaped = F.regexp_count(kinds, F.lit(r": ARRAY<(STRING|VOID)>")) == len(keys)
    clean = ~F.exists(F.concat(*[F.coalesce(f, F.array().cast("array<string>")) for f in fields]), starts_with_negation)
    return F.coalesce(parsed.isNotNull() & whole & shaped & clean, F.lit(False))


def flatten_messages(messages: Column) -> Column:
    """'Role: text' lines; a single user message passes as it is."""
    line = lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])
    return F.when((F.size(messages) == 1) & (messages[0]["role"] == "user"), messages[0]["content"]).otherwise(F.array_join(F.transform(messages, line), "\n"))


def memo_key(messages_json: Column, model_id: Column) -> Column:
    return F.sha2(F.concat_ws("|", messages_json, model_id), 256)


def misses(requests: DataFrame, memo: DataFrame) -> DataFrame:
    """Requests (key, ...) the memo lacks, each once."""
    return requests.dropDuplicates(["key"]).join(memo.select("key"), "key", "left_anti")


def ask_with_retry(client: Client, messages: list[dict], model_id: str, kind: str, tries: int) -> tuple[str | None, int]:
    """(the first valid reply or None, calls made). From the second try on the first message says so, so a memo can't repeat a bad reply."""
    for attempt in range(1, tries + 1):
        sent = messages
        if attempt > 1:
            sent = [{**messages[0], "content": f"{messages[0]['content']}\n(attempt {attempt})"}, *messages[1:]]
        try:
            reply = client(sent, model_id)
        except Exception:  # any failure of a client counts as a try
            continue
        if valid_reply(reply, kind):
            return reply, attempt
    return None, tries


def in_order(jobs: Iterable[Callable[[], Result]], window: int) -> Iterator[Result]:
    """The results of jobs in their order, so many of them under way at once; a job is drawn only when there is room for it."""
    from collections import deque
    from concurrent.futures import ThreadPoolExecutor

    if window < 1:
        raise ValueError("one job at least has to be under way")
    with ThreadPoolExecutor(window) as pool:
        under_way: deque = deque()
        try:
            for job in jobs:
                under_way.append(pool.submit(job))
                if len(under_way) >= window:
                    yield under_way.popleft().result()
            while under_way:
                yield under_way.popleft().result()
        finally:  # whoever reads may stop early, or a job may have failed
            for later in under_way:
                later.cancel()


def ask(requests: DataFrame, kind: str, model_id: str, client: Client = stub_client, tries: int = 5, memo: DataFrame | None = None, window: int = WINDOW) -> DataFrame:
    """(key, reply, calls) for requests (key, prompt): null where no valid reply came. Requests in the memo (key, reply) make no call.

    A task has up to ``window`` requests under way, each with its own retries, and returns replies in the order of its
    requests; clients are called from several threads at once unless the window is 1. calls is what a request took, so
    totals are sums over rows and need no counters in workers.
    """
    todo = requests if memo is None else misses(requests, memo)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def jobs() -> Iterator[Callable[[], tuple]]:
            for pdf in frames:
                for key, prompt in zip(pdf["key"].tolist(), pdf["prompt"], strict=True):
                    yield lambda key=key, prompt=prompt: (key, *ask_with_retry(client, [{"role": "user", "content": prompt}], model_id, kind, tries))

        told = in_order(jobs(), window)
        while some := list(islice(told, 256)):
            yield pd.DataFrame({"key": [k for k, _, _ in some], "reply": [r for _, r, _ in some], "calls": [n for _, _, n in some]})

    kind_of_key = todo.schema["key"].dataType.simpleString()
    fresh = todo.select("key", "prompt").mapInPandas(run, f"key {kind_of_key}, reply string, calls int")
    if memo is None:
        return fresh
    known = requests.select("key").distinct().join(memo.select("key", "reply"), "key").select("key", "reply", F.lit(0).alias("calls"))
    return fresh.unionByName(known)


def extract_buckets(pairs: DataFrame, model_id: str, client: Client = stub_client, keep_failures: bool = False) -> DataFrame:
    """pairs (key, a, b, vocabulary: arrays) with full_common, full_pos, full_neg, full_neither from the model; failures go or stay with nulls."""
    text = lambda c: F.array_join(c, ", ")
    prompt = F.concat(F.lit("Split the features.\nA: "), text("a"), F.lit("\nB: "), text("b"), F.lit("\nVocabulary: "), text("vocabulary"))
    replies = ask(pairs.select("key", prompt.alias("prompt")), "buckets", model_id, client)
    part = lambda name: F.from_json(F.get_json_object("reply", f"$.{name}"), "array<string>")
    joined = pairs.join(replies, "key").select(pairs["*"], part("common_features").alias("full_common"), part("unique_features_a").alias("full_pos"), part("unique_features_b").alias("full_neg"), part("neither_features").alias("full_neither"), "reply", "calls")
    return (joined if keep_failures else joined.where("reply is not null")).drop("reply")


def infer_items(queries: DataFrame, model_id: str, client: Client = stub_client) -> DataFrame:
    """queries (key, query) with item and features; failures go."""
    replies = ask(queries.select("key", F.concat(F.lit("Query: "), "query").alias("prompt")), "item", model_id, client, tries=3)
    joined = queries.join(replies.where("reply is not null"), "key")
    return joined.select(queries["*"], F.get_json_object("reply", "$.item").alias("item"), F.coalesce(F.from_json(F.get_json_object("reply", "$.features"), "array<string>"), F.array().cast("array<string>")).alias("features"))


def rephrase(rows: DataFrame, model_id: str, client: Client = stub_client) -> DataFrame:
    """rows (key, nl_query, rephrased_query) with rephrased_query filled: kept where it is there, the query itself where no valid reply came, null without a query."""
    todo = rows.where("nl_query is not null and trim(nl_query) <> '' and rephrased_query is null")
    replies = ask(todo.select("key", F.concat(F.lit("Rephrase. Query: "), "nl_query").alias("prompt")), "rephrase", model_id, client)
    filled = F.when(F.col("rephrased_query").isNotNull(), F.col("rephrased_query")).otherwise(F.coalesce(F.get_json_object("reply", "$.rephrased_query"), "nl_query"))
    return rows.join(replies, "key", "left").withColumn("rephrased_query", filled).drop("reply", "calls")


def process_examples(pairs: DataFrame, model_id: str, seed: int = 42, max_distance: int = 10, client: Client = stub_client) -> DataFrame:
    """pairs (key, query, a, b, vocabulary) with item, buckets and a drawn conjunction; query is called original_query after.

    A pair whose item or buckets the model doesn't give is left out. Raises ValueError where a generated column is there already.
    """
    items = infer_items(pairs.select("key", "query"), model_id, client).select("key", "item")
    made = ["item", *[f"full_{b}" for b in attributes.BUCKETS], "target", *[f"selected_{b}" for b in attributes.BUCKETS], "required", "forbidden", "nl_query", "query_distance", "num_attributes"]
    named = reshape.rename_query(pairs, made)
    return attributes.generate_queries(extract_buckets(named.join(items, "key"), model_id, client).drop("calls"), "key", seed, max_distance)


def extract_visual_buckets(pairs: DataFrame, model_id: str, client: Client = stub_client, keep_failures: bool = False) -> DataFrame:
    """extract_buckets for what a model sees in two images (a, b: what the client needs of them); only gemini- models can."""
    if route(model_id) != "gemini":
        raise ValueError(f"model {model_id!r} can't read images")
    return extract_buckets(pairs, model_id, client, keep_failures)


def score_visually(pairs: DataFrame, model_id: str, seed: int = 42, max_distance: int = 10, client: Client = stub_client, keep_failures: bool = False) -> DataFrame:
    """pairs (key, item, a, b, vocabulary) with a conjunction and its distance from the images, and the model as its source.

    Failures go, or stay with neither a conjunction nor a source.
    """
    split = extract_visual_buckets(pairs, model_id, client, keep_failures).drop("calls")
    made = attributes.generate_queries(split.where("full_common is not null"), "key", seed, max_distance).withColumn("hard_negative_distance_source", F.lit(model_id))
    return made.unionByName(split.where("full_common is null"), allowMissingColumns=True) if keep_failures else made


def stable_json(messages: list[dict]) -> str:
    """Messages as text whose keys are sorted, so equal messages have equal memo keys."""
    return json.dumps(messages, sort_keys=True, ensure_ascii=False)


def ask_remembered(requests: DataFrame, kind: str, model_id: str, path: str, client: Client = stub_client, tries: int = 5, use_memo: bool = True, window: int = WINDOW) -> DataFrame:
    """ask for requests (id, prompt) with a memo of Parquet at path: what it lacks is asked once for equal prompts and added to it.

    Returns (id, reply, calls); calls stand with the replies just asked for and are 0 for remembered ones. Failures aren't
    remembered. use_memo False asks everything and writes nothing. The memo lies in folders by the first digits of its keys,
    and only those of the requests' keys are read.
    """
    opening, closing = '[{"content": ', ', "role": "user"}]'
    # to_json of one text, with the blank after its key that stable_json has
    text = F.concat(F.lit(opening), F.regexp_replace(F.to_json(F.array("prompt")), r"^\[|\]$", ""), F.lit(closing))
    keyed = requests.select("id", "prompt", memo_key(text, F.lit(model_id)).alias("key"))
    asked = keyed.select("key", "prompt").dropDuplicates(["key"])
    if not use_memo:
        return keyed.select("id", "key").join(ask(asked, kind, model_id, client, tries, window=window), "key").select("id", "reply", "calls")
    shared_dir(requests.sparkSession)
    memo = read_memo(requests.sparkSession, path, asked)
    replies = ask(asked, kind, model_id, client, tries, memo, window).checkpoint()  # the client isn't asked again when rows are read twice
    fresh = replies.where("calls > 0 and reply is not null").select("key", "reply", _shard(F.col("key")).alias("shard"))
    fresh.repartition("shard").write.mode("append").partitionBy("shard").parquet(path)  # a file a folder and run
    return keyed.select("id", "key").join(replies, "key").select("id", "reply", "calls")


def _shard(key: Column) -> Column:
    return F.substring(key, 1, SHARD_DIGITS)


def read_memo(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """(key, reply) of the memo at path, each key once; with asked (key) only the folders its keys lie in. Empty where there is no memo."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "key string, reply string")
    memo = spark.read.schema("key string, reply string, shard string").parquet(path)
    if asked is not None:
        shards = [r[0] for r in asked.select(_shard(F.col("key"))).distinct().collect()]  # 16 ** SHARD_DIGITS at most
        memo = memo.where(F.col("shard").isin(shards))
    return memo.select("key", "reply").dropDuplicates(["key"])


def compact_memo(spark: SparkSession, path: str, most_files: int = 8) -> int:
    """Rewrite the folders of a memo that have more files than most_files as one file each; returns how many.

    Runs only add files. A folder's rows are written aside before they take its place, so readers never miss one.
    """
    if not path_exists(spark, path):
        return 0
    memo = spark.read.schema("key string, reply string, shard string").parquet(path)
    files = memo.select("shard", F.col("_metadata.file_path").alias("file")).distinct()
    full = [r["shard"] for r in files.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most_files).collect()]  # 16 ** SHARD_DIGITS at most
    if full:
        shared_dir(spark)
        kept = memo.where(F.col("shard").isin(full)).dropDuplicates(["key"]).checkpoint()
        kept.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return len(full)
