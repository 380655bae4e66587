"""Language detection: a model of letter triples fitted and applied by joins, and the boundary to any other detector.

The model is naive Bayes over runs of three letters or blanks. It keeps a bounded number of triples, the commonest, so it can
be broadcast whatever it was fitted on. Texts are told apart by their hash: equal texts are one text, so a text that a third
of all rows share is told once, and only hashes and sums are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sampling import free_name
from ..session import shared_dir

Detector = Callable[[str], str]
#: Triples a model keeps at most.
TRIPLES = 20_000
#: Frequent words the stand-in counts (fixed values).
COMMON = {"en": ("the", "of", "and", "to", "is", "with"), "de": ("der", "die", "und", "das", "ist", "nicht"), "fr": ("le", "la", "les", "et", "un", "que")}


@dataclass
class Model:
    """languages, the weight a triple has in each that the model doesn't know, and a table (triple, weights) of at most TRIPLES rows."""

    languages: list[str]
    unknown: list[int]
    weights: DataFrame


def triples(text: Column) -> Column:
    """The letter triples of a text, overlapping: runs of letters in lower case, one blank around each; none for null or a text without a letter."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))
    return F.when(F.length(plain) > 2, F.regexp_extract_all(plain, F.lit("(?=(...))"), F.lit(1)))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", most: int = TRIPLES) -> Model:
    """The model of labelled rows; rows without a label or a letter are left out, and no rows give a model that knows no language.

    A weight is 1000 times the logarithm of a triple's share in a language, as a whole number. The commonest triples are
    kept, the smaller one of two as common. Only counts per language and triple are shuffled.
    """
    shared_dir(rows.sparkSession)
    found = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), triples(F.col(text)).alias("triples")).select("lang", F.explode_outer("triples").alias("triple")).where("triple is not null")
    counts = found.groupBy("lang", "triple").agg(F.count("*").alias("n")).checkpoint()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row per language
    languages = sorted(totals)
    weight = lambda n, x: F.round(1000 * F.log((n + 1) / F.lit(float(totals[x] + most)))).cast("bigint")
    told = [F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in languages]
    kept = counts.groupBy("triple").agg(F.sum("n").alias("all"), F.array(*told).alias("n")).orderBy(F.desc("all"), "triple").limit(most)
    weights = kept.select("triple", F.array(*[weight(F.get("n", F.lit(k)), x) for k, x in enumerate(languages)]).cast("array<bigint>").alias("weights")).checkpoint()
    unknown = weights.sparkSession.range(1).select(F.array(*[weight(F.lit(0), x) for x in languages]).cast("array<bigint>")).first()[0]
    return Model(languages, unknown, weights)


def told(texts: DataFrame, text: str, model: Model) -> DataFrame:
    """(key, lang) of the distinct texts that have a letter; key is the text's MD5. The later language by name wins a tie."""
    hashed = texts.select(F.md5(F.col(f"`{text}`").cast("binary")).alias("key"), triples(F.col(f"`{text}`")).alias("triples"))
    # a step of its own, or each triple would hash its text; outer, or a filter ahead would find the triples twice more
    found = hashed.select("key", F.explode_outer("triples").alias("triple")).where("triple is not null")
    weighed = found.join(F.broadcast(model.weights), "triple", "left")
    sums = [F.sum(F.coalesce(F.get("weights", F.lit(k)), F.lit(n))) for k, n in enumerate(model.unknown)]
    scores = F.array(*[F.struct(s.alias("score"), F.lit(x).alias("lang")) for s, x in zip(sums, model.languages, strict=True)])
    best = F.array_max(scores)["lang"] if model.languages else F.lit(None).cast("string")
    return weighed.groupBy("key").agg(best.alias("lang"))  # rows of one text only multiply its sums


def tell(rows: DataFrame, text: str, model: Model, name: str = "lang") -> DataFrame:
    """rows with column name: the language whose weights of a whole text's triples add up to most; null for null, for a text without a letter and from a model that knows no language."""
    key, there = free_name(rows, "key"), free_name(rows, "there")
    known = told(rows, text, model).select(F.col("key").alias(there), F.col("lang").alias(free_name(rows, name)))
    joined = rows.withColumn(key, F.md5(F.col(f"`{text}`").cast("binary"))).join(known, F.col(key) == F.col(there), "left")
    return joined.withColumn(name, F.col(free_name(rows, name))).drop(key, there, free_name(rows, name))


def stand_in(text: str) -> str:
    """The language most of whose frequent words a text holds, the first of a tie; raises ValueError where it holds none."""
    words = "".join(c if "a" <= c <= "z" or "à" <= c <= "ö" or "ø" <= c <= "ÿ" else " " for c in text.lower()).split()
    hits = {lang: sum(w in own for w in words) for lang, own in COMMON.items()}
    best = max(hits, key=hits.get)
    if not hits[best]:
        raise ValueError("no known word")
    return best


def detect(rows: DataFrame, text: str, name: str = "lang", detector: Detector | Model = stand_in) -> DataFrame:
    """rows with column name: the language of a whole text by a model of fit() or by a function; null where that raises or the text is null."""
    if isinstance(detector, Model):
        return tell(rows, text, detector, name)

    def told(x: str | None) -> str | None:
        try:
            return None if x is None else detector(x)
        except Exception:  # any failure rejects the text
            return None

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(told).astype(object)

    return rows.withColumn(name, run(F.col(f"`{text}`")))


def only(rows: DataFrame, texts: list[str], language: str, detector: Detector | Model = stand_in) -> DataFrame:
    """Rows all of whose texts are in a language; a failure rejects the row."""
    kept = rows
    for text in texts:
        name = free_name(rows, "told")
        kept = detect(kept, text, name, detector).where(F.col(name) == language).drop(name)
    return kept
