"""String, map and closeness helpers of the mining and run-analysis plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a negated feature opens with (fixed values).
NEGATIONS = ("no ", "not ", "without ", "doesn't have ", "does not have ")


def first_number_token(name: Column) -> Column:
    """The first token between underscores that has digits only, as a whole number; null without one."""
    return F.get(F.filter(F.split(name, "_"), lambda x: x.rlike("^[0-9]+$")), F.lit(0)).cast("bigint")


def token_after(name: Column, mark: str) -> Column:
    """What stands between a mark followed by '-' and the next underscore; null where the mark is missing."""
    return F.try_element_at(F.split(F.try_element_at(F.split(name, f"{mark}-"), F.lit(2)), "_"), F.lit(1))


def last_path_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_filename(name: Column) -> Column:
    """Runs of other than letters, digits, dot, underscore and hyphen become one underscore; none at the ends."""
    return F.trim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))


#: Endings of views' item ids and of sized files (fixed values).
VIEW_SUFFIX = r"_\d+_(front|back|side|full|additional|flat)$"
SIZED_FILE = r"_(\d+)\.jsonl$"


def product_of_view(item_id: Column) -> Column:
    """An image's item id without its view suffix, such as _1_front."""
    return F.regexp_replace(item_id, VIEW_SUFFIX, "")


def category_or_unknown(value: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(value), F.lit("")), F.lit("unknown"))


def size_of_file(name: Column) -> Column:
    """The number a file name like x_1000.jsonl ends with; null without one."""
    return F.nullif(F.regexp_extract(name, SIZED_FILE, 1), F.lit("")).cast("bigint")


def with_suffix(name: Column, old: str, new: str) -> Column:
    """A name whose ending old is new instead; one that ends otherwise gets new behind it."""
    return F.when(name.endswith(old), F.concat(F.substring(name, F.lit(1), F.length(name) - len(old)), F.lit(new))).otherwise(F.concat(name, F.lit(new)))


def relative_path(path: Column, folder: Column) -> Column:
    """A path as seen from a folder: one step up for each part of the folder that the path doesn't share."""
    parts = lambda p: F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    a, b = parts(path), parts(folder)
    apart = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda i: ~F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False)))
    shared = F.array_min(apart)
    up = F.array_repeat(F.lit(".."), F.size(b) - shared)
    out = F.array_join(F.concat(up, F.slice(a, shared + 1, F.size(a))), "/")
    return F.when(out == "", ".").otherwise(out)


def close_to(a: Column, b: Column | float, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def truthy(text: Column) -> Column:
    return F.lower(text.cast("string")).isin("true", "1", "t", "y", "yes")


def created_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO time, 0 where it can't be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text)), F.lit(0))


def first_present(values: Column, keys: list[str]) -> Column:
    """The value of the first key the map contains, even where that value is null."""
    out = F.when(F.map_contains_key(values, keys[0]), F.try_element_at(values, F.lit(keys[0])))
    for key in keys[1:]:
        out = out.when(F.map_contains_key(values, key), F.try_element_at(values, F.lit(key)))
    return out


def starts_with_negation(text: Column) -> Column:
    """Does a feature open with a negation?"""
    low = F.lower(text)
    return reduce(lambda x, y: x | y, [low.startswith(n) for n in NEGATIONS])


def utc_now() -> Column:
    """The moment a query runs as ISO text in UTC, whatever the session's time zone."""
    now = F.to_utc_timestamp(F.current_timestamp().cast("timestamp"), F.current_timezone())
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
