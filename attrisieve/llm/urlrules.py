"""Operator 6: URL filters over redirect-equivalent pages, with DataFrame functions only.

A page's own rule is the longest one that fits its URL. Pages without a rule take the decision of their aliases: pages are
joined by canonical links and redirects found in their html, components of that graph are computed distributedly, and a
component with a blocked member blocks the rest, unless a member is explicitly allowed, which wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, own_columns
from .components import connected_components

#: (host, path) of the query's rules, by verdict (fixed values).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Entities resolved in attributes, the ampersand's last (fixed values).
ENTITIES = (("(?i)&quot;|&#34;|&#x22;", '"'), ("(?i)&#39;|&#x27;|&apos;", "'"), ("(?i)&lt;|&#60;|&#x3c;", "<"), ("(?i)&gt;|&#62;|&#x3e;", ">"), ("(?i)&amp;|&#38;|&#x26;", "&"))
_ASCII_UP, _ASCII_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: Column) -> Column:
    return F.translate(c, _ASCII_UP, _ASCII_LOW)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no '://'."""
    after = F.expr("CASE WHEN instr(_url, '://') > 0 THEN substring(_url, instr(_url, '://') + 3) END")
    host = _lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<verdict, rule>; null where none does. Of equally long ones the longer host wins, then allow."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0]))
    out = None
    for verdict, rule_host, rule_path in ordered:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def url_key(url: Column) -> Column:
    """What aliases are matched by: the URL without scheme and fragment, host lower-cased; null where there is no host."""
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]*://([^#]*)", 1)
    host = _lower(F.regexp_extract(rest, r"(?s)^([^/?]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?]*(.*)$", 1)
    return F.when(host != "", F.concat(host, F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not, its commonest entities resolved; empty if there is none."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)])
    for entity, sign in ENTITIES:
        value = F.regexp_replace(value, entity, sign)
    return F.trim(F.regexp_replace(value, r"[\t\n\f\r]", " "))


def _targets(html: Column) -> Column:
    """URLs a page declares itself the same as: rel=canonical links and refresh redirects outside comments."""
    shown = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", "")
    tags = F.regexp_extract_all(shown, F.lit(r"(?is)<(?:link|meta)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))
    canonical = lambda t: t.rlike("(?i)^<link") & F.lower(_attribute(t, "rel")).rlike(r"(?:^|\s)canonical(?:\s|$)")
    refresh = lambda t: t.rlike("(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh")
    goal = lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)^[\s\d.]*[;,]?\s*url\s*=\s*[\"']?\s*([^\"']*)", 1)
    found = F.transform(tags, lambda t: F.trim(F.when(canonical(t), _attribute(t, "href")).when(refresh(t), goal(t)).otherwise("")))
    return F.filter(found, lambda u: u != "")


def _absolute(target: Column, url: Column) -> Column:
    """A target against the URL of its page; a relative path counts from the page's folder."""
    origin = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^([^:/?#]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    rooted = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    scheme = F.regexp_extract(url, r"(?s)^([^:/?#]*:)//", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, target))
        .otherwise(F.concat(rooted, target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) URL keys a page's html declares the same; pages has url and html."""
    telling = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    rows = telling.select("url", F.explode(_targets(F.col("html"))).alias("target"))
    return rows.select(url_key(F.col("url")).alias("a"), url_key(_absolute(F.col("target"), F.col("url"))).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) per row of pages.

    redirects may bring further edges (source, target URLs). A page that a rule fits has that rule's verdict whatever its
    aliases have. Any other is allowed when its component has an explicit allow, else blocked when it has a block, else
    allowed. alias_of: the smallest URL key of the component, null for a page with no alias. Null URLs and those without
    '://' have empty host and path, no rule and no alias, and are allowed; null html declares nothing; repeated rows are
    judged alike; an empty table gives no rows; other columns are ignored. An html of any length is searched whole, in one row.
    """
    source = own_columns(pages, page_id=id_col, _url=url_col, html=html_col)
    host, path = split_url(F.col("_url"))
    parts = source.select("page_id", host.alias("host"), path.alias("path"), url_key(F.col("_url")).alias("key"))
    ruled = parts.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    edges = alias_edges(source.select(F.col("_url").alias("url"), "html"))
    if redirects is not None:
        more = redirects.select(url_key(F.col("source")).alias("a"), url_key(F.col("target")).alias("b"))
        edges = edges.union(more.where("a is not null and b is not null"))
    stars = connected_components(edges).withColumnRenamed("node", "key").withColumnRenamed("root", "alias_of")
    # a page without a key, or without an alias, has nothing to be joined to: all such would meet in one task
    keyed = checkpoint(ruled.where("key is not null").join(stars, "key", "left"))
    own = keyed.where("alias_of is not null")
    votes = own.groupBy("alias_of").agg(F.max((F.col("fit.verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("fit.verdict") == "block").cast("int")).alias("blocked"))
    from_aliases = F.when((F.coalesce("allowed", F.lit(0)) == 0) & (F.coalesce("blocked", F.lit(0)) == 1), "block").otherwise("allow")
    columns = ["page_id", "host", "path", F.col("fit.rule").alias("rule")]
    heard = own.join(votes, "alias_of").select(*columns, F.coalesce("fit.verdict", from_aliases).alias("verdict"), "alias_of")
    alone = keyed.where("alias_of is null").drop("alias_of").unionByName(ruled.where("key is null"))
    return heard.unionByName(alone.select(*columns, F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("alias_of")))
