"""URL filters: host and path rules, and block decisions carried over to aliases by redirect equivalence."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import cut
from .graph import connected_components

#: Production rules: (verdict, host followed by the beginning of a path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Tags end at the next bracket of either kind, so unclosed ones cost no second look at what follows.
_LINK_TAG, _BASE_TAG = r"(?is)<(?:link|meta)\s[^<>]*>", r"(?is)<base\s[^<>]*>"


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def url_node(url: Column) -> Column:
    """The url without its fragment and with its scheme and host in lower case: what a server sees."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?://)", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(scheme, url_host(url), rest))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null.  Of equal strings ``block`` wins.

    Rules are found by the host's suffixes, so the cost is the number of labels, not of rules.
    """
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        by_host.setdefault(rule.partition("/")[0], []).append((rule, rule[rule.index("/") :], verdict))
    entries = []
    for h, own in sorted(by_host.items()):
        entries += [F.lit(h), F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for r, p, v in own])]
    table = F.create_map(*entries)
    labels = F.size(F.split(host, r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), labels), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    own = F.flatten(F.transform(F.filter(suffixes, lambda s: F.map_contains_key(table, s)), lambda s: table[s]))
    fits = F.filter(own, lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def resolve(page: str | None, base: str | None, target: str | None) -> str | None:
    """The full url that a link of a page means (RFC 3986), with character references decoded; null where there is none."""
    try:
        return urljoin(urljoin(page, html.unescape(base or "").strip()), html.unescape(target).strip())
    except (TypeError, ValueError):
        return None


@F.pandas_udf(StringType())
def _resolved(page: pd.Series, base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([resolve(*link) for link in zip(page, base, target)], dtype=object)


def alias_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) between a page's url and the targets of its canonical links and meta refreshes.

    Only the tags of pages that hold such links reach Python, where they are resolved against the page or its ``base``.
    """
    text = F.col(html_col)
    tags = F.explode(F.regexp_extract_all(text, F.lit(_LINK_TAG), F.lit(0)))
    base = _attribute(F.regexp_extract(text, _BASE_TAG, 0), "href")
    held = pages.where(text.rlike(r"(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), base.alias("base"), tags.alias("tag"))
    tag = F.col("tag")
    refresh = F.regexp_extract(_attribute(tag, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)
    canonical = F.lower(_attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)")
    target = F.when(canonical, _attribute(tag, "href")).when(F.lower(_attribute(tag, "http-equiv")) == "refresh", refresh)
    linked = held.select("url", "base", F.trim(target).alias("target")).where("url is not null and target <> ''")
    return cut(linked.select(url_node(F.col("url")).alias("src"), url_node(_resolved("url", "base", "target")).alias("dst")))


def judge_urls(pages: DataFrame, rules=RULES, *, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict) for every page row.

    A page's own longest fitting rule decides, so an explicit allow is never overruled.  A page without
    a rule is blocked if its component of redirect and canonical edges holds a url that a rule blocks,
    whether or not that url is a page; else it is allowed.  ``edges(src, dst)`` (urls) adds redirects known from elsewhere.
    Null urls and urls without ``://`` have empty host and path, fit nothing and are allowed.  Repeated rows
    give repeated rows; null html has no links; other columns are not read.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    parts = pages.select(F.col(id_col), F.col(url_col).alias("_u"), host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("_r", fitting_rule(F.col("host"), F.col("path"), rules))
    known = alias_edges(pages, url_col=url_col, html_col=html_col)
    if edges is not None:
        known = known.union(edges.select(url_node(F.col("src")), url_node(F.col("dst"))))
    component = connected_components(known)
    own = fitting_rule(url_host(F.col("node")), url_path(F.col("node")), rules)
    bad = component.where(own["verdict"] == "block").select("component").distinct()
    blocked = component.join(bad, "component", "left_semi").select(F.col("node").alias("_n"), F.lit(True).alias("_b"))
    joined = ruled.withColumn("_n", url_node(F.col("_u"))).join(blocked, "_n", "left")
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("_b"), "block"), F.lit("allow"))
    return joined.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"))
