"""URL filters with redirect equivalence, in DataFrame functions only.

1. Every url is split into host and path and matched against the rules: a rule fits its host and all subdomains when the
   path starts with the rule's path; the longest rule wins.
2. Edges join urls that stand for the same page: an HTML redirect (``http-equiv=refresh``) or a canonical link
   (``rel=canonical``, ``og:url``) in the page, rows of an optional redirect table, and each url with its plain form
   (lower-case scheme and host, default port, fragment and ``utm_`` parameters away).
3. Urls with the same plain form are one vertex, so only edges between different plain forms reach the distributed
   connected components; a table without redirects never iterates.
4. A block on any url of a component spreads to its aliases that no rule names.  An explicit allow takes precedence: it keeps
   the url it names, and a component with an allowed url passes no block on.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and no alias, and is allowed; a
redirect to a page outside the table still joins its sources; rows with equal urls get equal verdicts; an empty table
gives an empty result; extra columns pass through except host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.operators.iterate import connected_components
from isoweave.llm.op6_license import LOWER, UPPER
from isoweave.operators.joins import lookup
from isoweave.runtime import cut, table

#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """A-Z lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without it."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_of(url: Column) -> Column:
    """One form for urls that differ in scheme, letter case of the host, default port, fragment or tracking only."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")), "&")
    host = F.regexp_replace(host_of(url), r":(?:80|443)$", "")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return (F.lit(rule_host == "") | (host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def judged(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule and the rule's verdict (null without one).

    The rules are a short list; the longest host and path come first in one expression, so the first that fits wins.
    """
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    named, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in reversed(order):
        fits = _fits(F.col("host"), F.col("path"), host, path)
        named, said = F.when(fits, host + path).otherwise(named), F.when(fits, verdict).otherwise(said)
    return out.withColumns({"rule": named, "_said": said})


def _attribute(tag: Column, name: str) -> Column:
    got = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    value = F.regexp_replace(got, rf"(?is)^\s{name}\s*=\s*[\"']?|[\"']$", "")
    return F.replace(F.trim(value), F.lit("&amp;"), F.lit("&"))


def targets_of(html: Column, url: Column) -> Column:
    """Urls that a page names as its redirect or canonical form; relative ones are resolved against the page's."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:meta|link)\b[^>]*>"), F.lit(0))
    tags = F.filter(tags, lambda t: t.rlike(r"(?is)\srel\s*=\s*[\"']?canonical\b|\sproperty\s*=\s*[\"']?og:url\b|http-equiv\s*=\s*[\"']?refresh\b"))
    raw = F.transform(tags, lambda t: F.when(t.rlike(r"(?is)^<link"), _attribute(t, "href")).when(
        t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"), F.regexp_replace(F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*(.*)$", 1), r"^['\"]|['\"]$", "")
    ).otherwise(_attribute(t, "content")))
    scheme, site = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(site, F.regexp_extract(F.concat(path_of(url), F.lit("")), r"(?s)^(.*/)?", 0))
    return F.filter(F.transform(raw, lambda x: F.when(F.contains(x, F.lit("://")), x).when(x.startswith("//"), F.concat(scheme, x)).when(x.startswith("/"), F.concat(site, x)).when(x != "", F.concat(F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder), x))), lambda x: x.isNotNull())


def edges_of(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(src, dst) between different plain forms; ``redirects`` has the columns ``from_url`` and ``to_url``."""
    gate = F.coalesce(F.col(html).rlike(r"(?i)canonical|og:url|http-equiv"), F.lit(False))
    found = pages.where(gate).select(F.col(url).alias("_from"), F.explode(targets_of(F.col(html), F.col(url))).alias("_to"))
    if redirects is not None:
        found = found.union(redirects.select("from_url", "to_url"))
    return found.select(plain_of(F.col("_from")).alias("src"), plain_of(F.col("_to")).alias("dst")).where("src != dst").distinct()


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", html: str = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``component`` (a name of the group of aliases, null for no url)."""
    names = pages.columns
    rest, added = [f"_{i}" for i in range(len(names))], ["host", "path", "rule", "verdict", "component"]
    pages, html = pages.toDF(*rest), rest[names.index(html)]  # no name of theirs can meet one of ours
    url = rest[names.index(url)]
    if redirects is not None:
        named = judged(redirects.select(F.explode(F.array("from_url", "to_url")).alias(url)), rules, url)
    members = cut(connected_components(edges_of(pages, url, html, redirects), tail=0))
    rows = judged(pages, rules, url).withColumn("_plain", plain_of(F.col(url)))
    known = rows.select("_plain", "_said")
    if redirects is not None:
        known = known.union(named.select(plain_of(F.col(url)), "_said"))
    # a vertex outside the table is judged by its own plain form
    outside = members.select(F.col("node").alias("_plain"), F.concat(F.lit("http://"), "node").alias(url))
    known = known.union(judged(outside, rules, url).select("_plain", "_said"))
    # Only the few decisions of a plain form go on: a hot page is pre-aggregated before any shuffle.
    forms = known.where("_plain is not null and _said is not null").groupBy("_plain").agg(
        F.max((F.col("_said") == "allow").cast("int")).alias("_allow"), F.max((F.col("_said") == "block").cast("int")).alias("_block"))
    forms = forms.join(members, forms["_plain"] == members["node"], "left").select(F.coalesce("component", "_plain").alias("_component"), "_allow", "_block")
    groups = forms.groupBy("_component").agg(F.max("_allow").alias("_allow"), F.max("_block").alias("_block")).where("_block = 1 and _allow = 0").select("_component", F.lit(True).alias("_spread"))
    # Every plain form that has aliases or a block to pass on, once.
    alone = groups.join(members, groups["_component"] == members["node"], "left_anti").select(F.col("_component").alias("_plain"), F.col("_component").alias("_joined"), "_spread")
    named_forms = members.join(groups, members["component"] == groups["_component"], "left").select(F.col("node").alias("_plain"), F.col("component").alias("_joined"), "_spread")
    # Urls that a rule names need no lookup; the others ask by their plain form, of which a hot page may have many.
    settled = rows.where("_said is not null").withColumns({"verdict": F.col("_said"), "component": F.col("_plain")})
    asking = lookup(rows.where("_said is null"), cut(named_forms.union(alone)), "_plain")
    asking = asking.withColumns({"verdict": F.when(F.col("_spread"), "block").otherwise("allow"), "component": F.coalesce("_joined", "_plain")})
    keep = [(c, n) for c, n in zip(rest, names) if n not in added] + [(c, c) for c in added]
    return settled.select(*[c for c, _ in keep]).union(asking.select(*[c for c, _ in keep])).toDF(*[n for _, n in keep])


def op4_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op4_redirect_equivalence": op4_redirect_equivalence}
ORACLES = {}
