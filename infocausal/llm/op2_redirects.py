"""URL filter with redirect equivalence.

Rules (host, path) judge single urls. Redirects (meta refresh) and canonical links found in the
pages' html are edges between urls, and so is what servers commonly redirect: a url with tracking
parameters or a `www.`, `m.` or `amp.` host leads to the url without. A block decision of a rule on
any url of a connected component, whether a page of that url exists or not, holds for its aliases.
A url's own rule comes first, so an explicit allow is kept.

Defined cases: a null url or one without `://` has empty host and path, no rule and the verdict
allow; relative link targets resolve against the page's host; null or empty html has no edges;
repeated pages are returned as often as they come; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from infocausal.llm.common import materialize
from infocausal.operators.components import connected_components


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<link\b(?=[^>]*[\s\"']rel\s*=\s*[\"']?canonical\b)[^>]*?[\s\"']href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
#: Query parameters that only tell where a reader came from, and labels of hosts that show the same pages.
_TRACKING = r"(?<=[?&])(?:ref|utm_[a-z]+|gclid|fbclid)=[^&]*(?:&|$)"
_SAME_SITE = r"^(?:www|m|amp)\.(?=[^.]+\.)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*['\"]?([^\"'>\s]+)"


def _lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)


def _key(url: Column) -> Column:
    """What makes two urls the same node: host, path and query; null without `://`."""
    return F.when(url.contains("://"), F.concat(host(url), path(url), _query(url)))


def plain_url(url: Column) -> Column:
    """The url that the common redirects lead to; null without `://`."""
    query = F.regexp_replace(F.regexp_replace(_query(url), _TRACKING, ""), "[?&]+$", "")
    return F.when(url.contains("://"), F.concat(F.lit("https://"), F.regexp_replace(host(url), _SAME_SITE, ""), path(url), query))


def _fits(h: Column, p: Column, rule: Rule) -> Column:
    return ((h == rule.host) | h.endswith("." + rule.host)) & p.startswith(rule.path)


def rule_of(h: Column, p: Column, rules: tuple[Rule, ...]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, or null. For a list of rules in the code."""
    kind = "struct<rule:string,verdict:string>"
    out = F.lit(None).cast(kind)
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(_fits(h, p, r), value).otherwise(out)
    return out


def rules_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As rule_of, for a rule table of any size: an equi-join on every suffix of the host.

    urls: id, host, path. rules: host, path, verdict. Returns id, rule, verdict for ids with a rule.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    r = rules.select(
        F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict"
    )
    hits = urls.select("id", "path", F.explode(suffixes).alias("suffix")).join(r, "suffix")
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict"))
    return (
        hits.filter(F.col("path").startswith(F.col("rule_path"))).groupBy("id").agg(best.alias("b"))
        .select("id", "b.rule", "b.verdict")
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: urls of redirect and canonical-link edges, targets made absolute."""
    link = F.coalesce(*[F.nullif(F.regexp_extract(html, _LINK, i), F.lit("")) for i in (1, 2, 3)])
    refresh = F.nullif(F.regexp_extract(html, _REFRESH, 1), F.lit(""))
    near = pages.filter(F.col(html).rlike("(?i)canonical|http-equiv") & F.col(url).contains("://"))
    raw = near.select(F.col(url).alias("src"), F.explode(F.array_compact(F.array(link, refresh))).alias("to"))
    base = F.regexp_extract("src", r"(?s)^(.*?)://", 1)
    folder = F.regexp_replace(path(F.col("src")), r"[^/]*$", "")
    start = F.concat(base, F.lit("://"), host(F.col("src")))
    to = F.replace(F.trim("to"), F.lit("&amp;"), F.lit("&"))
    dst = (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.startswith("//"), F.concat(base, F.lit(":"), to))
        .when(to.startswith("/"), F.concat(start, to))
        .otherwise(F.concat(start, F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return raw.select("src", dst.alias("dst"))


def common_redirects(urls: DataFrame) -> DataFrame:
    """src, dst for the urls (src) that differ from their plain form."""
    return urls.select("src", plain_url(F.col("src")).alias("dst")).filter(_key(F.col("src")) != _key(F.col("dst")))


def judge(
    pages: DataFrame, edges: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
    page_id: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """page_id, host, path, rule, verdict, source (rule, alias or none). `edges` (src, dst urls) are added to the pages' own."""
    found = link_edges(pages, url, html)
    if edges is not None:
        found = found.unionByName(edges.select("src", "dst"))
    known = pages.select(F.col(url).alias("src")).unionByName(found.select(F.col("dst").alias("src")))
    found = materialize(found.unionByName(common_redirects(known)).filter("src is not null and dst is not null"), "links")
    own = pages.select(
        F.col(page_id).alias("page_id"),
        host(F.col(url)).alias("host"),
        path(F.col(url)).alias("path"),
        _key(F.col(url)).alias("key"),
    ).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    if found.isEmpty():
        judged = own.withColumn("alias_blocked", F.lit(False))
    else:
        urls = found.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
        nodes = urls.select(_key(F.col("url")).alias("node"), rule_of(host(F.col("url")), path(F.col("url")), rules).alias("r"))
        blocked = nodes.filter("r.verdict = 'block'").select("node").distinct()
        parts = materialize(
            connected_components(found.select(_key(F.col("src")).alias("src"), _key(F.col("dst")).alias("dst"))), "parts"
        )
        bad = parts.join(blocked, "node", "left_semi").select("component").distinct()
        hit = parts.join(bad, "component", "left_semi").select(F.col("node").alias("key"), F.lit(True).alias("alias_blocked"))
        judged = own.join(hit, "key", "left").withColumn("alias_blocked", F.coalesce("alias_blocked", F.lit(False)))
    return judged.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("alias_blocked"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("r").isNotNull(), "rule").when(F.col("alias_blocked"), "alias").otherwise("none").alias("decided_by"),
    )
