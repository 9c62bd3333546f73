"""URL filter with redirect equivalence.

Host and path rules decide a URL directly, the longest rule first. Redirects and
canonical links make URLs aliases of each other; a block decided by rule for any
member of such a class holds for its undecided members. A URL that a rule allows stays
allowed whatever its aliases are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import saved
from gaugeflow.llm.components import connected_components

#: (action, host, path prefix)
Rule = tuple[str, str, str]

RULES: tuple[Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: ASCII only: other letters of a host keep their case.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SCHEME = r"(?s)^.*?://"
_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"

_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; else empty."""
    host = F.regexp_extract(url, _HOST, 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def rule_name(rule: Rule) -> str:
    return rule[1] + rule[2]


def decide(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The rule and action of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of
    equally long rules an allowing one goes first.
    """
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(rule_name(r)), r[0] == "allow")):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        name = F.when(fits, F.lit(rule_name(rule))).otherwise(name)
        action = F.when(fits, F.lit(rule[0])).otherwise(action)
    return name, action


def url_key(url: Column) -> Column:
    """What equal URLs have in common: scheme and host in lower case, the path or ``/``, and the
    query, without the fragment. Null where there is no ``://``."""
    whole = r"(?s)^(.*?)://[^/?#]*([^?#]*)(\?[^#]*)?"
    scheme, path, query = (F.regexp_extract(url, whole, i) for i in (1, 2, 3))
    lowered = F.translate(scheme, _UPPER, _UPPER.lower())
    key = F.concat(lowered, F.lit("://"), host_of(url), F.when(path == "", "/").otherwise(path), query)
    return F.when(url.rlike(_SCHEME), key)


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved; it begins with a slash."""
    segments = F.split(path, "/")
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        start,
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.concat(done, F.array(s))),
    )
    # A last dot segment stands for its folder.
    joined = F.array_join(kept, "/")
    return F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(joined, F.lit("/"))).otherwise(joined)


def _resolved(link: Column, page: Column) -> Column:
    """The URL that a link on ``page`` names; null for one that names no other document."""
    scheme = F.regexp_extract(page, r"(?s)^(.*?:)//", 1)
    site = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.when(path_of(page) == "", "/").otherwise(path_of(page)), r"(?s)^(.*/)", 1)
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)", 1)
    return (
        F.when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:|^#"), F.lit(None))
        .when(link.startswith("?"), F.concat(site, path_of(page), link))
        .when(link.startswith("/"), F.concat(site, _without_dots(path), rest))
        .otherwise(F.concat(site, _without_dots(F.concat(folder, path)), rest))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias links (src, dst) of pages: all canonical links and refresh redirects.

    Relative links are resolved against the page's URL, ``&`` written as an entity is
    decoded; links to a place in the page and to other than documents (``mailto:``) are
    left out. Both ends are as :func:`url_key` gives them. Pages without a URL or HTML
    have no links, repeated ones count once.
    """
    page = F.col(url)
    found = F.concat(
        F.regexp_extract_all(F.col(html), F.lit(_CANONICAL), F.lit(1)),
        F.regexp_extract_all(F.col(html), F.lit(_REFRESH), F.lit(1)),
    )
    marked = F.col(html).rlike(r"(?i)<link\b|http-equiv")
    links = pages.where(page.rlike(_SCHEME) & marked).select(page.alias("page"), F.explode(found).alias("link"))
    named = links.select("page", F.regexp_replace("link", r"(?i)&(amp|#38|#x26);", "&").alias("link")).where("link <> ''")
    resolved = named.select(url_key(F.col("page")).alias("src"), url_key(_resolved(F.col("link"), F.col("page"))).alias("dst"))
    return resolved.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()


def aliased_verdicts(
    pages: DataFrame, links: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", id_col: str = "page_id"
) -> DataFrame:
    """Host, path, rule and verdict of every page.

    ``pages``: ``page_id`` and ``url``; ``links``: (src, dst) URLs that are aliases,
    redirects as well as canonical links; URLs are the same if their :func:`url_key` is.
    Links without one are left out. Returns page_id, host, path, rule, verdict
    and alias_blocked (whether the verdict came from an alias). Targets that no page
    has count as members of their class. A null URL, or one without ``://``, has empty
    host and path, fits no rule and is allowed. Repeated rows each keep a row.

    Only URLs that occur in links take part in the components; the verdict goes back
    to the pages by a join on the URL, which Spark may split for a hot one. URLs are
    known by 128 bits of their SHA-256 in the components.
    """
    keyed = links.select(url_key(F.col("src")).alias("src"), url_key(F.col("dst")).alias("dst"))
    edges = saved(keyed.where(F.col("src").isNotNull() & F.col("dst").isNotNull()), "links")

    def node(alias: str) -> Column:
        return F.substring(F.sha2(F.col(alias).cast("binary"), 256), 1, 32)

    ends = edges.select(F.col("src").alias("alias")).union(edges.select(F.col("dst")))
    nodes = ends.distinct().withColumn("node", node("alias"))
    classes = connected_components(edges.select(node("src").alias("a"), node("dst").alias("b")))
    _, action = decide(host_of(F.col("alias")), path_of(F.col("alias")), rules)
    members = nodes.join(classes, "node").withColumn("action", action)
    blocked = members.where(F.col("action") == "block").select("component").distinct()
    # One row per URL whose class holds a blocked member.
    hit = saved(members.join(blocked, "component", "left_semi").select("alias").distinct(), "hit")
    page = F.col(url)
    rule, own = decide(F.col("host"), F.col("path"), rules)
    own_rows = pages.select(id_col, url_key(page).alias("alias"), host_of(page).alias("host"), path_of(page).alias("path"))
    judged = own_rows.withColumn("rule", rule).withColumn("own", own)
    inherited = F.col("own").isNull() & F.col("hit").isNotNull()
    return judged.join(hit.withColumn("hit", F.lit(1)), "alias", "left").select(
        id_col,
        "host",
        "path",
        "rule",
        F.coalesce("own", F.when(inherited, F.lit("block")), F.lit("allow")).alias("verdict"),
        inherited.alias("alias_blocked"),
    )
