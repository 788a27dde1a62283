"""URL rules whose block decisions reach aliases, in DataFrame operations alone.

A rule has a host and a path. It fits its host and all subdomains if the URL's
path starts with the rule's; the longest rule that fits decides. Pages that name
another address as theirs (``<link rel="canonical">``, ``<meta http-equiv="refresh">``,
or rows of a table of redirects) form classes, by distributed connected components
over those edges. A page without a rule of its own takes its class's decision:
allow if any alias is explicitly allowed, else block if any is blocked, else allow.
A page's own rule, above all an explicit allow, always stands.

Nulls: a null URL, or one without ``://``, has an empty host and path, no rule and
no aliases, and is allowed. Repeated rows each keep a row. Null html has no links. An empty
table has no rows. Very long pages are read in time linear in their length, closed tags or not.
Other columns of ``pages`` are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import looked_up, table, written
from flowloom.llm.graph import components

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules that are written into the plan as one expression; more are joined by host.
INLINE = 200
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def with_rule(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits ``host`` and ``path``.

    Of two rules of equal length, the first in order of host and path decides.
    """
    host, path = F.col("host"), F.col("path")
    if isinstance(rules, tuple):
        out = F.lit(None).cast("struct<rule:string,rule_verdict:string>")
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]), reverse=True):
            fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
            out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("rule_verdict"))).otherwise(out)
        return urls.withColumn("__rule", out).select(*urls.columns, "__rule.rule", "__rule.rule_verdict")
    # A table of rules (verdict, host, path): join each suffix of each distinct host and path once.
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    asked = urls.select("host", "path").distinct()
    rule = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    found = asked.withColumn("suffix", suffix).join(rule, "suffix").where(F.col("path").startswith(F.col("start")))
    rank = F.struct(-F.char_length(F.concat("suffix", "start")), "suffix", "start")
    best = found.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("suffix", "start").alias("rule"), F.col("verdict").alias("rule_verdict")), rank).alias("__rule"))
    joined = urls.join(best, ["host", "path"], "left")
    return joined.select(*(F.col(f"`{c}`") for c in urls.columns), "__rule.rule", "__rule.rule_verdict")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's address and each one that its html names as canonical or sends to."""
    html = F.regexp_replace("html", r"(?s)<!--.*?(-->|\z)", " ")
    # A tag reaches from its name to the next ">". All that repeats here is possessive, so time is linear in the page.
    pieces = F.split(html, ">")
    tags = lambda name: F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.regexp_extract(x, rf"(?is)<{name}\b.*+", 0))
    links = F.filter(tags("link"), lambda x: x.rlike(r"""(?is)\brel\s*+=\s*+["']?canonical\b"""))
    metas = F.filter(tags("meta"), lambda x: x.rlike(r"""(?is)\bhttp-equiv\s*+=\s*+["']?refresh\b"""))
    value = lambda tag, name: F.regexp_extract(tag, rf"""(?is)\b{name}\s*+=\s*+["']?\s*+([^"'>\s]++)""", 1)
    targets = F.concat(F.transform(links, lambda x: value(x, "href")), F.transform(metas, lambda x: value(x, "url")))
    # Links come through entities; those of & alone are usual in addresses.
    plain = F.transform(targets, lambda x: F.regexp_replace(x, "(?i)&(amp|#38|#x26);", "&"))
    some = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select(F.col("url").alias("a"), F.explode(plain).alias("target")).where("target <> '' and a is not null")
    return some.select("a", resolved(F.col("a"), F.col("target")).alias("b"))


def resolved(base: Column, target: Column) -> Column:
    """A link's address as seen from ``base``: absolute, of the same scheme, site or folder, or of the page itself."""
    scheme = F.regexp_extract(base, r"^[^:/?#]+:", 0)
    site = F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*", 0)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(page, r"^.*/", 0))
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(page, target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), target))
        .otherwise(F.concat(folder, target))
    )
    head = F.regexp_extract(whole, r"^[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(F.substring(whole, F.char_length(head) + 1, F.char_length(whole)), r"^[^?#]*", 0)
    rest = F.substring(whole, F.char_length(head) + F.char_length(path) + 1, F.char_length(whole))
    parts = F.split(path, "/")
    empty = F.expr("cast(array() as array<string>)")
    # Segments "." and ".." are walked; a path that ends in one ends in a slash.
    walk = F.aggregate(parts, empty, lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))))
    walked = F.concat(F.array_join(walk, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(path.contains("/."), F.concat(head, walked, rest)).otherwise(whole)


def address(url: Column) -> Column:
    """What names a node: the address without its fragment, scheme and host in small letters."""
    plain = F.regexp_extract(url, "^[^#]*", 0)
    head = F.regexp_extract(plain, "^[^:/?#]+://[^/?#]*", 0)
    return F.concat(F.translate(head, _UPPER, _LOWER), F.substring(plain, F.char_length(head) + 1, F.char_length(plain)))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` with host, path, rule, verdict, alias_class."""
    host, path = host_and_path(F.col("url"))
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("a", "b"))
    edges = written(edges.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")).where("a <> b"), "aliases")
    if isinstance(rules, tuple) and len(rules) > INLINE:
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    judged = with_rule(pages.select("page_id", "url", host.alias("host"), path.alias("path")), rules)
    own = F.coalesce("rule_verdict", F.lit("allow"))
    if edges.isEmpty():
        return judged.select("page_id", "url", "host", "path", "rule", own.alias("verdict"), F.lit(None).cast("string").alias("alias_class"))
    classes = written(components(edges), "classes")
    # Addresses that no page has count as well: the rules judge them like any other.
    h, p = host_and_path(F.col("node"))
    nodes = with_rule(classes.select("node", "component", h.alias("host"), p.alias("path")), rules)
    decided = nodes.groupBy("component").agg(F.max(F.when(F.col("rule_verdict") == "allow", 2).when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("top"))
    known = written(looked_up(classes, decided, "component", SALTS, "inner"), "decided")
    rows = judged.withColumn("node", address(F.col("url")))
    joined = looked_up(rows, known, "node", SALTS)
    verdict = F.coalesce("rule_verdict", F.when(F.col("top") == 1, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), F.col("component").alias("alias_class"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
