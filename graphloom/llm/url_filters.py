"""URL filters with redirect equivalence (operator 1), in DataFrame operations alone.

Rules give explicit decisions.  A few are compiled into one expression; a table
of any number is joined by host suffix and path prefix.  Redirects and canonical links make urls aliases
of one another; connected components over those edges carry a block to every
alias that has no rule of its own, unless an alias is explicitly allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules are compiled into one expression; more are joined as a table, with the same result.
FEW_RULES = 64


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and the beginning of a path."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _matching(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and decision of the longest of a few rules that fits; null without one."""
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(r.name), r.allow, [-ord(c) for c in r.name])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, allow = F.when(fits, r.name).otherwise(name), F.when(fits, r.allow).otherwise(allow)
    return name, allow


def with_rule(rows: DataFrame, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """`rows` with the name (rule) and decision (allow) of the longest rule that fits their columns host and path; null without one.

    rules: some, or a table (host, path, allow) of any size.  Of equally long
    ones, allow wins, then the first by name.  Hosts of rules are not empty.
    Beyond a few, the distinct (host, path) are matched: each suffix of the host
    that has rules, cut to the lengths of paths that its rules have, meets the
    rule itself, so no url meets a rule that does not fit.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= FEW_RULES:
        name, allow = _matching(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": name, "allow": allow})
    if not isinstance(rules, DataFrame):
        rules = rows.sparkSession.createDataFrame([(r.host, r.path, r.allow) for r in rules], "host string, path string, allow boolean")
    known = stored(rules.where("host <> '' and path is not null and allow is not null").groupBy("host", "path").agg(F.max("allow").alias("allow")), "rules")
    labels = F.size(F.split("host", r"\.", -1))
    most = known.agg(F.max(labels)).first()[0] or 1
    lengths = known.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths"))
    sites = rows.select("host", "path").distinct()
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    cut = sites.select("host", "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
    cut = cut.select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    cut = cut.withColumn("prefix", F.substr("path", F.lit(1), F.col("n")))
    hits = cut.join(known.toDF("suffix", "prefix", "allow"), ["suffix", "prefix"])
    name = F.concat("suffix", "prefix")
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.length(name)).alias("n"), (~F.col("allow")).alias("block"), name.alias("rule"))).alias("best"))
    best = best.select("host", "path", "best.rule", (~F.col("best.block")).alias("allow"))
    return rows.join(best, ["host", "path"], "left")


def resource(url: Column) -> Column:
    """What a url names: without its fragment, with the host lower-cased."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    return F.concat(F.lower(F.regexp_extract(bare, r"(?s)^(.*?://)", 1)), host_of(bare), F.regexp_replace(bare, r"(?s)^.*?://[^/?#]*", ""))


def resolved(base: Column, to: Column) -> Column:
    """The absolute url that `to` means on a page whose url is `base`; null for schemes without ://, or where a relative one has no base."""
    scheme, site = F.regexp_extract(base, r"(?s)^([^/?#]*:)//", 1), F.regexp_extract(base, r"(?s)^([^/?#]*://[^/?#]*)", 1)
    path, asked = path_of(base), F.regexp_extract(base, r"(?s)^([^#]*)", 1)
    own = F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1), own))
    steps = F.split(F.substr(whole, F.lit(2)), "/", -1)
    up = lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), up)
    walked = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    relative = (
        F.when(site == "", F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(to.startswith("#"), F.concat(asked, to))
        .when(to.startswith("?"), F.concat(site, path, to))
        .otherwise(F.concat(site, F.lit("/"), F.array_join(walked, "/"), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)))
    )
    return F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None).otherwise(relative)


#: Tags that name an alias, the target in each, and how an ampersand is written in it.
CANONICAL = r"""(<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>)"""
REFRESH = r"""(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>)"""
HREF, TARGET = r"""\bhref\s*=\s*["']?\s*([^"'\s>]+)""", r"""\burl\s*=\s*["']?\s*([^"'\s>;]+)"""
AMPERSAND = "&(amp|#38|#x26);"


def alias_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b) from the canonical links and the meta refreshes of each page, as absolute urls.

    All such tags of a page count, in any case of letters; escaped ampersands
    are read as such.  Relative targets are resolved against the page's <base
    href>, if it has one, or else its url.  Rows with a null url or html give
    no edge.
    """
    html = F.col(html_col).cast("string")
    low = F.lower(html)
    plain = lambda x: F.regexp_replace(x, f"(?i){AMPERSAND}", "&")
    found = lambda tag, target: F.transform(F.regexp_extract_all(html, F.lit(f"(?is){tag}"), 1), lambda x: plain(F.regexp_extract(x, f"(?is){target}", 1)))
    edges = pages.where(F.col(url_col).isNotNull() & (low.contains("canonical") | low.contains("http-equiv")))
    edges = edges.select(F.col(url_col).cast("string").alias("a"), plain(F.regexp_extract(html, r"(?is)<base\b[^>]*" + HREF, 1)).alias("base"), F.explode(F.concat(found(CANONICAL, HREF), found(REFRESH, TARGET))).alias("b"))
    edges = edges.where("b <> ''").withColumn("base", F.when(F.col("base") == "", F.col("a")).otherwise(F.coalesce(resolved(F.col("a"), F.col("base")), "a")))
    edges = edges.withColumn("b", resolved(F.col("base"), F.col("b"))).where("b is not null")
    return edges.select(resource(F.col("a")).alias("a"), resource(F.col("b")).alias("b")).where("a <> b")


def judge(pages: DataFrame, edges: DataFrame | None = None, *, rules: tuple[Rule, ...] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row (id, url, host, path, rule, verdict, component) for each row of `pages`.

    rules: some, or a table (host, path, allow) of any size; see `with_rule`.
    edges: (a, b) of resources that redirect to each other or share a
    canonical link (see `resource`); None for none.  verdict is the decision of
    the url's own longest rule.  Without one, it is block if any alias is
    blocked by its rule and none is allowed by its rule, else allow.  Aliases
    need not be pages: their rules count too.  A null url, or one without ://,
    has an empty host and path, no rule and no alias, and is allowed.  Rows
    that repeat an id or a url are judged each on their own, alike.
    """
    url = F.col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = with_rule(rows, rules)
    own = F.when(F.col("allow"), "allow").when(~F.col("allow"), "block")
    plain = rows.select("id", "url", "host", "path", "rule", F.coalesce(own, F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    if edges is None:
        return plain
    nodes = connected_components(edges)
    if nodes.isEmpty():
        return plain
    judged = with_rule(nodes.select("component", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path")), rules)
    blocked = stored(judged.groupBy("component").agg(F.max((~F.col("allow")).cast("int")).alias("block"), F.max(F.col("allow").cast("int")).alias("allowed")), "verdicts")
    known = stored(nodes.join(blocked, "component").select(F.col("node").alias("resource"), "component", (F.coalesce("block", F.lit(0)) > F.coalesce("allowed", F.lit(0))).alias("spread")), "aliases")
    # A resource's pages meet one row of `known`; the side with the pages is split if one is hot.
    found = rows.withColumn("resource", resource(F.col("url"))).join(known, "resource", "left")
    verdict = F.coalesce(own, F.when(F.col("spread"), "block"), F.lit("allow"))
    return found.select("id", "url", "host", "path", "rule", verdict.alias("verdict"), "component")


def keep_allowed(pages: DataFrame, edges: DataFrame | None = None, **options) -> DataFrame:
    """The judged rows that are allowed, those without a host included; see `judge` for nulls and repeated rows."""
    return judge(pages, edges, **options).where("verdict = 'allow'")


def url_report(pages: DataFrame, **options) -> DataFrame:
    """The columns of the contract, with aliases from the pages' own canonical links and refreshes."""
    r = judge(pages, alias_edges(pages), **options)
    return r.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


#: The same for DuckDB.
SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
e0 AS (SELECT url, unnest(regexp_extract_all(html, @CANONICAL, 1, 'is')) AS link, NULL AS meta FROM pages WHERE url IS NOT NULL UNION ALL SELECT url, NULL, unnest(regexp_extract_all(html, @REFRESH, 1, 'is')) FROM pages WHERE url IS NOT NULL),
e1 AS (SELECT url AS a, coalesce(regexp_extract(link, @HREF, 1, 'is'), regexp_extract(meta, @TARGET, 1, 'is')) AS b FROM e0),
e2 AS (SELECT @RESOURCE(a) AS a, @RESOURCE(b) AS b FROM (SELECT a, regexp_replace(b, @AMPERSAND, '&', 'gi') AS b FROM e1) WHERE b LIKE '%://%'),
e AS (SELECT a, b FROM e2 WHERE a <> b UNION SELECT b, a FROM e2 WHERE a <> b),
r(host, path, allow) AS (VALUES ('com', '/', true), ('example.com', '/en/', false), ('www.example.com', '/en/', true), ('net', '/es/', false), ('net', '/fr/', false)),
reach(x, y) AS (SELECT a, a FROM e UNION SELECT a, b FROM e UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a),
n AS (SELECT DISTINCT y, translate(regexp_extract(y, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(y, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM reach),
v AS (SELECT y, arg_max(r.allow, length(r.host || r.path)) AS allow FROM n JOIN r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY y),
s AS (SELECT x, bool_or(NOT allow) AND NOT bool_or(allow) AS spread FROM reach JOIN v USING (y) GROUP BY x),
m AS (SELECT DISTINCT host, path FROM p),
d AS (SELECT m.host, m.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.allow, length(r.host || r.path)) AS allow
      FROM m JOIN r ON (m.host = r.host OR ends_with(m.host, '.' || r.host)) AND starts_with(m.path, r.path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, d.rule, CASE WHEN d.allow THEN 'allow' WHEN NOT d.allow THEN 'block' WHEN s.spread THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN d ON p.host = d.host AND p.path = d.path LEFT JOIN s ON s.x = @RESOURCE(p.url)
"""


def _sql(text: str) -> str:
    """`text` with the patterns as literals, and what a url names spelt out."""
    for name in ("CANONICAL", "REFRESH", "HREF", "TARGET", "AMPERSAND"):
        text = text.replace(f"@{name}", "'" + globals()[name].replace("'", "''") + "'")
    bare = r"regexp_replace(\1, '#.*$', '', 's')"
    of = "(lower(regexp_extract(@B, '^(.*?://)', 1, 's')) || translate(regexp_extract(@B, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_replace(@B, '^.*?://[^/?#]*', '', 's'))"
    return re.sub(r"@RESOURCE\(([a-z.]+)\)", lambda m: of.replace("@B", bare.replace(r"\1", m[1])), text)


#: The edges of `chained`, in place of those of the pages' own tags.
CHAINED = "e2 AS (SELECT @RESOURCE(a) AS a, @RESOURCE(b) AS b FROM (SELECT x.url AS a, y.url AS b FROM pages x JOIN pages y ON y.page_id = x.page_id + 1 WHERE x.page_id % 3 <> 0) WHERE a IS NOT NULL AND b IS NOT NULL),\n"
CHAINED_SQL = _sql(SQL[: SQL.index("e0 AS")] + CHAINED + SQL[SQL.index("e AS (SELECT a, b FROM e2") :])
SQL = _sql(SQL)


def chained(pages: DataFrame) -> DataFrame:
    """Edges between the urls of consecutive pages, but from every third."""
    p = pages.select("page_id", "url").where("url is not null")
    pairs = p.alias("x").join(p.alias("y"), F.expr("y.page_id = x.page_id + 1")).where("x.page_id % 3 <> 0")
    return pairs.select(resource(F.col("x.url")).alias("a"), resource(F.col("y.url")).alias("b")).where("a <> b")
