"""URL filters: rule verdicts, spread to redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .graph import components

#: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    rest = F.expr("CASE WHEN instr({0}, '://') > 0 THEN substring({0}, instr({0}, '://') + 3) ELSE '' END".format(url))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits(host, path, rule):
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def rule_columns(host, path, rules):
    """The longest rule that fits as text, and its verdict; null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        text = F.when(fits(host, path, rule), F.lit(rule[1] + rule[2])).otherwise(text)
        verdict = F.when(fits(host, path, rule), F.lit(rule[0])).otherwise(verdict)
    return text, verdict


def alias_key(host, path):
    """What stays of a url when a server redirects it to its plain form: no www. or m. before a host that still has a dot, no final slash.

    The query is no part of it, as it is none of a rule's: a block holds for a page under any query.
    """
    return F.concat(F.regexp_replace(host, r"^(www|m)\.(.*\..*)$", "$2"), F.regexp_replace(path, r"/+$", ""))


#: What a reader of tags passes over: comments, scripts and styles, to their end or the page's.
UNREAD = r"(?is)<!--.*?(-->|\z)|<script\b.*?(</script\s*>|\z)|<style\b.*?(</style\s*>|\z)"
BASE = r"(?i)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def read_tags(html):
    """A page without what is no tag of it, however it looks."""
    return F.regexp_replace(html, UNREAD, " ")


def base_target(html):
    """The target of the first base tag that has one, as written; the empty string, which stands for the page itself, if none has."""
    return F.regexp_replace(F.regexp_extract(html, BASE, 1), "&amp;", "&")


def link_targets(html):
    """Targets of canonical links and of redirects by meta refresh, as written."""
    links = F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*>)"), 1)
    links = F.filter(links, lambda x: x.rlike(r"(?i)\brel\s*=\s*([\"'][^\"'>]*\bcanonical\b|canonical\b)"))
    links = F.transform(links, lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    metas = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), 1)
    metas = F.filter(metas, lambda x: x.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"))
    metas = F.transform(metas, lambda x: F.regexp_extract(x, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1))
    return F.transform(F.filter(F.concat(links, metas), lambda x: x != ""), lambda x: F.regexp_replace(x, "&amp;", "&"))


def resolved(target, host, path):
    """A target as a whole url, taken from a page of that host and path; null if it is of a scheme without a host."""
    own = F.regexp_extract(target, r"^[^?#]*", 0)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    whole = F.when(own == "", path).when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    steps = F.split(F.regexp_replace(whole, r"(/\.\.?)$", "$1/"), "/")
    up = lambda kept: F.when(F.size(kept) > 1, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda kept, x: F.when(x == ".", kept).when(x == "..", up(kept)).otherwise(F.concat(kept, F.array(x))))
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:"
    return F.when(target.rlike(scheme + "//"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.rlike(scheme), None).otherwise(F.concat(F.lit("http://"), host, F.array_join(kept, "/")))


def judge(spark, pages, rules=RULES):
    """page_id, host, path, rule, verdict of every row of pages(page_id, url, html).

    A url's own longest rule decides, allow or block: explicit allow is never overridden. A url
    without a rule is blocked if any alias of it is: aliases are the connected components over
    links from each page to its canonical or refresh target, urls that differ only in scheme,
    www./m. prefix, query, fragment or final slash being one node. Otherwise it is allowed.
    Relative targets are resolved against the page's base tag, itself taken from the page's own url, or else against that url. Tags in
    comments, scripts and styles are none.
    A null url, or one without ://, has an empty host and path, fits no rule and is no one's alias.
    Repeated rows are judged each; no pages give no rows; other columns are ignored.
    """
    host, path = host_of("url")
    p = pages.select("page_id", "url", "html").withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "own": verdict, "key": F.when(F.col("host") != "", alias_key(F.col("host"), F.col("path")))})
    named = F.col("html").rlike("(?i)canonical|refresh")  # no other page has a link
    tags = p.where(F.col("key").isNotNull() & named).select("key", "host", "path", read_tags(F.col("html")).alias("tags"))
    tags = tags.withColumn("base", resolved(base_target(F.col("tags")), F.col("host"), F.col("path")))
    base_host, base_path = host_of("base")
    own = base_host == ""  # a base of a scheme without hosts is none
    tags = tags.withColumns({"bh": F.when(own, F.col("host")).otherwise(base_host), "bp": F.when(own, F.col("path")).otherwise(base_path)})
    links = tags.select(F.col("key").alias("a"), F.col("bh").alias("host"), F.col("bp").alias("path"), F.explode(link_targets(F.col("tags"))).alias("target"))
    links = links.select("a", resolved(F.col("target"), F.col("host"), F.col("path")).alias("target"))
    host, path = host_of("target")
    links = links.withColumns({"h": host, "p": path}).where("h <> ''")
    _, verdict = rule_columns(F.col("h"), F.col("p"), rules)
    links = links.select("a", alias_key(F.col("h"), F.col("p")).alias("b"), verdict.alias("own"))
    roots = components(spark, links.select("a", "b"))
    blocked = p.where("own = 'block' AND key IS NOT NULL").select("key").unionByName(links.where("own = 'block'").select(F.col("b").alias("key"))).distinct()
    blocked = blocked.join(roots, F.col("key") == F.col("node"), "left").select(F.coalesce("root", "key").alias("bad")).distinct()
    out = p.drop("html", "url").join(roots, F.col("key") == F.col("node"), "left").withColumn("at", F.coalesce("root", "key"))
    out = out.join(blocked, F.col("at") == F.col("bad"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("bad").isNotNull(), "block"), F.lit("allow")).alias("verdict"))


def op5_url_filter(spark, sf_dir):
    return judge(spark, table(spark, sf_dir, "pages"))


def _sql_case(value):
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value((v, h, p))}'" for v, h, p in ordered) + " END"


ORACLE_SQL = f"""
WITH RECURSIVE rest AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), p AS (
  SELECT page_id, html, host, path, {_sql_case(lambda r: r[1] + r[2])} AS rule, {_sql_case(lambda r: r[0])} AS own,
    CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.(.*\\..*)$', '\\2') || regexp_replace(path, '/+$', '') END AS k FROM split
), bare AS (
  SELECT k, host, path, regexp_replace(html, '{UNREAD}', ' ', 'g') AS tags FROM p WHERE k IS NOT NULL
), based AS (
  SELECT *, t AS base, regexp_extract(t, '^[^?#]*') AS own, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(t, strpos(t, '://') + 3) WHEN starts_with(t, '//') THEN substr(t, 3) END AS rest
  FROM (SELECT *, replace(regexp_extract(tags, '{BASE.replace("'", "''")}', 1), '&amp;', '&') AS t FROM bare)
), placed AS (
  SELECT k, tags, CASE WHEN coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') = '' THEN host ELSE translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') END AS host,
    CASE WHEN rest IS NOT NULL THEN CASE WHEN regexp_extract(rest, '^([^/?#]*)', 1) = '' THEN path ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END
      WHEN regexp_matches(base, '^[A-Za-z][A-Za-z0-9+.-]*:') OR own = '' THEN path
      ELSE regexp_replace(CASE WHEN starts_with(own, '/') THEN own ELSE CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || own END, '(/\\.\\.?)$', '\\1/') END AS path FROM based
), tags AS (
  SELECT k, host, path, unnest(regexp_extract_all(tags, '(?i)<(link|meta)\\b[^>]*>')) AS tag FROM placed
), written AS (
  SELECT k, host, path, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\\brel\\s*=\\s*(["''][^"''>]*\\bcanonical\\b|canonical\\b)')
      THEN regexp_extract(tag, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)http-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1) END AS t FROM tags
), parts AS (
  SELECT k, host, path, replace(t, '&amp;', '&') AS t, regexp_extract(replace(t, '&amp;', '&'), '^[^?#]*') AS own FROM written WHERE t <> ''
), whole AS (
  SELECT k, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(t, strpos(t, '://') + 3) WHEN starts_with(t, '//') THEN substr(t, 3) END AS rest,
    host, CASE WHEN own = '' THEN path WHEN starts_with(own, '/') THEN own ELSE CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || own END AS path, t FROM parts
), steps AS (
  SELECT k, host, regexp_replace(regexp_replace(path, '(/\\.\\.?)$', '\\1/'), '/(\\./)+', '/', 'g') AS path FROM whole
  WHERE rest IS NULL AND NOT regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:')
  UNION ALL
  SELECT k, host, CASE WHEN starts_with(path, '/../') THEN substr(path, 4) ELSE regexp_replace(path, '/[^/]*/\\.\\./', '/') END FROM steps WHERE contains(path, '/../')
), targets AS (
  SELECT k, host, path FROM steps WHERE NOT contains(path, '/../')
  UNION ALL
  SELECT k, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) FROM whole WHERE rest IS NOT NULL
), links AS (
  SELECT k AS a, regexp_replace(host, '^(www|m)\\.(.*\\..*)$', '\\2') || regexp_replace(path, '/+$', '') AS b, {_sql_case(lambda r: r[0])} AS own FROM targets WHERE host <> ''
),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
bad AS (
  SELECT k FROM p WHERE own = 'block' AND k IS NOT NULL
  UNION SELECT b FROM links WHERE own = 'block'
  UNION SELECT sym.b FROM bad JOIN sym ON sym.a = bad.k
)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN k IN (SELECT k FROM bad) THEN 'block' END, 'allow') AS verdict FROM p
"""
