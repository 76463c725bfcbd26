"""URL filters whose block decisions reach aliases.

Explicit rules judge a page by host and path. Pages without a rule take over what is known of their aliases: redirects (meta
refresh) and canonical links are edges between addresses, connected components over these are groups of aliases,
and a group with an explicit allow is allowed, otherwise one with an explicit block is blocked. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal.llm.common import let
from areal.llm.components import connected_components

#: verdict, host, path; the longest rule that fits wins.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The rule that fits, host and path of it as one string; null if none does."""
    found: Column = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.lit(h + p)).otherwise(found)
    return found


def address(url: Column) -> Column:
    """The form in which addresses are nodes; null without `://`.

    Scheme and host are in lower case, the scheme's own port and the fragment go, `.` and `..` are resolved in the path, an empty path is
    `/`, and percent escapes have upper-case digits. Escapes are not decoded and queries are kept as they are otherwise.
    """

    def made(p: Column) -> Column:
        whole = F.concat(p["scheme"], F.lit("://"), p["host"], _without_dots(p["path"]), p["query"])
        return F.when(p["scheme"] != "", _upper_escapes(whole))

    scheme = F.lower(F.regexp_extract(url, r"(?s)^\s*([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    parts = F.struct(scheme.alias("scheme"), _own_host(scheme, host(url)).alias("host"), path(url).alias("path"), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1).alias("query"))
    return F.when(url.contains("://"), let(parts, made))


def _own_host(scheme: Column, host: Column) -> Column:
    port = F.when(scheme == "http", F.lit(r":(?:80)?$")).when(scheme == "https", F.lit(r":(?:443)?$")).otherwise(F.lit(r":$"))
    return F.regexp_replace(host, port, F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path whose `.` and `..` segments are resolved; above the root there is nothing."""
    segments = F.split(F.when(path == "", F.lit("/")).otherwise(path), "/", -1)
    empty = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        return F.when(x == ".", done).when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    def joined(s: Column) -> Column:
        last = F.element_at(s, -1)
        names = F.aggregate(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), empty, step)
        return F.concat(F.lit("/"), F.array_join(names, "/"), F.when(last.isin(".", "..") & (F.size(names) > 0), F.lit("/")).otherwise(F.lit("")))

    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), let(segments, joined)).when(path == "", F.lit("/")).otherwise(path)


def _upper_escapes(url: Column) -> Column:
    first = F.split(url, "%", -1)
    fixed = F.transform(first, lambda x, i: F.when((i > 0) & x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 2147483647))).otherwise(x))
    return F.when(url.rlike("%[0-9A-F]?[a-f]|%[a-f]"), F.array_join(fixed, "%")).otherwise(url)


def target(link: Column, base: Column) -> Column:
    """The url that a link on a page with the url base means; null for links that lead nowhere else (fragments, `mailto:`)."""

    def of(link: Column) -> Column:
        root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
        folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
        page = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
            .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
            .when(F.startswith(link, F.lit("/")), F.concat(root, link))
            .when(F.startswith(link, F.lit("?")), F.concat(page, link))
            .when(link.rlike(r"^(?:#|$|[A-Za-z][A-Za-z0-9+.\-]*:)"), F.lit(None).cast("string"))
            .otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")), F.lit("")).otherwise(F.lit("/")), link))
        )

    return let(F.trim(link), of)


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value; empty if the tag has none."""
    found = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.replace(F.regexp_replace(found, r"^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&"))


#: Tags that can name an alias or the base of links; whole, however long.
TAGS = r"(?is)<(?:link|meta|base)\b[^>]*+>"


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between a page's address and where its canonical links and its refreshes point.

    Links are resolved against the first `<base href>`, itself against the page's url. A tag is read whole; one that never ends is none.
    """
    tags = F.regexp_extract_all(F.col("html"), F.lit(TAGS), F.lit(0))

    def links(t: Column) -> Column:
        canonical = F.filter(t, lambda x: x.rlike(r"(?is)^<link") & F.lower(_attribute(x, "rel")).rlike(r"(?:^|\s)canonical(?:\s|$)"))
        refresh = F.filter(t, lambda x: x.rlike(r"(?is)^<meta") & (F.lower(_attribute(x, "http-equiv")) == "refresh"))
        to = F.transform(refresh, lambda x: F.regexp_extract(F.regexp_extract(_attribute(x, "content"), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*(.*)$", 1), r"(?s)^['\"]?([^'\"]*)", 1))
        return F.filter(F.concat(F.transform(canonical, lambda x: _attribute(x, "href")), to), lambda x: x != "")

    base = F.filter(F.transform(F.filter(F.col("tags"), lambda x: x.rlike(r"(?is)^<base")), lambda x: _attribute(x, "href")), lambda x: x != "")
    with_tags = pages.where("url is not null and html is not null").where(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", tags.alias("tags"))
    own = with_tags.select("url", F.get(base, F.lit(0)).alias("base"), F.explode(links(F.col("tags"))).alias("link"))
    found = own.select(address(F.col("url")).alias("a"), address(target(F.col("link"), F.coalesce(target(F.col("base"), F.col("url")), F.col("url")))).alias("b"))
    return found.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and alias_of (the smallest address of the page's group, null if it has no alias).

    One row for each row of pages. edges (a, b) adds alias edges known elsewhere, as urls. Null urls and urls without `://` have an
    empty host and path, fit no rule and are allowed. Without a rule, the explicit verdicts in the page's group decide,
    allow before block, and a page without a group is allowed. A group's decision comes from its addresses, whether
    crawled or only linked. Repeated rows are judged each, an empty table gives no rows, and other columns are ignored.
    """
    chosen = pages.select("page_id", "url", "html")
    links = alias_edges(chosen)
    if edges is not None:
        links = links.union(edges.select(address(F.col("a")), address(F.col("b"))))
    of = connected_components(links)
    verdicts = {h + p: v for v, h, p in rules}
    verdict = lambda rule: F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv])[rule]
    explicit = of.withColumn("v", verdict(rule_of(host(F.col("node")), path(F.col("node")), rules)))
    decided = explicit.groupBy("component").agg(F.min("v").alias("group_verdict"))  # allow sorts before block
    members = of.join(decided, "component").select(F.col("node").alias("_address"), F.col("component").alias("alias_of"), "group_verdict")
    rows = chosen.select("page_id", "url", "html", address(F.col("url")).alias("_address"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    # pages without an address have a key of their own each, which no member has, so that they don't all go to one task
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "html").cast("string"))
    rows = rows.withColumn("_address", F.coalesce("_address", alone)).drop("url", "html").withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    return rows.join(members, "_address", "left").select(
        "page_id", "host", "path", "rule", F.coalesce(verdict(F.col("rule")), F.col("group_verdict"), F.lit("allow")).alias("verdict"), "alias_of"
    )


SQL = r"""
with p as (
  select page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) h0,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path
  from pages),
q as (select page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, path from p),
r as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/'
  end as rule
  from q)
select page_id, host, path, rule,
       case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict,
       cast(null as varchar) as alias_of
from r
"""
