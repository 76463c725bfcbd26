"""Verdicts of pages against a plain version over planted redirects, canonical links and bases."""

import random
import re
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from areal.llm import url_filter

SCHEMA = "page_id long, url string, html string"
VERDICT = {h + p: v for v, h, p in url_filter.RULES}


def plain_rule(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [h + p for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=len, default=None)


def address(url):
    if not re.match(r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://", url or ""):
        return None
    s = urlsplit(urljoin(url.strip() if urlsplit(url).path else url.strip(), ""))
    path = urlsplit(urljoin(f"http://h{s.path or '/'}", s.path or "/")).path
    port = {"http": ":80", "https": ":443"}.get(s.scheme, ":")
    host = s.netloc.lower().removesuffix(port).removesuffix(":")
    whole = f"{s.scheme.lower()}://{host}{path}" + (f"?{s.query}" if s.query else "")
    return re.sub("%[0-9a-fA-F]{2}", lambda m: m[0].upper(), whole)


def brute(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, url, _, links, base in rows:
        for link in links:
            a, b = address(url), address(urljoin(urljoin(url, base or ""), link))
            if a and b and a != b:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    known = {}
    for x in list(parent):
        known.setdefault(find(x), set()).add(VERDICT.get(plain_rule(x)))
    out = {}
    for page_id, url, *_ in rows:
        rule, group = plain_rule(url), known.get(find(address(url)), set()) if address(url) in parent else set()
        out[page_id] = VERDICT[rule] if rule else "allow" if "allow" in group else "block" if "block" in group else "allow"
    return out


def judged(spark, rows):
    return {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame([r[:3] for r in rows], SCHEMA)).collect()}


def test_planted_links(spark):
    rng = random.Random(2)
    hosts = ["a.example.com", "b.org", "net", "x.net", "c.io", "www.example.com", "d.dev"]
    paths = ["/en/1", "/es/2", "/fr/3", "/", "/p/q", "/z?k=%c3%a9"]
    rows = []
    for i in range(300):
        url = f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}{i % 40}"
        base = rng.choice([None, None, "/p/", "http://b.org/p/q/"])
        link = rng.choice([f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.randrange(40)}", f"../es/2{i % 40}", f"/p/./q{i % 40}", f"//x.net/a/../fr/3{i % 40}", f"http://C.io:80/en/1{i % 40}#t"])
        tag = f"<link rel='x canonical' href='{link}'>" if i % 2 else f'<META http-equiv=refresh content="0; url={link}">'
        links = [link] if rng.random() < 0.5 else []
        html = "<head>" + (f'<base href="{base}">' if base else "") + (tag if links else '<link rel="icon" href="http://net/es/1">')
        rows.append((i, url, html, links, base))
    got, want = judged(spark, rows), brute(rows)
    assert got == want and len({plain_rule(r[1]) is None and want[r[0]] for r in rows}) == 3


def test_allow_goes_before_block_in_one_group(spark):
    canon = "<link rel=canonical href='{}'>"
    rows = [(1, "http://b.org/x", canon.format("http://net/es/1")), (2, "http://b.org/y", canon.format("http://b.org/x")), (3, "http://b.org/y", canon.format("http://q.com/")), (4, "http://net/es/1", ""), (5, "http://c.org/", canon.format("http://net/fr/"))]
    assert judged(spark, rows) == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block"}


def test_long_tags_are_read_whole(spark):
    rows = [(1, "http://b.org/", f"<link data-x='{'y' * 50_000}' rel=canonical href=http://net/es/1>"), (2, "http://b.org/2", "<link rel=canonical href=http://net/es/1" + "z" * 9000)]
    assert judged(spark, rows) == {1: "block", 2: "allow"}


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, None, None), (1, None, None), (None, "nope", "<p>"), (2, "http://A.Example.com/en/x", None)]
    pages = spark.createDataFrame([(*r, "h", "v") for r in rows], SCHEMA + ", host string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()), key=str)
    assert got == sorted([(1, "", "", None, "allow"), (1, "", "", None, "allow"), (None, "", "", None, "allow"), (2, "a.example.com", "/en/x", "example.com/en/", "block")], key=str)
    assert url_filter.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("url, want", [("HTTP://A.b:80", "http://a.b/"), ("https://A.b:443/x/../y/./z#f", "https://a.b/y/z"), ("http://a.b:8080/..?q=%2f", "http://a.b:8080/?q=%2F"), ("mailto:x", None), ("http://a/b/..", "http://a/")])
def test_addresses(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(url_filter.address(F.col("u")).alias("a")).first().a == want
