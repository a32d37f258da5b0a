"""The URL filter against plain Python: rules, links of hosts, trust and distrust."""

from __future__ import annotations

import random
import re

import pyarrow.parquet as pq

from skeinlake.llm import url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def spread(edges, seeds, rounds=57):
    degree = {}
    for a, _ in edges:
        degree[a] = degree.get(a, 0) + 1
    now = dict(seeds)
    for _ in range(rounds if edges else 0):
        step = dict(seeds)
        for a, b in edges:
            if a in now:
                step[b] = step.get(b, 0) + 0.85 * now[a] / degree[a]
        now = step
    return now


def brute(rows):
    judged, edges, pages, share = [], set(), {}, {}
    for page, url, html in rows:
        host, path = split(url)
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits)[1:] if fits else None
        judged.append((page, host, path, best))
        if host:
            pages[host] = pages.get(host, 0) + 1
            if best:
                share[host, best[0]] = share.get((host, best[0]), 0) + 1
            edges |= {(host, x.translate(LOWER)) for x in re.findall(url_filter.LINK, html or "") if x.translate(LOWER) != host}
    trust = spread(edges, {h: (1 - 0.85) * share[h, "allow"] / pages[h] for h in pages if (h, "allow") in share})
    distrust = spread({(b, a) for a, b in edges}, {h: (1 - 0.85) * share[h, "block"] / pages[h] for h in pages if (h, "block") in share})
    verdict = lambda h: "block" if distrust.get(h, 0) >= url_filter.DISTRUST and distrust[h] > trust.get(h, 0) else "allow"
    return sorted(((page, host, path, best[1] if best else None, best[0] if best else verdict(host)) for page, host, path, best in judged), key=str)


def judged(pages):
    return sorted((tuple(r) for r in url_filter.judge(pages, url_filter.rules_table(pages.sparkSession)).collect()), key=str)


def test_given_pages(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(sf_dir + "/pages.parquet").to_pylist()]
    assert judged(spark.read.parquet(sf_dir + "/pages.parquet")) == brute(rows)


def test_linked_hosts_and_odd_urls(spark):
    """A third of the pages on one host; links by absolute and scheme-less addresses; urls without host, scheme or path."""
    rnd = random.Random(1)
    hosts = [f"h{i}.{t}" for i in range(8) for t in ("net", "org", "example.com", "com", "example.net")]
    rows = []
    for i in range(200):
        host = "hot.com" if i % 3 == 0 else rnd.choice(hosts)
        link = lambda: f'<a {rnd.choice(["href", "HREF"])}="{rnd.choice(["http://", "https://", "//", "/local/"])}{rnd.choice(hosts)}/x">'  # noqa: E731, B023
        url = rnd.choice(["http://", "HTTPS://"]) + (host.upper() if i % 7 == 0 else host) + rnd.choice(["", "/", "/de/x?q=1", "/en/#z", "/fr/a", "?x", "/es/"])
        rows.append((i, url, "".join(link() for _ in range(rnd.randrange(3)))))
    rows += [(1000, None, None), (1000, None, None), (1001, "nothing", "<a href='http://h1.net'>"), (1002, "http://", ""), (1003, "http://net/", None), (None, "http://" + "a." * 50_000 + "net/x", "href=" * 50_000)]
    pages = spark.createDataFrame(rows, SCHEMA)
    clash = pages
    for name in ("host", "path", "rule", "verdict", "src", "dst", "kind", "score", "rule_host", "candidates"):
        clash = clash.withColumn(name, url_filter.F.lit("mine"))
    got = judged(clash)
    assert got == brute(rows)
    assert {("block", None), ("allow", None)} <= {(r[4], r[3]) for r in got}
    assert judged(pages.where("page_id = -1")) == []


def test_distrust_goes_against_links_and_trust_along(spark):
    link = lambda h: f'<a href="https://{h}/">'
    rows = [(1, "http://bad.net/", ""), (2, "http://farm.com/", link("bad.net")), (3, "http://good.org/fr/", link("friend.com")), (4, "http://friend.com/", link("bad.net")), (5, "http://calm.com/", "")]
    assert {r[0]: r[4] for r in judged(spark.createDataFrame(rows, SCHEMA))} == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "allow"}
    assert {r[0]: r[4] for r in judged(spark.createDataFrame([r for r in rows if r[0] != 4], SCHEMA))}[2] == "block"


def test_only_spark_functions_run(spark, sf_dir):
    pages = spark.read.parquet(sf_dir + "/pages.parquet")
    plan = url_filter.judge(pages, url_filter.rules_table(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
