"""URL rules and the regression on hashed n-grams, against versions in plain Python and numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import urls

PAGES = [
    (1, "http://a.example.net/en/1"), (2, "https://NET/x"), (3, "http://notnet/x"), (4, "http://x.example.com/de/?q"),
    (5, "http://example.com/en/1"), (6, "http://www.example.org/fr/7#top"), (7, "no scheme"), (8, None), (9, ""),
    (10, "http://a.net"), (11, "http://a.net:80/x"), (12, "ftp://É.NET/de/\U0001F600"), (13, "a://b://c.net/p"),
    (14, "http://example.net/en"), (15, "http://h/\n/x?y"), (16, "http://"), (None, "http://example.net/fr/"),
    (1, "http://a.example.net/en/1"), (17, "http://free-casino.example.org/en/1"), (18, "http://x.org/" + "long/" * 20_000),
]


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fits = [(v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[1]), default=(None, None))


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in PAGES], "page_id long, url string, host string, rule string, w int")
    return urls.judged(pages, urls.labelled_urls(spark)).collect()


def test_rules_and_parts(judged):
    want = sorted((str(i), *parts(u), str(rule(*parts(u))[1])) for i, u in PAGES)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in judged) == want
    for r in judged:
        verdict = rule(r.host, r.path)[0] or ("block" if r.score >= 0.5 else "allow")
        assert r.verdict == verdict
    by = {r.page_id: r for r in judged}
    assert by[17].verdict == "block" and by[5].verdict == "allow"


def test_longest_rule_wins_and_ties_are_defined(spark):
    rules = [("block", "b.c", "/"), ("allow", "c", "/xy"), ("allow", "c", "/x"), ("block", "c", "/x")]
    got = spark.range(1).select(urls.rule_for(F.lit("a.b.c"), F.lit("/xyz"), rules).alias("r"), urls.rule_for(F.lit("c"), F.lit("/xa"), rules).alias("s")).first()
    assert (got.r.rule, got.r.verdict) == ("b.c/", "block") and (got.s.rule, got.s.verdict) == ("c/x", "allow")
    assert spark.range(1).select(urls.rule_for(F.lit("c"), F.lit("/"), []).alias("r")).first().r is None


def test_fit_equals_numpy(spark):
    """The same descent on a dense matrix."""
    table = urls.labelled_urls(spark).where("length(url) % 3 = 0")
    rows = table.select("url", "label", urls.features(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("has")).collect()
    x = np.zeros((len(rows), urls.SLOTS))
    for k, r in enumerate(rows):
        for f in r.has:
            x[k, f.slot] += f.x  # a slot may be met in both parts
    y = np.array([r.label for r in rows], float)
    say = np.where(y == 1, urls.PRIOR / y.sum(), (1 - urls.PRIOR) / (1 - y).sum())
    w = np.zeros(urls.SLOTS)
    for _ in range(60):
        w = w * (1 - urls.RATE * urls.PENALTY) - urls.RATE * x.T @ (say * (1 / (1 + np.exp(-x @ w)) - y))
    twice = table.unionAll(table).unionAll(spark.sql("SELECT CAST(NULL AS STRING), 1")).unionAll(spark.sql("SELECT 'http://q', CAST(NULL AS INT)"))
    for labelled in (table, twice):
        assert np.allclose(urls.fit(labelled, 60).first().w, w, atol=1e-9)
    assert set(urls.fit(table.limit(0), 5).first().w) == {0.0}


def test_held_out_hosts_are_told_apart(spark):
    """Hosts that the table lacks, made of words that such sites have and of others."""
    bad = ["spins-casino", "betsonline", "my-pills-shop", "adult-cams-live", "linkfarm-seo", "ads-banner"]
    good = ["national-archive", "river-science", "old-books", "music-theatre", "open-maths", "gardening"]
    rows = [(k, f"https://www.{h}.example.org/es/{n}.html") for k, hs in enumerate((good, bad)) for h in hs for n in (12, 8801)]
    got = urls.judged(spark.createDataFrame(rows, "page_id long, url string"), urls.labelled_urls(spark), []).collect()
    right = sum((r.score >= 0.5) == (r.page_id == 1) for r in got)
    assert right >= 0.8 * len(rows) and all(r.score < 0.5 for r in got if r.page_id == 0)


def test_plan_is_native_and_without_a_shuffle_of_pages(spark, sf_dir):
    plan = urls.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert urls.query(spark, sf_dir).count() == pages.count()
    assert urls.judged(pages.limit(0), urls.labelled_urls(spark)).count() == 0
