import random
from urllib.parse import urlsplit

from isoweave.llm import op4_redirects as U


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if c.isascii() else c for c in host), slash + path


def rule_of(url, rules=U.RULES):
    host, path = host_path(url)
    fits = [(h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def test_whole_table(spark):
    d = "/root/testdata/sf0.1"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = U.op4_redirect_equivalence(spark, d).collect()
    assert len(got) == len(urls)
    for r in got:
        rule = rule_of(urls[r.page_id])
        assert (r.host, r.path) == host_path(urls[r.page_id])
        assert r.rule == (rule and rule[0] + rule[1])
        assert r.verdict == rule[2] if rule else r.verdict in ("allow", "block")
    assert {r.verdict for r in got} == {"allow", "block"}


PAGES = [
    (1, "http://bad.net/x", '<link rel="canonical" href="http://good.info/a">'),
    (2, "HTTPS://Good.info/a?utm_source=z#top", None),
    (3, "http://good.info/b", "<meta http-equiv='refresh' content='0; url=/a'>"),
    (4, "http://other.info/", ""),
    (5, "http://example.net/en/1", '<meta property="og:url" content="http://mixed.info/">'),
    (6, "http://mixed.info", None),
    (7, "http://also.net/", "<LINK HREF=http://mixed.info/ REL=canonical>"),
    (8, None, "<link rel=canonical href=http://good.info/a>"),
    (9, "no scheme", None),
    (10, "http://w.example.com/de/1?q", None),
    (11, "http://x.org/fr/", None),
    (12, "http://notexample.com/de/", None),
    (13, "://", None),
    (14, "a://b://c/d", None),
    (15, "http://rel.info/dir/page", '<link rel="canonical" href="target">'),
    (16, "http://rel.info/dir/target", '<link rel="stylesheet" href="http://bad.net/x">'),
    (None, "http://bad.net/x", None),
]


def test_aliases_and_precedence(spark):
    df = spark.createDataFrame(PAGES + PAGES[:3], "page_id long, url string, html string").selectExpr("*", "'q' as host", "1 as verdict", "2 as component")
    got = U.filter_urls(df).collect()
    assert len(got) == len(PAGES) + 3
    verdict = {r.page_id: r.verdict for r in got}
    assert [verdict[i] for i in (1, 2, 3, 4)] == ["block", "block", "block", "allow"]
    assert [verdict[i] for i in (5, 6, 7)] == ["allow", "allow", "block"]  # the allow keeps the component; a named block stays
    assert [verdict[i] for i in (8, 9, 10, 11, 12, 13, 14, 15, 16)] == ["allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert {(r.host, r.path) for r in got if r.page_id == 14} == {("b:", "//c/d")}
    component = {r.page_id: r.component for r in got}
    assert component[15] == component[16] and component[8] is None
    assert U.filter_urls(df.limit(0)).count() == 0


def test_long_redirect_chains_against_brute_force(spark):
    rng = random.Random(2)
    n = 400
    urls = [f"http://h{i}.{rng.choice(['info', 'info', 'info', 'info', 'info', 'info', 'net', 'org'])}/{rng.choice(['fr', 'p'])}/{i}" for i in range(n)]
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(61, n), rng.randrange(61, n)) for _ in range(200)]
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[top(a)] = top(b)
    said = [(rule_of(u) or (0, 0, None))[2] for u in urls]
    want = {}
    for i in range(n):
        group = [said[j] for j in range(n) if top(j) == top(i)]
        want[i] = said[i] or ("block" if "block" in group and "allow" not in group else "allow")
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(urls[a], urls[b]) for a, b in edges], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in U.filter_urls(pages, redirects=redirects).collect()} == want


def test_no_python(spark):
    plan = U.op4_redirect_equivalence(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_any_column_names(spark):
    odd = {"a.b": "1", "_hot": "true", "_said": "'z'", "_plain": "'p'", "_spread": "2", "`": "3", "verdict": "4"}
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    given = df.selectExpr("*", *[f"{v} as `{k.replace('`', '``')}`" for k, v in odd.items()]).withColumnRenamed("url", "u.rl").withColumnRenamed("html", "_allow")
    got = U.filter_urls(given, url="u.rl", html="_allow").collect()
    want = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want
    assert {tuple(r[k] for k in odd if k != "verdict") for r in got} == {(1, True, "z", "p", 2, 3)}
