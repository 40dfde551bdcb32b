"""URL filters: parsing, rules, and the tree against SQL and on planted sites."""

import random

import pytest

import parity
from fluxgrid.llm import urls


def verdicts(spark, rows, rules=urls.RULES):
    frame = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(rows)], "page_id long, url string, host string, n int").repartition(3)
    return {r.page_id: r for r in urls.judged(frame, rules).collect()}


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    ("https://www.Example.NET/en/1?q#f", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://a.net/x", "a.net", "/x", "net/", "block"), ("http://net/", "net", "/", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"),
    ("x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"), ("x://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("x://a.org/fr/?://b.net/", "a.org", "/fr/", "org/fr/", "allow"), ("no scheme.net/x", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("http://É.NET?a/b", "É.net", "", None, "allow"), ("http://h#/x", "h", "", None, "allow"),
])
def test_host_path_and_rule(spark, url, host, path, rule, verdict):
    own = verdicts(spark, [url])[0]
    assert (own.host, own.path, own.rule, own.verdict) == (host, path, rule, verdict)


def test_templates(spark):
    rows = [f"http://a.io/{x}/{i}.html" for x in ("en", "fr") for i in range(40)] + [f"http://a.io/bad/{i}.html" for i in range(40)]
    rows += [f"http://a.io/user/{'%032x' % (i * 7919)}/edit" for i in range(30)] + [f"http://a.io/slug-{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["http://a.io/*|", "http://a.io/a/b/c/d/e/f/g/h"] * 2
    frame = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    found = {(r.template, r.n, r.blocked, r.rejected) for r in urls.templates(urls.tree(frame, [("block", "io/bad/")])).collect()}
    assert found == {("/en|fr|user/#.html", 80, 0, False), ("/bad/#.html", 40, 40, True), ("/en|fr|user/#/edit", 30, 0, False), ("/*", 62, 0, False), ("/*/b/c/d/e/f/g/h", 2, 0, False)}


def test_labels_reach_urls_of_the_same_template(spark):
    """The rule names some of a site's numbers; their template is rejected with its unlabelled URLs, another site's isn't."""
    rules = [("block", f"{h}.io/ads/{i}") for h in ("a", "b") for i in range(1, 10)] + [("allow", "b.io/ads/5")]
    rows = [f"http://a.io/ads/{i}" for i in range(1, 100)] + [f"http://b.io/ads/{i}" for i in (50, 60, *range(10, 30))] + [f"http://a.io/news/{i}" for i in range(60)]
    own = verdicts(spark, [*rows, "http://a.io/ads/0", "http://a.io/ads/00", "http://c.io/ads/0", "http://a.io/about"], rules)
    last = len(rows)
    assert own[last].rule is None and own[last].verdict == own[last + 1].verdict == "block"
    assert own[last + 2].verdict == own[last + 3].verdict == "allow"
    assert all(own[i].verdict == "allow" for i in range(99 + 22, last)) and all(own[i].verdict == "block" for i in range(99))


def test_few_or_mixed_labels_reject_nothing(spark):
    rules = [("block", "a.io/x/1"), ("block", "b.io/x/1"), ("allow", "b.io/x/2")]
    rows = [f"http://a.io/x/{i}" for i in (1, 11, 12, 0)] + [f"http://b.io/x/{i}" for i in (*range(10, 30), 0)] + [f"http://c.io/x/{i}" for i in range(50)]
    own = verdicts(spark, rows, rules)
    assert {r.verdict for r in own.values() if r.rule is None} == {"allow"}


def test_tables_of_many_hosts_equal_sql(spark, tmp_path):
    rng = random.Random(4)
    hosts = ["hot.example.com"] * 6 + [f"h{i}.example.{rng.choice(['com', 'net', 'org'])}" for i in range(12)] + ["x.org"]
    part = lambda: rng.choice(["en", "de", "fr", "de", "es", "tag", "a*b", "", f"{rng.randrange(10**6)}", f"p-{rng.randrange(99)}.html", rng.choice("abcdefghij") * 3, "%032x" % rng.randrange(16**32)])
    rows = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}" + "".join(f"/{part()}" for _ in range(rng.choice([0, 1, 2, 2, 2, 3, 4, 8]))) + rng.choice(["", "/", "?q=1/2", "#x"]) for _ in range(4000)]
    rows += [None, "", "none", "http://"] * 2
    frame = spark.createDataFrame([(i // 2, u) for i, u in enumerate(rows)], "page_id long, url string").repartition(4)
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    con = parity.duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert parity.difference(urls.judged(frame), con, urls.ORACLE) == ""
    assert urls.judged(frame.limit(0)).isEmpty()


def test_no_python_worker(spark):
    frame = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    plan = urls.judged(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
