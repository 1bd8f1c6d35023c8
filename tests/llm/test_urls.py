"""URL rules against a rule-by-rule brute force."""

import re

from pyspark.sql import functions as F

from touchline.llm import urls

URLS = [None, "", "no scheme", "http://", "http://a.com", "http://a.com/", "HTTP://A.COM/En/", "http://www.example.com/en/x",
        "http://WWW.Example.COM/en/x?q=/fr/", "http://example.com/en", "http://example.com/en/", "http://myexample.com/en/1",
        "http://sub.example.com/en/1#top", "http://x.net/es/1", "http://x.net/fr/", "http://net/es/", "http://xnet/es/",
        "http://a.com?x=/en/", "http://a.com#://b.net/es/", "a://b://c.com/", "http://u@a.com:80/", "http://.com/",
        "http://com/", "http://com./", "http://a..com/", "http://é.com/é?", "x" * 5000 + "://a.com/" + "y" * 5000,
        "http://" + "a." * 400 + "com/z", "http://a.com/\nb?c"]


def parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def brute(u, rules, default="allow"):
    host, path = parts(u)
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[3], best[2]


def run(spark, rows, rules):
    df = spark.createDataFrame([(i, u, "<html>", "h", "p") for i, u in rows], "page_id long, url string, html string, host string, path string")
    out = urls.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)


def test_task_rules(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[7]), (3, URLS[7]), (None, URLS[7])]
    assert run(spark, rows, list(urls.RULES)) == sorted(((i, *brute(u, urls.RULES)) for i, u in rows), key=str)


def test_rules_of_any_shape(spark):
    rules = [("com", "", "block"), ("a.com", "/b", "allow"), ("com", "/b/cc", "block"), ("c.a.com", "/b/c", "allow"),
             ("", "/x", "block"), ("a.com", "/b", "allow")]
    rows = list(enumerate(["http://a.com/b/cc", "http://c.a.com/b/ccc", "http://com/", "http://x.com", "http://y.org/x"]))
    assert run(spark, rows, rules) == sorted(((i, *brute(u, rules)) for i, u in rows), key=str)


def test_empty_tables(spark):
    assert run(spark, [], list(urls.RULES)) == []
    assert run(spark, [(1, "http://a.com/")], []) == [(1, "a.com", "/", None, "allow")]


HOT = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
       "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
       "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_a_dominant_url_is_split(spark):
    """Nine in ten pages of one place: Spark can split them between tasks, and URLs without a host meet nothing."""
    old = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    try:
        rows = [(i, "http://www.example.com/en/hot" if i % 10 else f"http://x{i}.net/es/{i}") for i in range(20_000)]
        rows += [(20_000 + i, None) for i in range(20_000)]
        df = spark.createDataFrame(rows, "page_id long, url string").repartition(8)
        out = urls.judge(df, urls.task_rules(spark))
        got = {(r.verdict, r.rule): r["count"] for r in out.groupBy("verdict", "rule").count().collect()}
        assert got == {("allow", "www.example.com/en/"): 18_000, ("block", "net/es/"): 2_000, ("allow", None): 20_000}
        out = urls.judge(df, urls.task_rules(spark))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        per_task = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(per_task) < 12_000  # of 18,000 rows of the hot place
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
