"""URL filters by host-suffix and path-prefix expressions (operator 8).

A rule names a host and a path; it fits that host and its subdomains where
the URL's path starts with the rule's.  Each distinct URL is written out as
the expressions (host suffix + path prefix) a rule could have; they meet the
rules in an equi-join on the first 32 bits of their SHA-256 digests, full
digests confirm, and the longest rule decides.  The join carries digests
only, so URLs never meet rules one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import scratch_path

#: Fixed by the task: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: What a URL that no rule fits gets.
DEFAULT = "allow"
PREFIX_HEX = 8  # of the digest, in the join key


def parts(url: str = "url"):
    """Host and path of a URL column: the host is what follows the first
    ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path
    what follows up to ``?``, ``#`` or the end.  Null, or no ``://``: both empty."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host, path):
    # host and path are told apart, or another split of the same letters would match
    return F.sha2(F.concat(host, F.lit("\u0000"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict``.

    ``rules`` has ``host, path, verdict``; repeated rules count once (block
    before allow).  The longest rule (host and path together) that fits wins,
    then the longer host.  A null or relative URL has an empty host and path
    and gets the default verdict, as does a URL that no rule fits; the rule is
    then null.  A rule with an empty host or a null fits nothing.  Repeated
    rows are judged alike.  Extra columns are ignored; empty tables are fine.
    """
    rules = (rules.where("host <> '' and path is not null and verdict is not null")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    # the shapes rules have: numbers of labels and lengths of paths
    shape = rules.agg(F.collect_set(F.size(F.split("host", "[.]"))).alias("labels"),
                      F.collect_set(F.length("path")).alias("lengths")).first()
    host, path = parts()
    src = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    if not shape["labels"]:
        return src.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    r = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"),
                     _digest(F.col("host"), F.col("path")).alias("r_digest")) \
        .withColumn("short", F.substring("r_digest", 1, PREFIX_HEX))
    places = src.select("host", "path").where("host <> ''").distinct()
    label = F.split("host", "[.]")
    wide = (places.withColumn("_l", F.explode(F.array(*[F.lit(int(x)) for x in sorted(shape["labels"])])))
            .where(F.size(label) >= F.col("_l"))
            .withColumn("_n", F.explode(F.array(*[F.lit(int(x)) for x in sorted(shape["lengths"])])))
            .where(F.length("path") >= F.col("_n"))
            .select("host", "path", _digest(F.expr("substring_index(host, '.', -_l)"),
                                            F.expr("substring(path, 1, _n)")).alias("digest"))
            .withColumn("short", F.substring("digest", 1, PREFIX_HEX)))
    fit = wide.join(r, "short").where("digest = r_digest")
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = fit.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"),
                                                             F.col("r_verdict").alias("verdict")), order).alias("hit"))
    # the hits are a table before pages join them, so Spark can split the join at a place of
    # many pages; URLs without a host, of which there may be most, need none
    path = scratch_path(pages.sparkSession, "url-hits")
    best.write.parquet(path)
    hits = pages.sparkSession.read.parquet(path)
    bare = src.where("host = ''").withColumn("hit", F.lit(None).cast(hits.schema["hit"].dataType))
    judged = src.where("host <> ''").join(hits, ["host", "path"], "left").select(*bare.columns).unionByName(bare)
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                         F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))


def task_rules(spark) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


ORACLE = r"""
WITH r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE
        substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, p.host, p.path,
  (SELECT r.host || r.path FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host))
     AND starts_with(p.path, r.path) ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule,
  coalesce((SELECT r.verdict FROM r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host))
     AND starts_with(p.path, r.path) ORDER BY length(r.host || r.path) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
