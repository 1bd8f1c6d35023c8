"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import ship
from touchline.llm import textkit as tk


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship.ensure(spark)
        return f(spark, sf_dir)
    return run


@_query
def op1_shard(spark, sf_dir):
    """Every document with its shard; shards of at most 1 MiB of text."""
    from touchline.llm import shard
    out = shard.shards(tk.table(spark, sf_dir, "documents"))
    return out.select("doc_id", shard.text_bytes().alias("bytes"), "shard", "shard_depth", "shard_bytes")


@_query
def op2_topk(spark, sf_dir):
    """The 5 best partners of every 50th vector among all vectors."""
    from touchline.llm import topk
    return topk.search(tk.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op3_toxicity(spark, sf_dir):
    """Toxicity of every document; rows with crc32 remainder 0 of 5 are held out."""
    from touchline.llm import toxicity
    return toxicity.toxicity(tk.table(spark, sf_dir, "documents"), tk.table(spark, sf_dir, "labels"),
                             tk.id_remainder("doc_id", 5) == 0)


@_query
def op4_neardup(spark, sf_dir):
    """Near-duplicate components of all documents."""
    from touchline.llm import neardup
    return neardup.near_duplicates(tk.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@_query
def op5_mix(spark, sf_dir):
    """How many words the mix takes of every document."""
    from touchline.llm import mixing
    return mixing.mix(tk.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@_query
def op6_quality(spark, sf_dir):
    """Quality of every document; rows with crc32 remainder 1 of 3 are held out."""
    from touchline.llm import quality
    return quality.quality(tk.table(spark, sf_dir, "documents"), tk.table(spark, sf_dir, "labels"),
                           tk.id_remainder("doc_id", 3) == 1)


@_query
def op7_lm(spark, sf_dir):
    """Language-model scores of every document; rows with crc32 remainder 1 of 5 are held out."""
    from touchline.llm import ctw
    return ctw.scores(tk.table(spark, sf_dir, "documents"), tk.id_remainder("doc_id", 5) == 1)


@_query
def op8_urls(spark, sf_dir):
    """The rule and verdict of every page's URL."""
    from touchline.llm import urls
    return urls.judge(tk.table(spark, sf_dir, "pages"), urls.task_rules(spark))


@_query
def op10_pii(spark, sf_dir):
    """Personal data of every document: counts and digest of the base spans, all spans."""
    from touchline.llm import pii
    return pii.digest(pii.personal_data(tk.table(spark, sf_dir, "documents")))


@_query
def op9_decontam(spark, sf_dir):
    """Documents that hold a benchmark item, with the items."""
    from touchline.llm import decontam
    return decontam.contaminated(tk.table(spark, sf_dir, "documents"), tk.table(spark, sf_dir, "benchmark"))


@_query
def op11_centroids(spark, sf_dir):
    """The vectors of ``embeddings`` around 8 integer centroids after 10 rounds."""
    from touchline.llm import centroids
    return centroids.cluster(tk.table(spark, sf_dir, "embeddings")).drop("checked")


@_query
def op12_simhash(spark, sf_dir):
    """SimHash components of all documents."""
    from touchline.llm import simhash
    return simhash.near_duplicates(tk.table(spark, sf_dir, "documents"))


@_query
def op13_audit(spark, sf_dir):
    """How five filters interact in every part, in all their orders."""
    from touchline.llm import audit
    return audit.interactions(tk.table(spark, sf_dir, "documents"), tk.table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_shard, op2_topk, op3_toxicity, op4_neardup, op5_mix, op6_quality,
                                     op7_lm, op8_urls, op9_decontam, op10_pii, op11_centroids, op12_simhash, op13_audit)}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others learn, draw at random
    or normalise texts and are tested against brute force."""
    from touchline.llm import audit, centroids, neardup, shard, topk, urls
    return {"op1_shard": shard.ORACLE, "op2_topk": topk.ORACLE, "op4_neardup": neardup.ORACLE, "op8_urls": urls.ORACLE,
            "op11_centroids": centroids.oracle(), "op13_audit": audit.ORACLE}
