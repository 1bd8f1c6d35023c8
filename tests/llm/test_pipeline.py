"""The pipeline: stages act on what came before, and decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.conftest import SF_MID, SF_SMALL
from touchline.llm import decontam, mixing, neardup, queries
from touchline.llm import textkit as tk


def test_stages_one_by_one(spark, tmp_path):
    docs = tk.table(spark, SF_MID, "documents")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF_MID)
        if name != "sharding":
            assert out.columns == tk.table(spark, SF_MID, "documents").columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept[name] = (docs, spark.read.parquet(path))
        docs = kept[name][1]
    labels = tk.table(spark, SF_MID, "labels")
    judged = kept["quality"][0].join(labels, "doc_id").select("doc_id", "quality")
    got = judged.join(kept["quality"][1].select("doc_id", F.lit(1).alias("k")), "doc_id", "left").toPandas()
    assert got[got.quality == 1].k.notna().mean() >= 0.97 and got[got.quality == 0].k.isna().mean() >= 0.9
    before, after = kept["near_duplicates"]
    comp = neardup.near_duplicates(before)
    assert after.count() == comp.select("component_id").distinct().count() \
        == neardup.near_duplicates(after).select("component_id").distinct().count()
    before, after = kept["decontamination"]
    bad = decontam.contaminated(before, tk.table(spark, SF_MID, "benchmark")).select("doc_id").distinct()
    assert bad.count() > 0 and after.count() == before.count() - bad.count()
    before, after = kept["mixing"]
    want = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
    before, after = kept["sharding"]
    assert after.count() == before.count() and {"shard"} <= set(after.columns)


def test_run_and_empty_table(spark):
    out = cp.run(spark, SF_SMALL)
    assert out.count() > 0
    empty = tk.table(spark, SF_SMALL, "documents").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0


def test_query_names():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.oracle_sql()) <= set(names)
