import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (id, text) pairs, with further columns whose
    names clash with those the operators use inside."""
    def make(rows, sources=("s1", "s2", None), partitions=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, None if k % 5 == 4 else "en", sources[k % len(sources)], None if k % 4 == 3 else len(t or ""))
                for k, (i, t) in enumerate(rows)]
        df = spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)
        return df.withColumns({c: F.lit(7) for c in (
            "row_key", "_row_key", "fp", "component_id", "size", "bytes", "_bytes", "_key", "_up", "shard", "_cell",
            "block", "kind", "score", "held_out", "_text", "_stated", "y", "rank", "id", "v", "copies", "_copies")})
    return make


ODD_TEXTS = [None, "", "   \n", "word", "a b c d", "a b c d", "Ünï cödé \U0001f600 tokens here now and then",
             "long " * 30_000, "same text again and again " * 3, "same text again and again " * 3]


@pytest.fixture(scope="session")
def odd_texts():
    return list(ODD_TEXTS)
