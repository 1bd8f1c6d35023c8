"""Sharding by extendible hashing (operator 1); DataFrame functions only.

Every row gets a hash key of three words of 60 bits: from its doc_id, from its
whole content, and (only where rows equal in all overfill a bucket) from its
place in the table.  The directory is indexed by
the leading bits of that key.  A bucket is a prefix; one that holds more than
``limit`` bytes splits on its next bit, and nothing else splits.  As byte
totals only shrink along a path, the final bucket of a row is its shortest
prefix whose total fits, so one aggregated histogram per round of bits yields
the whole directory: prefix totals at every depth, of which the leaves are kept.
Only rows of buckets that are still too large take part in a further round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import textkit as tk
from touchline.session import scratch_path

#: Target size of a shard in bytes of text.
SHARD_BYTES = 1 << 20
WORD_BITS = 60


def _word(c: Column) -> Column:
    """60 leading bits of the MD5 digest as a non-negative long."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("long")


def text_bytes(text: str = "text") -> Column:
    """Bytes of a text column; null has none."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def _top(word: Column, lo: int, n: int) -> Column:
    """``n`` bits of a word from bit ``lo`` (0 is the first) as a number."""
    return F.shiftright(word, WORD_BITS - lo - n).bitwiseAND(F.lit((1 << n) - 1))


def _keyed(docs: DataFrame, c: dict[str, str]) -> DataFrame:
    content = F.concat_ws("\u001f", *[F.coalesce(F.col(c[x]).cast("string"), F.lit("\u0000"))
                                      for x in ("doc_id", "text", "lang", "source") if x in c])
    return docs.select(
        "*", text_bytes(c["text"]).alias("_bytes"),
        F.struct(_word(F.coalesce(F.col(c["doc_id"]).cast("string"), F.lit(""))).alias("w0"),
                 _word(content).alias("w1")).alias("_key"))


def directory(rows: DataFrame, limit: int, word: str, lo: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Leaves ``(up, depth, prefix, bytes, n)`` of the buckets in ``rows``
    (``up`` names the bucket they come from) after up to ``bits`` bits from bit
    ``lo`` of a key word, and the buckets that are still too large."""
    cells = rows.groupBy("_up", _top(F.col(f"_key.{word}"), lo, bits).alias("cell")).agg(
        F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    depths = cells.select("_up", "cell", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    nodes = depths.groupBy("_up", "depth", F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix")).agg(
        F.sum("b").alias("bytes"), F.sum("n").alias("n"))
    path = scratch_path(rows.sparkSession, "shard-buckets")
    nodes.write.parquet(path)
    nodes = rows.sparkSession.read.parquet(path)
    large = (F.col("bytes") > limit) & (F.col("n") > 1)
    parents = nodes.where(large).select("_up", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    small = nodes.where(~large).withColumn("up", F.expr("shiftright(prefix, 1)"))
    leaves = small.where("depth = 0").drop("up").unionByName(
        small.where("depth > 0").join(parents, ["_up", "depth", "up"], "left_semi").drop("up"))
    return leaves, nodes.where(large & (F.col("depth") == bits))


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with ``shard`` (the bucket's hash prefix as a bit string; '' is
    the whole table), ``shard_depth`` (its length) and ``shard_bytes``.

    Every shard holds at most ``limit`` bytes of text, but for one that a
    single larger row fills alone.  Null text has 0 bytes; a null doc_id
    hashes like the empty text; rows that repeat, even whole rows, are told
    apart by later key words.  An empty table gives an empty result.  Columns
    of ``docs`` named ``shard``, ``shard_depth`` or ``shard_bytes`` are replaced.
    """
    given = [c for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes")]
    plain, c = tk.numbered(docs.select(*given))
    total = plain.agg(F.sum(text_bytes(c["text"])).alias("b")).first()["b"] or 0
    bits = min(WORD_BITS, max(4, math.ceil(math.log2(max(1.0, total / limit))) + 5))
    rows = _keyed(plain, c).withColumn("_up", F.lit(""))
    done = None
    at = 0
    while at < 3 * WORD_BITS:
        word, lo = f"w{at // WORD_BITS}", at % WORD_BITS
        if word == "w2" and lo == 0:  # rows equal in all: their place, written down so that it stays
            path = scratch_path(docs.sparkSession, "shard-equal")
            place = _word(F.monotonically_increasing_id().cast("string"))
            rows.withColumn("_key", F.struct(place.alias("w2"))).write.parquet(path)
            rows = docs.sparkSession.read.parquet(path)
        n = min(bits, WORD_BITS - lo)
        leaves, over = directory(rows, limit, word, lo, n)
        last = at + n >= 3 * WORD_BITS
        cell = _top(F.col(f"_key.{word}"), lo, n)
        named = leaves.select("_up", "depth", "prefix", "bytes", F.concat(
            "_up", F.expr("if(depth = 0, '', lpad(bin(prefix), depth, '0'))")).alias("shard"))
        if last:  # rows of equal key fill one bucket
            named = named.unionByName(over.select("_up", "depth", "prefix", "bytes", F.concat(
                "_up", F.expr("lpad(bin(prefix), depth, '0')")).alias("shard")))
        # the directory: each cell of the finest depth points at its bucket
        table = named.select("_up", "shard", "bytes", F.explode(F.expr(
            f"sequence(shiftleft(prefix, {n} - depth), shiftleft(prefix + 1, {n} - depth) - 1)")).alias("_cell"))
        placed = rows.withColumn("_cell", cell).join(table, ["_up", "_cell"], "inner").select(
            *[F.col(n).alias(x) for x, n in c.items()], "shard", F.length("shard").alias("shard_depth"), F.col("bytes").alias("shard_bytes"))
        done = placed if done is None else done.unionByName(placed)
        if last or over.isEmpty():
            break
        rest = over.select("_up", F.col("prefix").alias("_cell"), F.concat(
            "_up", F.expr("lpad(bin(prefix), depth, '0')")).alias("_next"))
        rows = rows.withColumn("_cell", cell).join(rest, ["_up", "_cell"], "inner").drop("_up", "_cell") \
            .withColumnRenamed("_next", "_up")
        at += n
    return done


ORACLE = f"""
WITH k AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes,
    lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), {WORD_BITS}, '0') AS h FROM documents),
t AS (SELECT d, left(h, d) AS p, CAST(sum(bytes) AS BIGINT) AS b, count(*) AS n FROM k, range({WORD_BITS} + 1) r(d)
  GROUP BY d, p)
SELECT doc_id, bytes, arg_min(p, d) AS shard, CAST(min(d) AS INTEGER) AS shard_depth, arg_min(b, d) AS shard_bytes
FROM k JOIN t ON t.p = left(k.h, t.d) WHERE b <= {SHARD_BYTES} OR n = 1 GROUP BY doc_id, bytes
"""
