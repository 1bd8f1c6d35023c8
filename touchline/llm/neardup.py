"""Near duplicates by an LSH forest over MinHash signatures (operator 4).

1. Each text becomes its set of 5-word shingles, a 128-bit fingerprint of the
   set and a signature of ``trees * width`` MinHash values.  Equal sets are one
   node from here on, however many copies there are.
2. Each tree sorts the nodes by the signature, rotated to start at the tree's
   own values.  A region is a run of nodes that share at least ``min_depth``
   values; nodes alone in theirs leave the tree.  The sorted order is dealt to
   tasks by ranges, so a large region spreads over many.
3. A task walks along the order.  In a region of up to ``leaf`` nodes all are
   neighbours; in a larger one each node's neighbours are at first those within
   half a leaf before or after it, which are the ones with the longest common
   prefix.  Neighbours whose signatures agree on ``probe`` of all values are
   candidates (a true pair is over 4.5 standard deviations above the probe).
   What is passed on is a spanning forest of the candidate graph, so it grows
   with the nodes and not with the pairs.
4. A region that is larger than ``leaf`` or lies at the border of a task is
   open: its nodes then meet in pairs of blocks (``_across``), except those that
   are connected already.  So every pair of every region is compared or
   connected, whatever the number of tasks.
5. The forests give loose groups, outside of which there is no candidate pair.
   The full shingle sets of a loose group meet once; every candidate pair that
   is not yet connected is confirmed on them, and the confirmed links give the
   components.  The sets of a loose group of more than ``leaf`` nodes, or of
   more than ``leaf_bytes`` in all, meet along the sorted orders first, in every
   tree, and what that leaves apart meets in pairs of blocks; parts and blocks
   are bounded in rows and bytes, so few long texts are cut like many short ones.

A pair at the threshold (0.85) shares a region in one of 16 trees with
probability 1 - (1 - 0.85^4)^16 = 0.999992.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm import textkit as tk
from touchline.llm.graph import Union, components
from touchline.session import scratch_path


@dataclass(frozen=True)
class Forest:
    trees: int = 16
    width: int = 8
    min_depth: int = 4
    leaf: int = 4096
    leaf_bytes: int = 64 << 20  # of shingle sets that meet whole
    probe: float = 0.70
    numerator: int = 85  # links need 100 * intersection >= numerator * union
    shingle: int = 5

    @property
    def size(self) -> int:
        return self.trees * self.width


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    """MinHash values (uint32) of a non-empty set of 64-bit hashes."""
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), block):
        np.minimum(best, (s[i:i + block, None] * a[None, :] + b[None, :]).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def _sets(batch_text: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo, _, data, offs in tk.documents(batch_text):
        st, en, wo = tk.find_words(data, offs)
        yield lo, tk.shingle_sets(tk.hash_words(data, st, en), wo, size)


def _fingerprint(s: np.ndarray) -> bytes:
    """128 bits of a sorted set; equal sets have equal fingerprints."""
    if len(s) == 0:
        return b""
    p = tk.powers(len(s))
    x = np.add.reduce(tk.mix(s) * p)
    y = np.add.reduce(tk.mix(s ^ np.uint64(0xA0761D6478BD642F)) * p[::-1])
    n = np.uint64(len(s))
    return tk.mix(np.array([x + n, y ^ n], np.uint64)).tobytes()


def sketches(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """``doc_id, row_key, fp, n_shingles, sig`` of each row of ``docs``."""
    a, b = _multipliers(f.size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            fps, ns, sigs = [], [], []
            for _, sets in _sets(text, f.shingle):
                for s in sets:
                    fps.append(_fingerprint(s))
                    ns.append(len(s))
                    sigs.append(signature(s, a, b).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), tk.binary_array(fps), pa.array(ns, pa.int64()),
                 tk.binary_array(sigs)], names=["doc_id", "row_key", "fp", "n_shingles", "sig"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key"),
                      F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, row_key long, fp binary, n_shingles long, sig binary")


def _orders(f: Forest):
    """Arrow function ``(fp, sig)`` -> ``(key, fp, brief)`` for each tree: the
    key names the tree and the first values of its order, the region; ``brief``
    is the whole order with 8 bits of each value."""
    mult = _multipliers(f.size)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, sig = batch.column(0), batch.column(1)
            if len(fp) == 0:
                continue
            m = np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(fp), f.size)
            for t in range(f.trees):
                turned = np.roll(m, -t * f.width, axis=1)
                h = np.full(len(fp), (t + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                for j in range(f.min_depth):
                    h = tk.mix(h + turned[:, j].astype(np.uint64) * mult[j])
                brief = tk.binary_array([r.tobytes() for r in (turned & np.uint32(255)).astype(np.uint8)])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), fp, brief],
                                                 names=["key", "fp", "brief"])
    return run


def _runs(f: Forest, work, columns: int, cut: bool = True, note: bool = False):
    """Arrow function over rows sorted by their first column (a key):
    ``work`` gets the other columns of the rows of one key as lists and gives
    pairs.  More than ``leaf`` rows of a key, or rows whose last column has more
    than ``leaf_bytes`` if it holds sets, are worked on in parts of that size,
    each sharing half of its rows with the next (not so without ``cut``).
    With ``note``, a third column names the keys whose rows did not surely all
    meet: those in parts, and the first and last key of the task."""
    names = ["a", "b", "key"] if note else ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, fresh, size = None, [[] for _ in range(columns)], 0, 0
        noted: list[int] = []

        def out() -> Iterator[pa.RecordBatch]:
            if fresh and len(held[0]) > 1:
                left, right = work(*held)
                if left:
                    pairs = [tk.binary_array(left), tk.binary_array(right)]
                    yield pa.RecordBatch.from_arrays(
                        pairs + ([pa.nulls(len(left), pa.int64())] if note else []), names=names)

        for batch in batches:
            for k, *row in zip(*(batch.column(i).to_pylist() for i in range(columns + 1)), strict=True):
                if k != key or (cut and (len(held[0]) >= f.leaf or (size >= f.leaf_bytes and len(held[0]) > 1))):
                    yield from out()
                    if note and (k == key or not noted) and k not in noted[-1:]:
                        noted.append(k)
                    for h in held:
                        del h[:(len(h) if k != key else len(h) - len(h) // 2)]
                    key, fresh = k, 0
                    size = sum(map(len, held[-1])) if columns == 3 else 0
                for h, x in zip(held, row, strict=True):
                    h.append(x)
                size += len(row[-1]) if columns == 3 else 0  # whole sets come last of three
                fresh += 1
        yield from out()
        if note and key is not None:
            keys = sorted({*noted, key})
            none = pa.nulls(len(keys), pa.binary())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(keys, pa.int64())], names=names)
    return run


def _forest(f: Forest):
    """Spanning forest of the candidate graph of one region."""
    need = int(np.ceil(f.probe * f.size))

    def work(fps: list[bytes], brief: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        m = np.frombuffer(b"".join(brief), np.uint8).reshape(len(fps), f.size)
        left, right = [], []
        rest = np.arange(len(fps))
        queue: list[int] = []
        while len(rest):
            if not queue:
                queue.append(int(rest[0]))
                rest = rest[1:]
                continue
            i = queue.pop()
            near = (m[rest] == m[i]).sum(axis=1) >= need
            for j in rest[near].tolist():
                left.append(min(fps[i], fps[j]))
                right.append(max(fps[i], fps[j]))
                queue.append(j)
            rest = rest[~near]
        return left, right
    return work


def _linked(x: np.ndarray, y: np.ndarray, f: Forest) -> bool:
    """Whether two sorted sets are similar enough for a link."""
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= f.numerator * (len(x) + len(y) - both)


def _confirmed(f: Forest):
    """Spanning forest of the confirmed links of one group of whole sets."""
    need = int(np.ceil(f.probe * f.size))

    def work(fps: list[bytes], brief: list[bytes], sets: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        m = np.frombuffer(b"".join(brief), np.uint8).reshape(len(fps), f.size)
        s = [np.frombuffer(x, np.uint64) for x in sets]
        size = np.array([len(x) for x in s])
        order = np.argsort(size, kind="stable")
        m, size = m[order], size[order]
        seen, left, right = Union(), [], []
        for i in range(len(order) - 1):
            end = np.searchsorted(size, size[i] * 100 // f.numerator, side="right")  # larger sets cannot link
            near = (m[i + 1:end] == m[i]).sum(axis=1) >= need
            x = s[order[i]]
            for j in (np.flatnonzero(near) + i + 1).tolist():
                if seen.find(i) == seen.find(j):
                    continue
                if _linked(x, s[order[j]], f):
                    seen.join(i, j)
                    p, q = fps[order[i]], fps[order[j]]
                    left.append(min(p, q))
                    right.append(max(p, q))
        return left, right
    return work


def _apart(f: Forest, whole: bool):
    """Spanning forest of the links between differently labelled rows of two
    blocks (or within one): candidates, or confirmed on ``whole`` sets."""
    need = int(np.ceil(f.probe * f.size))

    def work(fps: list[bytes], brief: list[bytes], root: list[bytes], block: list[int],
             sets: list[bytes] | None = None) -> tuple[list[bytes], list[bytes]]:
        m = np.frombuffer(b"".join(brief), np.uint8).reshape(len(fps), f.size)
        code: dict[bytes, int] = {}
        label = np.array([code.setdefault(r, len(code)) for r in root])
        side = np.array(block)
        first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
        s = [np.frombuffer(x, np.uint64) for x in sets] if whole else []
        size = np.array([len(x) for x in s])
        left, right = [], []
        for i in first.tolist():
            rest = second[label[second] != label[i]]
            if side[0] == side.max() == side.min():
                rest = rest[rest > i]
            if whole:  # sets of too different sizes cannot link
                rest = rest[100 * np.minimum(size[rest], size[i]) >= f.numerator * np.maximum(size[rest], size[i])]
            if not len(rest):
                continue
            for j in rest[(m[rest] == m[i]).sum(axis=1) >= need].tolist():
                if label[i] == label[j] or (whole and not _linked(s[i], s[j], f)):
                    continue
                label[label == label[j]] = label[i]
                left.append(min(fps[i], fps[j]))
                right.append(max(fps[i], fps[j]))
        return left, right
    return work


def _across(rows: DataFrame, f: Forest, whole: bool = False) -> DataFrame:
    """Links ``(a, b)`` between nodes of one ``group`` that differ in ``root``,
    of ``(group, fp, brief, root)`` and ``shingles`` if ``whole``.

    The nodes of a group are dealt to blocks of half a leaf or so (in rows, and
    in bytes of whole sets), a root with more nodes than that to blocks of its
    own; each pair of blocks meets in a task of its own, except two blocks of
    one root."""
    size, room = max(1, f.leaf // 2), max(1, f.leaf_bytes // 2)
    spark = rows.sparkSession
    path = scratch_path(spark, "neardup-blocks")
    weight = F.sum(F.length("shingles")) if whole else F.lit(0)
    # a node weighs as much of a block as its row or its bytes take, whichever is more
    rows.groupBy("group", "root").agg(F.greatest(F.count(F.lit(1)).cast("double"), weight * F.lit(size / room)).alias("n")) \
        .write.parquet(path)
    counts = spark.read.parquet(path)
    blocks = F.ceil(F.col("n") / F.lit(size))
    before = Window.partitionBy("group").orderBy("root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = (counts.where(F.col("n") > size)  # few roots: each has over half a leaf of nodes
           .select("group", "root", blocks.alias("width"), F.sum(blocks).over(before).alias("end")))
    total = (counts.groupBy("group")
             .agg(F.sum(F.when(F.col("n") > size, blocks).otherwise(0)).alias("owned"),
                  F.ceil(F.sum(F.when(F.col("n") > size, 0).otherwise(F.col("n"))) / F.lit(size)).alias("shared"),
                  F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots"))
    placed = rows.join(total, "group").join(own, ["group", "root"], "left")
    start = F.coalesce(F.col("end") - F.col("width"), F.col("owned"))
    width = F.coalesce(F.col("width"), F.col("shared"))
    placed = placed.withColumn("block", start + F.pmod(F.xxhash64("fp"), width)).withColumn("other", F.explode(F.filter(
        F.sequence(F.lit(0).cast("long"), F.col("owned") + F.col("shared") - 1),
        lambda j: F.col("end").isNull() | (j < start) | (j >= F.col("end")))))
    key = F.concat_ws(":", F.hex("group"), F.least("block", "other"), F.greatest("block", "other")).alias("key")
    return (placed.select(key, "fp", "brief", "root", "block", *(["shingles"] if whole else []))
            .repartition("key").sortWithinPartitions("key")
            .mapInArrow(_runs(f, _apart(f, whole), 5 if whole else 4, cut=False), "a binary, b binary"))


def ordered(nodes: DataFrame, f: Forest = Forest()) -> DataFrame:
    """``(key, fp, brief)``: the nodes ``(fp, sig)`` in every tree's order,
    without those alone in their region."""
    keyed = nodes.select("fp", "sig").mapInArrow(_orders(f), "key long, fp binary, brief binary")
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(several, "key", "left_semi")


def _rooted(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of their ``fp``; a node of no link is its own."""
    return rows.join(comp, rows["fp"] == comp["node"], "left").drop("node") \
        .withColumn("root", F.coalesce("root", "fp"))


def candidates(nodes: DataFrame, f: Forest = Forest()) -> DataFrame:
    """Pairs ``(a, b)`` of fingerprints that span the candidate graph of a
    table ``(fp, sig)``."""
    spark = nodes.sparkSession
    path = scratch_path(spark, "neardup-pairs")
    (ordered(nodes, f).repartitionByRange("key", "brief").sortWithinPartitions("key", "brief", "fp")
     .mapInArrow(_runs(f, _forest(f), 2, note=True), "a binary, b binary, key long").write.parquet(path))
    found = spark.read.parquet(path)
    pairs = found.where("key is null").select("a", "b")
    keyed = nodes.select("fp", "sig").mapInArrow(_orders(f), "key long, fp binary, brief binary")
    path = scratch_path(spark, "neardup-open")
    keyed.join(found.where("key is not null").select("key").distinct(), "key", "left_semi").write.parquet(path)
    still = _rooted(spark.read.parquet(path).withColumnRenamed("key", "group"), components(pairs))
    path = scratch_path(spark, "neardup-more")
    _across(still, f).write.parquet(path)
    return pairs.unionByName(spark.read.parquet(path))


def confirm(docs: DataFrame, nodes: DataFrame, loose: DataFrame, f: Forest = Forest()) -> DataFrame:
    """Links ``(a, b)`` that connect what full shingle sets connect, from the
    loose groups ``(node, root)``."""
    spark = nodes.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, sig = batch.column(1), batch.column(2)
            for lo, part in _sets(batch.column(0), f.shingle):
                rows = [s.tobytes() for s in part]
                fps = [_fingerprint(s) for s in part]
                m = np.frombuffer(b"".join(sig.slice(lo, len(part)).to_pylist()), np.uint32)
                brief = (m & np.uint32(255)).astype(np.uint8).reshape(len(part), f.size)
                yield pa.RecordBatch.from_arrays(
                    [group.slice(lo, len(part)), tk.binary_array(fps), tk.binary_array([r.tobytes() for r in brief]),
                     tk.binary_array(rows)], names=["group", "fp", "brief", "shingles"])

    path = scratch_path(spark, "neardup-sizes")
    weighed = loose.join(nodes.select("fp", "shingle_count"), F.col("node") == F.col("fp"))
    weighed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("shingle_count") * 8).alias("bytes")).write.parquet(path)
    sizes = spark.read.parquet(path)
    small = (F.col("n") <= f.leaf) & (F.col("bytes") <= f.leaf_bytes)
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row_key"),
                        F.col("text").cast("string").alias("text"))

    def full(groups: DataFrame) -> DataFrame:
        """Whole sets of the nodes of ``groups``, one row each (repeated rows once)."""
        of = loose.join(groups.select("root"), "root", "left_semi")
        want = nodes.join(of, nodes["fp"] == of["node"]).select("row_key", F.col("root").alias("group"), "sig")
        texts = keyed.join(want, "row_key").dropDuplicates(["row_key"])
        return texts.select("text", "group", "sig").mapInArrow(
            sets, "group binary, fp binary, brief binary, shingles binary")

    whole = (full(sizes.where(small)).repartition("group").sortWithinPartitions("group")
             .mapInArrow(_runs(f, _confirmed(f), 3), "a binary, b binary"))
    large = sizes.where(~small)
    if large.isEmpty():
        return whole
    path = scratch_path(spark, "neardup-sets")
    full(large).write.parquet(path)
    big = spark.read.parquet(path)
    part = ordered(nodes.join(big.select("fp"), "fp", "left_semi"), f).join(big.drop("group", "brief"), "fp").select(
        "key", "fp", "brief", "shingles")
    path = scratch_path(spark, "neardup-along")
    part.repartitionByRange("key", "brief").sortWithinPartitions("key", "brief", "fp").mapInArrow(
        _runs(f, _confirmed(f), 3), "a binary, b binary").write.parquet(path)
    along = spark.read.parquet(path)
    return whole.unionByName(along).unionByName(_across(_rooted(big, components(along)), f, whole=True))


def near_duplicates(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept`` (and
    ``row_key``, a hash of id and text, and ``root``, the component's own key).

    ``component_id`` is the smallest doc_id among the texts reachable over
    links (itself included); ``kept`` tells whether the row carries that id.
    Null or empty texts and texts of white space have no shingles, link with
    nothing and are kept.  Repeated rows have equal sets and share a
    component.  A null doc_id never becomes a component's id unless all ids
    of the component are null; such a row then has a null component and is
    kept.  Extra columns of ``docs`` are ignored; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "neardup-sketches")
    sketches(docs, f).write.parquet(path)
    rows = spark.read.parquet(path)
    node_path = scratch_path(spark, "neardup-nodes")
    (rows.where("n_shingles > 0").groupBy("fp")
     .agg(F.min("doc_id").alias("first_id"), F.min("row_key").alias("row_key"), F.first("sig").alias("sig"),
          F.first("n_shingles").alias("shingle_count"))
     .write.parquet(node_path))
    nodes = spark.read.parquet(node_path)
    loose = components(candidates(nodes, f))
    link_path = scratch_path(spark, "neardup-links")
    confirm(docs, nodes, loose, f).write.parquet(link_path)
    comp = components(spark.read.parquet(link_path))
    member_path, id_path = scratch_path(spark, "neardup-members"), scratch_path(spark, "neardup-ids")
    (nodes.select("fp", "first_id").join(comp, nodes["fp"] == comp["node"], "left")
     .select("fp", "first_id", F.coalesce("root", "fp").alias("root")).write.parquet(member_path))
    of = spark.read.parquet(member_path)
    # a table of its own, so that Spark can split the join at a component of many texts
    of.groupBy("root").agg(F.min("first_id").alias("component_id")).write.parquet(id_path)
    named = of.join(spark.read.parquet(id_path), "root").select("fp", "root", "component_id")
    out = rows.select("doc_id", "row_key", "n_shingles", "fp").join(named, "fp", "left")
    cid = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"),
                      F.col("doc_id").eqNullSafe(cid).alias("kept"), "row_key", "root")


def keep_one(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id,
    and one only where rows repeat.  Texts without words all stay."""
    kept = near_duplicates(docs, f).where("kept and n_shingles > 0")
    one = kept.groupBy("root").agg(F.min("row_key").alias("_row_key")).select("_row_key").distinct()
    plain, c = tk.numbered(docs)
    keyed = plain.withColumn("_row_key", F.xxhash64(F.col(c["doc_id"]).cast("long"), F.col(c["text"])))
    worded = F.coalesce(F.col(c["text"]), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    # rows repeated in full are one before they meet the kept keys
    stay = keyed.where(worded).dropDuplicates(["_row_key"]).join(one, "_row_key", "left_semi")
    return stay.drop("_row_key").unionByName(plain.where(~worded)).toDF(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
    ELSE list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN m ON m.v = s.doc_id
"""
