"""The members over rows in many tasks: no task holds more than its share.

Boosters: a fit is a stage with a task for every ``BOOSTER_ROWS`` rows, which keeps
them as bytes.  For each level of a tree the tasks add up the whole-number
gradients of their rows by tree, node, column and code.  If there are several,
it is a barrier stage: they exchange these sums, whose size follows from nodes,
columns and codes and not from the rows, and find the same best splits.  Of two
sibling nodes only the lighter one is summed, the other has what is left of
their parent's.  Sums of whole numbers do not depend on how rows are dealt out,
so the trees are those that one task would grow from the same rows.  A barrier
takes Spark a second, so few tasks with many rows end sooner.  A stage ends after
``KEEP`` rounds and the next goes on from its trees, so a lost executor costs at
most the work since then.

Forest: every tree draws a bootstrap of n of the n rows, as in one task.  Its upper
nodes, those of more than ``node_rows`` rows, are split level by level from counts
that tasks add up by node, column, code and class; rows stay where they are.  Then the
drawn rows are shuffled by tree and node, and a task grows a node to the end.  Trees
go through this some at a time, so that about ``LIVE_ROWS`` drawn rows are on disk at
once, and end as rows of a table: the driver holds upper nodes only.
"""

from __future__ import annotations

import base64
import json
import pickle
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.ship import ensure_package
from touchline.learners import codes as cd
from touchline.learners import grow
from touchline.learners import members as mb
from touchline.session import scratch_path, shuffles_freed

KEEP = 100  # rounds of a stage
BOOSTER_ROWS = 1_000_000  # that a task of a booster holds, about 0.5 GB at 80 columns
PAIRED_ROWS = 4096  # from which a booster in one task sums two columns at a time
LIVE_ROWS = 20_000_000  # drawn rows of the trees that grow side by side
STRETCH = 1 << 16  # rows that are counted together
K = mb.CLASSES
Total = Callable[[np.ndarray], np.ndarray]  # whole numbers of a task -> their sums over all tasks


@dataclass
class Part:
    """A task's rows."""
    key: np.ndarray
    y: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(batches: Iterator[pa.RecordBatch], width: int) -> Part:
        own = [(b.column(0).to_numpy().astype(np.int64).view(np.uint64), b.column(1).to_numpy().astype(np.int64),
                cd.unpacked(b.column(2), width).copy()) for b in batches]
        own = own or [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, width), np.uint8))]
        return Part(*(np.concatenate(x) for x in zip(*own, strict=True)))


def packed_numbers(x: np.ndarray) -> str:
    """Whole numbers as a short text."""
    kind = np.int32 if np.abs(x).max(initial=0) < 2 ** 31 else np.int64
    return f"{np.dtype(kind).itemsize}" + base64.b64encode(zlib.compress(np.rint(x).astype(kind).tobytes(), 1)).decode()


def unpacked_numbers(text: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(base64.b64decode(text[1:])), f"i{text[0]}")


def tasks_at_once(spark: SparkSession) -> int:
    """Tasks that run side by side, as all tasks of a barrier stage must."""
    sc = spark.sparkContext
    each = spark.conf.get("spark.executor.cores", None)
    executors = sc._jsc.sc().getExecutorMemoryStatus().size() - 1  # the driver is among them
    most = executors * int(each) if each and executors > 0 and not sc.master.startswith("local[") else sc.defaultParallelism
    return max(1, min(sc.defaultParallelism, most))


def _boosted(rows: DataFrame, width: int, rounds: int, grown: Callable[[Part, Total, list, int], list]) -> list:
    """The results of all rounds; ``grown`` makes some more, given those before."""
    spark = rows.sparkSession
    ensure_package(spark)
    tasks = min(tasks_at_once(spark), max(1, -(-rows.count() // BOOSTER_ROWS)))
    dealt = rows.select("key", F.col("outcome").cast("int").alias("outcome"), "codes").repartition(tasks)
    done: list = []
    while len(done) < rounds:
        def run(batches: Iterator[pa.RecordBatch], before=tuple(done), more=min(KEEP, rounds - len(done))) -> Iterator[pa.RecordBatch]:
            part = Part.of(batches, width)

            def total(x: np.ndarray) -> np.ndarray:
                if tasks == 1:
                    return x
                out = np.zeros(x.size)
                for text in BarrierTaskContext.get().allGather(packed_numbers(x)):
                    out += unpacked_numbers(text)
                return out.reshape(x.shape)

            made = grown(part, total, list(before), more)
            if TaskContext.get().partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["made"])

        done += pickle.loads(bytes(dealt.mapInArrow(run, "made binary", barrier=tasks > 1).collect()[0]["made"]))  # trees of some rounds
    return done


def _with_siblings(parent: np.ndarray, lighter: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sums of both children of each node (second axis) from its own and from
    those of its lighter child, which is the right one where ``right``."""
    other, at = parent - lighter, right[None, :, None, None]
    return np.stack([np.where(at, other, lighter), np.where(at, lighter, other)], axis=2).reshape(
        len(parent), -1, *parent.shape[2:])


# ---------------------------------------------------------------- softmax boosting
def fit_softmax(rows: DataFrame, width: int, p: mb.VoteParams) -> mb.Softmax:
    """As ``members.fit_softmax``, over ``key, outcome, codes`` in many tasks."""
    return mb.Softmax(_boosted(rows, width, p.xgb_n_estimators, lambda *a: _softmax(*a, width, p)), K)


def _softmax(part: Part, total: Total, before: list, more: int, width: int, p: mb.VoteParams) -> list[list[grow.Heap]]:
    rules, n = p.softmax(), len(part.y)
    pairs = grow.ColumnPairs(part.codes, rules.bins)
    flat, base = np.ascontiguousarray(part.codes).ravel(), np.arange(n) * width
    margin, rounds = np.zeros((n, K)), []
    for trees in before:
        for k, heap in enumerate(trees):
            margin[:, k] += heap.value.take(heap.leaf(part.codes))
    for turn in range(len(before), len(before) + more):
        trees = [grow.SoftmaxTree(grow.drawn_columns(width, rules, p.seed, turn, k), rules) for k in range(K)]
        fields, places, drawn, right = [], [], [], [np.zeros(0, bool)] * K
        sums: list[np.ndarray] = []
        for k in range(K):
            g, h = grow.softmax_gradients(margin, part.y, k)
            mine = np.zeros(n, bool)
            mine[grow.drawn_rows(part.key, rules, p.seed, turn, k)] = True
            fields.append([np.where(mine, x, 0) for x in (g, h)])
            drawn.append(mine)
            places.append(np.zeros(n, np.int64))
        for level in range(rules.depth):
            own = []
            for k, tree in enumerate(trees):
                if level:
                    pick = np.flatnonzero(drawn[k] & ((places[k] & 1) == right[k][places[k] >> 1]))
                    got = pairs.sums(pick, places[k][pick] >> 1, [x[pick] for x in fields[k]], 1 << (level - 1))
                else:
                    got = pairs.sums(None, places[k], fields[k], 1)
                own.append(got[:, :, tree.columns])
            every = total(np.stack(own))
            sums = [_with_siblings(sums[k], every[k], right[k]) for k in range(K)] if level else list(every)
            for k, tree in enumerate(trees):
                best, gain = grow.best_softmax_splits(*sums[k], rules)
                tree.split(best, gain)
                column, code = np.divmod(best, rules.bins)
                split, node = tree.open[::2], np.arange(1 << level)
                h = np.cumsum(sums[k][1], axis=2)
                right[k] = ~split | (2 * h[node, column, code] > h[:, 0, -1])  # unsplit: all rows pass to the left
                at = (1 << level) - 1 + places[k]
                heap = tree.heap
                places[k] = 2 * places[k] + (flat.take(base + heap.feature.take(at)) > heap.cut.take(at))
        leaves = 1 << rules.depth
        s = total(np.array([[np.bincount(places[k], weights=x, minlength=leaves) for x in fields[k]] for k in range(K)]))
        rounds.append([t.set_leaves(*s[k]) for k, t in enumerate(trees)])
        for k, heap in enumerate(rounds[-1]):
            margin[:, k] += heap.value.take(places[k])
    return rounds


# ---------------------------------------------------------------- symmetric trees
def fit_symmetric(rows: DataFrame, width: int, p: mb.VoteParams) -> mb.Symmetric:
    """As ``members.fit_symmetric``, over ``key, outcome, codes`` in many tasks."""
    return mb.Symmetric([t for t, _ in _boosted(rows, width, p.cat_iterations, lambda *a: _symmetric(*a, width, p))], K)


def _symmetric(part: Part, total: Total, before: list, more: int, width: int, p: mb.VoteParams,
               keep: bool = True) -> list[tuple[grow.Symmetric, np.ndarray | None]]:
    """Trees, each with the sums of earlier blocks of rows that its ordered values follow from, if they are kept."""
    rules, n, leaves = p.symmetric(), len(part.y), 1 << p.symmetric().depth
    pairs, block = grow.ColumnPairs(part.codes, rules.bins), grow.random_block(part.key, p.seed)
    columns = np.ascontiguousarray(part.codes.T)
    ordered, margin, ones = np.zeros((n, K)), np.zeros((n, K)), np.ones(n, np.int64)
    made = []
    for tree, sums in before:
        leaf = tree.leaf_of(columns)
        ordered += grow.ordered_gain(leaf, block, sums, rules)
        margin += tree.value[leaf]
    for _ in range(more):
        r, h = grow.residuals(ordered, part.y)
        fields = [*(r[:, k] for k in range(K - 1)), ones]
        leaf, right, sums = np.zeros(n, np.int64), np.zeros(0, bool), np.zeros(0)
        feature, cut = [], []
        for level in range(rules.depth):
            if level:
                pick = np.flatnonzero((leaf & 1) == right[leaf >> 1])
                sums = _with_siblings(sums, total(pairs.sums(pick, leaf[pick] >> 1, [x[pick] for x in fields], 1 << (level - 1))), right)
            else:
                sums = total(pairs.sums(None, leaf, fields, 1))
            there = np.flatnonzero(sums[-1, :, 0].sum(axis=1) > 1)  # a leaf of one row or none has no say
            running = np.cumsum(sums, axis=3)
            score = np.zeros((width, rules.bins - 1))
            for lo in range(0, len(there), grow.LEAVES):
                score += grow.symmetric_scores(list(running[:, there[lo:lo + grow.LEAVES]]), rules)
            f, c = grow.split_at(score)
            feature.append(f)
            cut.append(c)
            count = running[-1, :, f]
            right = 2 * count[:, c * rules.bins // 256] > count[:, -1]
            leaf = 2 * leaf + (columns[f] > c)
        pr, ph = grow.residuals(margin, part.y)
        s = total(np.concatenate([np.array([[np.bincount(leaf, weights=x[:, k], minlength=leaves) for k in range(K)] for x in (pr, ph)])[..., None],
                                  grow.block_sums(leaf, block, r, h, leaves)], axis=-1))
        value = grow.leaf_values(s[0, :, :, 0].T, s[1, :, :, 0].T, rules)
        tree = grow.Symmetric(np.array(feature, np.int32), np.array(cut, np.int32), value)
        sums = grow.earlier(s[..., 1:])
        made.append((tree, sums if keep else None))
        ordered += grow.ordered_gain(leaf, block, sums, rules)
        margin += value[leaf]
    return made


def fit_booster(member: str, codes: np.ndarray, y: np.ndarray, key: np.ndarray, p: mb.VoteParams) -> mb.Member:
    """``members.fit`` of a booster on rows of one task: the same trees, from sums of
    two columns at a time where the rows are enough for that to take less time."""
    if len(y) < PAIRED_ROWS:
        return mb.fit(member, codes, y, key, p)
    part, width = Part(key, y, codes), codes.shape[1]
    if member == "xgb":
        return mb.Softmax(_softmax(part, lambda x: x, [], p.xgb_n_estimators, width, p), K)
    return mb.Symmetric([t for t, _ in _symmetric(part, lambda x: x, [], p.cat_iterations, width, p, keep=False)], K)


# ---------------------------------------------------------------- forest
class Top:
    """The upper nodes of a tree.  A node is split, a leaf, ``open`` (to be split
    by counts; with its draws of columns so far) or ``hung`` (a task grows it)."""

    def __init__(self, tree: int, p: mb.VoteParams, width: int, weight: np.ndarray, n: int, node_rows: int) -> None:
        self.tree, self.rules, self.seed, self.width, self.weight, self.node_rows = tree, p.forest(), p.seed, width, weight, node_rows
        self.feature, self.cut, self.left, self.depth = [-1], [0], [0], [0]
        self.value = [[1.0 / K] * K]
        self.fall = np.zeros(width)  # summed decrease of impurity by column
        self.open = {0: 0} if n > node_rows else {}
        self.hung = set() if n > node_rows else {0}

    def columns(self, node: int) -> np.ndarray:
        """Random columns of an open node."""
        order = np.argsort(grow.mixed(np.arange(self.width, dtype=grow.U64), self.seed, self.tree, node, self.open[node], 11), kind="stable")
        return order[:max(1, int(np.sqrt(self.width)))]

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The lowest node of each row."""
        n, width = codes.shape
        feature, inner = np.array(self.feature), np.array(self.feature) >= 0
        packed = np.arange(len(feature)) << 8
        packed[inner] = grow.packed_nodes(feature[inner], np.array(self.cut)[inner], np.array(self.left)[inner])
        flat, base, at = np.ascontiguousarray(codes).ravel(), np.arange(n) * width, np.zeros(n, np.int64)
        for _ in range(max(self.depth)):
            at = grow.below(packed, flat, base, at)
        return at

    def shares(self, mass: list[int]) -> list[float]:
        m = np.array(mass) * self.weight
        return (m / m.sum()).tolist() if m.sum() > 0 else [1.0 / K] * K

    def split(self, r: dict) -> None:
        """Takes an open node a step on by the best split that its counts gave."""
        node = r["node"]
        tried = self.open.pop(node) + 1
        self.value[node] = self.shares(np.add(r["left_mass"], r["right_mass"]))
        if r["feature"] < 0:
            if r["fit"] and tried < self.rules.tries:
                self.open[node] = tried
            return
        self.feature[node], self.cut[node], self.left[node] = r["feature"], r["cut"], len(self.feature)
        self.fall[r["feature"]] += r["fall"]
        level = self.depth[node] + 1
        for count, mass in ((r["left_rows"], r["left_mass"]), (r["right_rows"], r["right_mass"])):
            if may_split(count, mass, level, self.rules):
                if count > self.node_rows:
                    self.open[len(self.feature)] = 0
                else:
                    self.hung.add(len(self.feature))
            for own, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.depth, level), (self.value, self.shares(mass))):
                own.append(x)

    def whole(self, below: list[tuple[int, grow.Trees]]) -> grow.Trees:
        """The tree, with what grew from its hung nodes."""
        feature, cut, left = ([np.array(x, np.int32)] for x in (self.feature, self.cut, self.left))
        value, made = [np.array(self.value, np.float32)], len(self.feature)
        for node, t in below:
            at = np.where(t.feature >= 0, t.left + (made - 1), 0).astype(np.int32)  # its root stands where the node is
            feature[0][node], cut[0][node], left[0][node], value[0][node] = t.feature[0], t.cut[0], at[0], t.value[0]
            for own, x in ((feature, t.feature), (cut, t.cut), (left, at), (value, t.value)):
                own.append(x[1:])
            made += len(t.feature) - 1
        return grow.Trees(1, *(np.concatenate(x) for x in (feature, cut, left, value)))


def may_split(count: int, mass: list[int], level: int, rules: grow.ForestRules) -> bool:
    return int((np.array(mass) > 0).sum()) > 1 and count >= max(rules.min_split, 2 * rules.min_leaf) and level < rules.max_depth


def best_split(counts: np.ndarray, weight: np.ndarray, rules: grow.ForestRules) -> tuple[int, int, float]:
    """Column place, code and decrease of impurity of a node's best split, from
    ``columns x codes x (classes, rows)``; place -1 if none serves."""
    running = np.cumsum(counts, axis=1)
    n_left, every = running[:, :, K], running[:, -1:, K]
    ok = (counts[:, :, K] > 0) & (n_left >= max(1, rules.min_leaf)) & (every - n_left >= max(1, rules.min_leaf))
    left, total = running[:, :, :K] * weight, running[:, -1:, :K] * weight
    right = total - left
    gain = (left ** 2).sum(axis=2) / np.maximum(left.sum(axis=2), 1e-9) + (right ** 2).sum(axis=2) / np.maximum(right.sum(axis=2), 1e-9)
    if not ok.any():
        return -1, 0, 0.0
    at, code = divmod(int(np.where(ok, gain, -1.0).argmax()), counts.shape[1])
    own = total[0, 0]
    return at, code, float(gain[at, code] - (own ** 2).sum() / own.sum())


def stretches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The same rows, about ``rows`` at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def drawn(t: pa.Table, trees: list[int], seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Tree, rows and how often each is drawn, with Poisson weights of mean 1 as in one task."""
    key = t["key"].to_numpy().astype(np.int64).view(np.uint64)
    limits = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])
    for tree in trees:
        times = np.searchsorted(limits, grow.uniform(key, seed, tree), side="right")
        pick = np.flatnonzero(times)
        if len(pick):
            yield tree, pick, times[pick]


def _split_level(rows: DataFrame, width: int, tops: dict[int, Top], seed: int) -> None:
    """Splits the open nodes of the trees once, by one pass over all rows."""
    asked = {t: {node: top.columns(node) for node in sorted(top.open)} for t, top in tops.items() if top.open}
    rules, weight = next(iter(tops.values())).rules, next(iter(tops.values())).weight

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for t in stretches(batches, STRETCH):
            codes, y = cd.unpacked(t["codes"], width), t["outcome"].to_numpy()
            for tree, pick, times in drawn(t, list(asked), seed):
                nodes, columns = np.array(list(asked[tree])), np.stack(list(asked[tree].values()))
                number = np.full(len(tops[tree].feature), -1)
                number[nodes] = np.arange(len(nodes))
                own = number[tops[tree].places(codes[pick])]
                here = np.flatnonzero(own >= 0)
                own, at, times = own[here], pick[here], times[here]
                take, label = columns.shape[1], y[at]
                cell = (own[:, None] * take + np.arange(take)) * 256 + codes[at[:, None], columns[own]]
                size = len(nodes) * take * 256
                got = np.empty((size, K + 1), np.int64)
                got[:, :K] = np.bincount((cell * K + label[:, None]).ravel(), weights=np.repeat(times, take), minlength=size * K).reshape(size, K)
                got[:, K] = np.bincount(cell.ravel(), minlength=size)
                sums[tree] = sums[tree] + got if tree in sums else got
        for tree, got in sums.items():
            for node, x in zip(asked[tree], got.reshape(len(asked[tree]), -1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([node], pa.int32()), pa.array([x.tobytes()], pa.binary())],
                                                 names=["tree", "node", "counts"])

    def best(t: pa.Table) -> pa.Table:
        tree, node = t["tree"][0].as_py(), t["node"][0].as_py()
        counts = sum(np.frombuffer(x.as_py(), np.int64) for x in t["counts"]).reshape(-1, 256, K + 1)
        every = counts[0].sum(axis=0)
        fit = may_split(int(every[K]), every[:K], tops[tree].depth[node], rules)
        at, code, fall = best_split(counts, weight, rules) if fit else (-1, 0, 0.0)
        left = counts[at, :code + 1].sum(axis=0) if at >= 0 else every
        right = every - left
        out = {"node": node, "fit": fit, "feature": int(asked[tree][node][at]) if at >= 0 else -1, "cut": code, "fall": fall,
               "left_rows": int(left[K]), "right_rows": int(right[K]), "left_mass": left[:K].tolist(), "right_mass": right[:K].tolist()}
        return pa.table({"tree": pa.array([tree], pa.int32()), "split": pa.array([json.dumps(out)])})

    counts = rows.mapInArrow(count, "tree int, node int, counts binary")
    seen = set()
    for r in counts.groupBy("tree", "node").applyInArrow(best, "tree int, split string").collect():  # a row per open node
        found = json.loads(r["split"])
        tops[r["tree"]].split(found)
        seen.add((r["tree"], found["node"]))
    for tree, nodes in asked.items():  # nodes that drew no row stay leaves
        for node in nodes:
            if (tree, node) not in seen:
                del tops[tree].open[node]


def _grown_below(rows: DataFrame, width: int, tops: dict[int, Top], seed: int) -> DataFrame:
    """``tree, node, blob, importance`` of the hung nodes, each grown in a task of its own."""
    rules, weight = next(iter(tops.values())).rules, next(iter(tops.values())).weight

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stretches(batches, STRETCH):
            codes = cd.unpacked(t["codes"], width)
            for tree, pick, times in drawn(t, [x for x, top in tops.items() if top.hung], seed):
                hung = np.zeros(len(tops[tree].feature), bool)
                hung[list(tops[tree].hung)] = True
                node = tops[tree].places(codes[pick])
                here = np.flatnonzero(hung[node])
                at = pa.array(pick[here])
                yield from pa.table({"tree": pa.array(np.full(len(here), tree, np.int32)), "node": pa.array(node[here].astype(np.int32)),
                                     "key": t["key"].take(at), "outcome": t["outcome"].take(at), "codes": cd.packed(codes[pick[here]]),
                                     "times": pa.array(times[here].astype(np.int32))}).to_batches()

    def grown(t: pa.Table) -> pa.Table:
        tree, node = t["tree"][0].as_py(), t["node"][0].as_py()
        order = np.argsort(t["key"].to_numpy().view(np.uint64), kind="stable")
        x, y = cd.unpacked(t["codes"], width)[order], t["outcome"].to_numpy().astype(np.int64)[order]
        roots = (np.zeros(len(y), np.int64), np.arange(len(y)), t["times"].to_numpy().astype(np.int64)[order])
        made, fall = grow.forest_trees(x, y, np.zeros(len(y), np.uint64), weight, rules, [tree], seed * 1_000_003 + node, roots=roots,
                                       depth=tops[tree].depth[node])
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         "blob": pa.array([mb.to_bytes(mb.Forest([made]))], pa.binary()), "importance": pa.array([fall.tolist()], pa.list_(pa.float64()))})

    lines = rows.mapInArrow(draw, "tree int, node int, key long, outcome int, codes binary, times int")
    return lines.groupBy("tree", "node").applyInArrow(grown, "tree int, node int, blob binary, importance array<double>")


def forest_table(rows: DataFrame, width: int, p: mb.VoteParams, n: int, class_counts: dict[int, int], node_rows: int) -> str:
    """Path of a table ``part, blob, importance`` with a row per tree, each on a
    bootstrap of n of all ``n`` rows; ``importance`` is each column's share of the
    tree's decrease of impurity."""
    spark = rows.sparkSession
    ensure_package(spark)
    rows = rows.select("key", F.col("outcome").cast("int").alias("outcome"), "codes")
    weight = np.array([n / (len(class_counts) * class_counts[c]) if class_counts.get(c) else 0.0 for c in range(K)])
    path, side = scratch_path(spark, "forest"), max(1, int(LIVE_ROWS / max(1.0, 0.632 * n)))
    for lo in range(0, p.tree_n_estimators, side):
        tops = {t: Top(t, p, width, weight, n, node_rows) for t in range(lo, min(p.tree_n_estimators, lo + side))}
        with shuffles_freed(spark):
            while any(top.open for top in tops.values()):
                _split_level(rows, width, tops, p.seed)
            _whole_trees(_grown_below(rows, width, tops, p.seed), tops).write.mode("append").parquet(path)
    return path


def _whole_trees(below: DataFrame, tops: dict[int, Top]) -> DataFrame:
    """``part, blob, importance`` of each tree."""
    spark = below.sparkSession

    def joined(own: pa.Table, parts: pa.Table) -> pa.Table:
        top = tops[own["tree"][0].as_py()]
        grown = sorted(((r["node"], mb.from_bytes(r["blob"]).trees[0], r["importance"]) for r in parts.to_pylist()), key=lambda r: r[0])
        fall = top.fall + sum((np.array(x) for *_, x in grown), np.zeros(top.width))
        share = fall / fall.sum() if fall.sum() > 0 else fall
        return pa.table({"part": pa.array([top.tree], pa.int32()), "importance": pa.array([share.tolist()], pa.list_(pa.float64())),
                         "blob": pa.array([mb.to_bytes(mb.Forest([top.whole([r[:2] for r in grown])]))], pa.binary())})

    every = spark.createDataFrame([(t,) for t in tops], "tree int").groupBy("tree")  # a row per tree
    return every.cogroup(below.groupBy("tree")).applyInArrow(joined, "part int, importance array<double>, blob binary")


def fit_forest(rows: DataFrame, width: int, p: mb.VoteParams, n: int, class_counts: dict[int, int], node_rows: int) -> mb.Forest:
    """The trees of :func:`forest_table` in the driver's memory."""
    got = rows.sparkSession.read.parquet(forest_table(rows, width, p, n, class_counts, node_rows)).select("part", "blob").collect()
    return mb.joined([mb.from_bytes(bytes(r["blob"])) for r in sorted(got, key=lambda r: r["part"])])


def fit_members(rows: DataFrame, width: int, p: mb.VoteParams, n: int, class_counts: dict[int, int],
                node_rows: int) -> dict[str, mb.Member]:
    """The three members over ``key, outcome, codes`` in many tasks; the forest is a table."""
    fits = {"tree": lambda: mb.StoredForest(forest_table(rows, width, p, n, class_counts, node_rows)),
            "xgb": lambda: fit_softmax(rows, width, p), "cat": lambda: fit_symmetric(rows, width, p)}
    if n <= BOOSTER_ROWS:  # a booster is one task: the three fits share the cores
        with ThreadPoolExecutor(max_workers=len(fits)) as pool:
            return dict(zip(fits, pool.map(lambda fit: fit(), fits.values()), strict=True))
    return {m: fit() for m, fit in fits.items()}
