"""Growing trees from byte codes: what a task does with the rows it holds.

Rows are ``codes`` (n x features, one byte each; a row goes left of a cut ``c``
if its code is at most ``c``), a class 0..K-1, and a 64-bit key that decides
every random choice about the row, so that results do not depend on how rows
are dealt out.  Gradients are rounded to whole numbers before they are summed:
sums are then exact and the same in any order.

Three kinds of trees, as in the published ensemble:

* ``forest_trees``: Gini trees on bootstrap weights, random features per node,
  grown fully or to ``max_depth`` / ``min_split`` / ``min_leaf``;
* ``softmax_round``: one tree per class on shared softmax gradients with
  second-order leaf weights, rows and columns drawn per tree;
* ``symmetric_round``: one oblivious tree (one split a level, a leaf is a
  string of bits) with a value per class; its structure is found on gradients
  from ordered predictions, where a row sees only rows of earlier blocks in a
  fixed random order of ``BLOCKS`` blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

U64 = np.uint64
BINS = 32  # codes of the boosters, unless said otherwise: the upper five bits of a byte
UNIT = 255  # a gradient of 1 as a whole number
BLOCKS = 64  # of the random order of rows
LEAVES = 8  # whose sums are looked at together, so that they stay in the cache


def mixed(x: np.ndarray, *seeds: int) -> np.ndarray:
    """64 random bits from a key and some seeds."""
    h = x.astype(U64)
    for s in (0, *seeds):
        h = h ^ (U64(s & 0xFFFFFFFF) + U64(0x9E3779B97F4A7C15))
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        h = h ^ (h >> U64(31))
    return h


def uniform(x: np.ndarray, *seeds: int) -> np.ndarray:
    return (mixed(x, *seeds) >> U64(11)).astype(np.float64) * 2.0 ** -53


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


class CellSums:
    """Sums of whole-number ``fields`` (one value per row of ``cell``) over the
    cells of all columns.  Fields that fit share one pass: a sum of doubles is
    exact up to 53 bits, and a field lies within half its room on either side."""

    def __init__(self, cell: np.ndarray, fields: list[np.ndarray], cells: int) -> None:
        rows, width = cell.shape
        flat = cell.ravel()
        spare = [int(np.abs(f).max(initial=0)).bit_length() + int(rows).bit_length() + 1 for f in fields]
        self.groups: list[tuple[np.ndarray, list[float]]] = []
        at = 0
        while at < len(fields):
            upto, bits = at + 1, spare[at]
            while upto < len(fields) and bits + spare[upto] <= 53:
                bits += spare[upto]
                upto += 1
            packed = fields[at].astype(np.float64)
            for i in range(at + 1, upto):
                packed = packed * 2.0 ** spare[i] + fields[i]
            total = np.bincount(flat, weights=np.repeat(packed, width), minlength=cells)
            self.groups.append((total, [2.0 ** spare[i] for i in range(at + 1, upto)]))
            at = upto

    def between(self, lo: int, hi: int, running: int | None = None) -> list[np.ndarray]:
        """The fields' sums in the cells ``lo`` to ``hi``; running sums over each column's codes, if their number is given."""
        out: list[np.ndarray] = []
        for total, rooms in self.groups:
            rest, got = total[lo:hi], []
            if running:
                rest = np.cumsum(rest.reshape(-1, running), axis=1).ravel()
            for room in reversed(rooms):
                high = np.rint(rest / room)
                got.append(rest - high * room)
                rest = high
            out += [rest, *reversed(got)]
        return out


def cell_sums(cell: np.ndarray, fields: list[np.ndarray], cells: int) -> list[np.ndarray]:
    return CellSums(cell, fields, cells).between(0, cells)


class ColumnPairs:
    """Sums of whole-number fields by node, column and coarse code over many
    rows: columns are summed two at a time, by both codes, in stretches of rows
    whose sums fit a double together."""

    STRETCH = 1 << 16

    def __init__(self, codes: np.ndarray, bins: int) -> None:
        self.rows, self.width = codes.shape
        self.bins = bins
        shift = 9 - bins.bit_length()
        self.pairs = np.zeros((-(-self.width // 2), self.rows), np.uint16)
        for j in range(self.width):
            self.pairs[j // 2] |= (codes[:, j] >> shift).astype(np.uint16) * np.uint16(1 if j % 2 else bins)

    def sums(self, pick: np.ndarray | None, place: np.ndarray, fields: list[np.ndarray], nodes: int) -> np.ndarray:
        """``fields x nodes x columns x codes`` of the rows ``pick`` (all, if
        none are given); ``place`` and ``fields`` are those rows'."""
        out = np.zeros((len(fields), nodes, 2 * len(self.pairs), self.bins))
        cells = self.bins * self.bins
        for lo in range(0, len(place), self.STRETCH):
            part = slice(lo, lo + self.STRETCH)
            at, own = place[part] * cells, [f[part] for f in fields]
            spare = [int(np.abs(f).max(initial=0)).bit_length() + len(at).bit_length() + 1 for f in own]
            first = 0
            while first < len(own):
                upto, bits = first + 1, spare[first]
                packed = own[first].astype(np.float64)
                while upto < len(own) and bits + spare[upto] <= 53:
                    packed = packed * 2.0 ** spare[upto] + own[upto]
                    bits += spare[upto]
                    upto += 1
                total = np.empty((len(self.pairs), 2, nodes, self.bins))
                for j, pair in enumerate(self.pairs):
                    code = pair[part] if pick is None else pair.take(pick[part])
                    both = np.bincount(at + code, weights=packed, minlength=nodes * cells).reshape(nodes, self.bins, self.bins)
                    total[j] = both.sum(axis=2), both.sum(axis=1)
                rest = total.reshape(-1, nodes, self.bins).transpose(1, 0, 2)
                for i in range(upto - 1, first, -1):
                    high = np.rint(rest / 2.0 ** spare[i])
                    out[i] += rest - high * 2.0 ** spare[i]
                    rest = high
                out[first] += rest
                first = upto
        return out[:, :, :self.width]


# ---------------------------------------------------------------- forest
@dataclass
class Trees:
    """Nodes of some trees, one after another.  ``feature`` is -1 at a leaf;
    the children of a node are ``left`` and ``left + 1``; the first
    ``trees`` nodes are the roots."""
    trees: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @cached_property
    def walk(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Nodes laid out tree by tree for scoring: a number per node (a leaf is
        its own child), its values, and the place of each root."""
        inner = self.feature >= 0
        tree = np.zeros(len(self.feature), np.int64)
        at = np.arange(self.trees)
        tree[at] = at
        while len(at := at[inner[at]]):
            child = np.concatenate([self.left[at], self.left[at] + 1])
            tree[child] = np.tile(tree[at], 2)
            at = child
        order = np.argsort(tree, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        packed = np.arange(len(order)) << 8
        packed[place[inner]] = packed_nodes(self.feature[inner], self.cut[inner], place[self.left[inner]])
        return packed, self.value[order], place[:self.trees].tolist()

    @cached_property
    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``TOP`` levels of each tree as a heap (trees x nodes): features,
        cuts, and the places in ``walk`` below them.  All rows of an early leaf pass
        to the left, where it stands again."""
        packed, _, roots = self.walk
        at, feature, cut = np.array(roots, np.int64)[:, None], [], []
        for _ in range(TOP):
            p = packed[at]
            leaf = p == at << 8
            feature.append(np.where(leaf, 0, p >> 40))
            cut.append(np.where(leaf, 255, 255 - (p & 255)).astype(np.uint8))
            left = (p >> 8) & 0xFFFFFFFF
            at = np.stack([left, np.where(leaf, at, left + 1)], axis=2).reshape(len(at), 2 * at.shape[1])
        return np.concatenate(feature, axis=1), np.concatenate(cut, axis=1), at

    def votes(self, codes: np.ndarray) -> np.ndarray:
        """Sum over the trees of the class shares in each row's leaf."""
        packed, value, _ = self.walk
        feature, cut, entry = self.top
        n, width = codes.shape
        flat, base = np.ascontiguousarray(codes).ravel(), np.arange(n) * width
        columns = np.ascontiguousarray(codes.T)
        out = np.zeros((n, value.shape[1]))
        for lo in range(0, self.trees, SIDE):
            some = slice(lo, lo + SIDE)
            for place, leaf in zip(entry[some], heap_leaves(columns, feature[some], cut[some]), strict=True):
                node, rows, first = place.take(leaf), None, base
                at = node
                while len(go := np.flatnonzero(packed.take(at) != at << 8)):  # the others are in leaves
                    rows = go if rows is None else rows.take(go)
                    first, at = first.take(go), at.take(go)
                    for _ in range(3):
                        at = below(packed, flat, first, at)
                    node[rows] = at
                out += value.take(node, axis=0)
        return out


TOP = 6  # levels of a tree that are compared as whole columns
SIDE = 16  # trees that are compared side by side


def heap_leaves(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Leaves (trees x rows) of trees of one depth, 1 to 8, given as heaps (trees
    x nodes).  ``columns`` are codes, column by column.  Every node is compared for
    all rows at once, and the leaf below it is picked by the result: no row is
    followed on its own."""
    levels, cut = int(feature.shape[1]).bit_length(), cut.astype(np.uint8)

    def leaves(node: int, level: int) -> np.ndarray:
        over = (columns[feature[:, node]] > cut[:, node, None]).view(np.uint8)
        if level == levels - 1:
            return over
        left, right = leaves(2 * node + 1, level + 1), leaves(2 * node + 2, level + 1)
        right |= 1 << (levels - 1 - level)
        right ^= left
        right &= np.negative(over, out=over)  # all bits where the code is above the cut
        left ^= right
        return left

    return leaves(0, 0)


def packed_nodes(feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A number per node: its feature, its left child, and what a code above
    its cut carries over into that child's number."""
    return (feature.astype(np.int64) << 40) | (left.astype(np.int64) << 8) | (255 - cut)


def below(packed: np.ndarray, flat: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The children that rows of the nodes ``at`` go to; ``first`` is where a
    row's codes begin.  A leaf is its own child."""
    p = packed.take(at, mode="wrap")
    f = p >> 40
    f += first
    p += flat.take(f, mode="wrap")
    p >>= 8
    p &= 0xFFFFFFFF
    return p


@dataclass(frozen=True)
class ForestRules:
    max_depth: int = 50
    min_split: int = 2
    min_leaf: int = 1
    tries: int = 4  # draws of features for a node before it is left as it is


def forest_trees(codes: np.ndarray, y: np.ndarray, key: np.ndarray, class_weight: np.ndarray, rules: ForestRules,
                 trees: list[int], seed: int, roots: np.ndarray | None = None, depth: int = 0) -> tuple[Trees, np.ndarray]:
    """The named trees, and the importance (summed decrease of impurity, a
    share of each tree's total) of each feature.

    ``roots``, if given, holds the rows to go on with per tree, each with its
    bootstrap weight (tree place, row, weight): a subtree below ``depth``."""
    n, width = codes.shape
    classes = len(class_weight)
    bits = (classes - 1).bit_length()
    if 7 * n >= 1 << 21 or classes > 3:
        raise ValueError("a task grows trees of at most 299,000 rows and three classes")
    take = max(1, int(np.sqrt(width)))
    if roots is None:
        limits = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])  # Poisson with mean 1, at most 7
        drawn = [np.searchsorted(limits, uniform(key, seed, t), side="right") for t in trees]
        tree = np.concatenate([np.full(np.count_nonzero(c), i) for i, c in enumerate(drawn)])
        row = np.concatenate([np.flatnonzero(c) for c in drawn])
        times = np.concatenate([c[c > 0] for c in drawn])
    else:
        tree, row, times = roots
    rng = np.random.default_rng([seed, *trees[:1], depth])
    order = np.stack([rng.permutation(width) for _ in trees])
    steps = np.array([s for s in range(1, max(2, width)) if np.gcd(s, width) == 1])
    feature, cut, left, value = [], [], [], []
    importance = np.zeros((len(trees), width))
    node = tree.astype(np.int64)  # place of a row's node in the frontier
    of_tree = np.arange(len(trees))  # tree of each frontier node
    tried = np.zeros(len(trees), np.int64)
    slots = np.arange(len(trees))  # number of each frontier node
    made = len(trees)
    feature.append(np.full(made, -1, np.int32))
    cut.append(np.zeros(made, np.int32))
    left.append(np.zeros(made, np.int32))
    value.append(_shares(node, y[row], times, class_weight, made))
    levels = np.full(len(trees), depth)
    feature_, cut_, left_ = (np.concatenate(x) for x in (feature, cut, left))
    while len(row):
        front = len(of_tree)
        count = np.bincount(node, minlength=front)
        mass = np.bincount(node * classes + y[row], weights=times, minlength=front * classes).reshape(front, classes)
        split = ((mass > 0).sum(axis=1) > 1) & (count >= rules.min_split) & (count >= 2 * rules.min_leaf) \
            & (levels < rules.max_depth) & (tried < rules.tries)
        keep = split[node]
        if not keep.any():
            break
        row, times = row[keep], times[keep]
        place = np.cumsum(split) - 1
        node = place[node[keep]]
        of_tree, tried, slots, levels, mass, count = (a[split] for a in (of_tree, tried, slots, levels, mass, count))
        front = len(of_tree)
        # random features of each node: an arithmetic walk through its tree's random order
        start, step = rng.integers(0, width, front), steps[rng.integers(0, len(steps), front)]
        feats = order[of_tree[:, None], (start[:, None] + step[:, None] * np.arange(take)) % width]
        wide = np.int32 if front * take << (8 + bits + 3) < 2**31 else np.int64
        packed = ((node * take).astype(wide)[:, None] + np.arange(take, dtype=wide)) << (8 + bits + 3)
        packed |= codes[row[:, None], feats[node]].astype(wide) << (bits + 3)
        packed |= ((y[row] << 3) | times).astype(wide)[:, None]
        packed = packed.ravel()
        packed.sort()
        at = packed >> (bits + 3)  # (node, feature, code)
        ends = np.flatnonzero(at[1:] != at[:-1])  # last row of each code; the last of a feature is no cut
        pair = at[ends] >> 8
        inner = pair == at[ends + 1] >> 8
        ends, pair = ends[inner], pair[inner]
        own = pair // take
        first = np.concatenate([[0], np.cumsum(np.repeat(count, take))])[pair]
        n_left = ends + 1 - first
        # running weights of all classes in one number; a difference within a node fits its 21 bits
        running = np.cumsum((packed & 7).astype(np.int64) << (21 * ((packed >> 3) & ((1 << bits) - 1)).astype(np.int64)))
        within = running[ends] - np.where(first > 0, running[first - 1], 0)
        total = mass * class_weight
        l_all, l_sq, r_sq = 0.0, 0.0, 0.0
        for k in range(classes):
            lk = ((within >> (21 * k)) & 0x1FFFFF) * class_weight[k]
            rk = total[own, k] - lk
            l_all, l_sq, r_sq = l_all + lk, l_sq + lk * lk, r_sq + rk * rk
        ok = (n_left >= rules.min_leaf) & (count[own] - n_left >= rules.min_leaf)
        gain = np.where(ok, l_sq / l_all + r_sq / np.maximum(total.sum(axis=1)[own] - l_all, 1e-9), -1.0)
        best = np.full(front, -1.0)
        np.maximum.at(best, own, gain)
        hit = np.flatnonzero((gain == best[own]) & ok)[::-1]
        chosen = np.full(front, -1, np.int64)
        chosen[own[hit]] = hit  # the first of the best
        found = chosen >= 0
        tried = tried + 1
        pick = chosen[found]
        f = feats[own[pick], ((at[ends[pick]] >> 8) % take)]
        c = (at[ends[pick]] & 255).astype(np.int32)
        number = slots[found]
        child = made + 2 * np.arange(len(pick))
        made += 2 * len(pick)
        feature_[number], cut_[number], left_[number] = f, c, child
        fall = gain[pick] - (total[found] ** 2).sum(axis=1) / total[found].sum(axis=1)
        np.add.at(importance, (of_tree[found], f), fall)
        # rows of split nodes go to the children, others stay for another draw
        place = np.full(front, -1, np.int64)
        place[found] = np.arange(len(pick))
        stay = np.flatnonzero(~found)
        place_stay = np.full(front, -1, np.int64)
        place_stay[stay] = 2 * len(pick) + np.arange(len(stay))
        mine = place[node]
        goes = mine >= 0
        side = np.zeros(len(row), np.int64)
        side[goes] = codes[row[goes], f[mine[goes]]] > c[mine[goes]]
        node = np.where(goes, 2 * mine + side, place_stay[node])
        new_value = _shares(node[goes], y[row[goes]], times[goes], class_weight, 2 * len(pick))
        value.append(new_value)
        feature_ = np.concatenate([feature_, np.full(2 * len(pick), -1, np.int32)])
        cut_ = np.concatenate([cut_, np.zeros(2 * len(pick), np.int32)])
        left_ = np.concatenate([left_, np.zeros(2 * len(pick), np.int32)])
        of_tree = np.concatenate([np.repeat(of_tree[found], 2), of_tree[stay]])
        slots = np.concatenate([(child[:, None] + np.arange(2)).ravel(), slots[stay]])
        levels = np.concatenate([np.repeat(levels[found] + 1, 2), levels[stay]])
        tried = np.concatenate([np.zeros(2 * len(pick), np.int64), tried[stay]])
    whole_trees = importance.sum(axis=1, keepdims=True)
    share = importance if roots is not None else importance / np.where(whole_trees > 0, whole_trees, 1.0)
    return Trees(len(trees), feature_, cut_, left_, np.concatenate(value).astype(np.float32)), share.sum(axis=0)


def _shares(node: np.ndarray, y: np.ndarray, times: np.ndarray, class_weight: np.ndarray, nodes: int) -> np.ndarray:
    k = len(class_weight)
    m = np.bincount(node * k + y, weights=times * class_weight[y], minlength=nodes * k).reshape(nodes, k)
    total = m.sum(axis=1, keepdims=True)
    return np.where(total > 0, m / np.where(total > 0, total, 1.0), 1.0 / k)


# ---------------------------------------------------------------- softmax boosting
@dataclass(frozen=True)
class SoftmaxRules:
    depth: int = 5
    rate: float = 0.1
    row_share: float = 1.0
    column_share: float = 1.0
    ridge: float = 1.0
    min_weight: float = 1.0  # least sum of second derivatives on either side of a split
    bins: int = BINS


@dataclass
class Heap:
    """One tree of a fixed depth as a heap: node i has the children 2i + 1 and
    2i + 2.  An early leaf lets every row pass to the left."""
    feature: np.ndarray  # 2^depth - 1
    cut: np.ndarray
    value: np.ndarray  # 2^depth

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        n, width = codes.shape
        flat, base = np.ascontiguousarray(codes).ravel(), np.arange(n) * width
        packed = packed_nodes(self.feature, self.cut, 2 * np.arange(len(self.feature)) + 1)
        node = np.zeros(n, np.int64)
        for _ in range(int(len(self.value)).bit_length() - 1):
            node = below(packed, flat, base, node)
        return node - (len(self.value) - 1)


def softmax_gradients(margin: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of class ``k``, as whole numbers."""
    p = softmax(margin)[:, k]
    return whole(p - (y == k)), np.maximum(whole(2.0 * p * (1.0 - p)), 1)


def drawn_rows(key: np.ndarray, rules: SoftmaxRules, seed: int, turn: int, k: int) -> np.ndarray:
    return np.flatnonzero(uniform(key, seed, turn, k) < rules.row_share) if rules.row_share < 1 else np.arange(len(key))


def drawn_columns(width: int, rules: SoftmaxRules, seed: int, turn: int, k: int) -> np.ndarray:
    take = max(1, int(rules.column_share * width))
    order = np.argsort(mixed(np.arange(width, dtype=U64), seed, turn, k, 7), kind="stable")
    return np.sort(order[:take])


def best_softmax_splits(g: np.ndarray, h: np.ndarray, rules: SoftmaxRules) -> tuple[np.ndarray, np.ndarray]:
    """Per node the best (column, code), flat over columns x codes, and its
    gain; ``g, h`` are sums by node, column and code."""
    gl, hl = np.cumsum(g.astype(np.float32), axis=2), np.cumsum(h.astype(np.float32), axis=2)
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
    gr, hr = gt - gl, ht - hl
    lam, least = np.float32(rules.ridge * UNIT), np.float32(rules.min_weight * UNIT)
    gain = gl * gl / (hl + lam) + gr * gr / (hr + lam)
    gain = np.where((hl >= least) & (hr >= least), gain, np.float32(-np.inf)).reshape(len(g), -1)
    best = gain.argmax(axis=1)
    rows = np.arange(len(g))
    return best, (gain[rows, best] - gt[:, 0, 0] ** 2 / (ht[:, 0, 0] + lam)) / np.float32(UNIT)


class SoftmaxTree:
    """One tree of a round, grown level by level.  ``level_sums`` needs the
    rows, which may lie in many tasks; ``split`` only what their sums say."""

    def __init__(self, columns: np.ndarray, rules: SoftmaxRules) -> None:
        self.columns, self.rules = columns, rules
        inner = (1 << rules.depth) - 1
        self.heap = Heap(np.zeros(inner, np.int32), np.full(inner, 255, np.int32), np.zeros(1 << rules.depth))
        self.level = 0
        self.open = np.ones(1, bool)  # nodes of the level that may still be split

    def level_sums(self, cell: np.ndarray, place: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``cell`` is the coarse code of each drawn row and column plus the
        column's offset, ``place`` each row's node within the level."""
        nodes, per = 1 << self.level, cell.shape[1] * self.rules.bins
        got = cell_sums(cell + (place * per)[:, None], [g, h], nodes * per)
        return tuple(x.reshape(nodes, cell.shape[1], self.rules.bins) for x in got)

    def split(self, best: np.ndarray, gain: np.ndarray) -> None:
        """Goes a level down by the best splits of its nodes and their gains."""
        good = self.open & (gain > 1e-6)
        at = (1 << self.level) - 1 + np.flatnonzero(good)
        self.heap.feature[at] = self.columns[best[good] // self.rules.bins]
        self.heap.cut[at] = byte_cut(best[good] % self.rules.bins, self.rules.bins)
        self.open = np.stack([good, good], axis=1).ravel()
        self.level += 1

    def set_leaves(self, g: np.ndarray, h: np.ndarray) -> Heap:
        """Leaf values from the sums of the drawn rows in each leaf."""
        self.heap.value = -self.rules.rate * g / (h + self.rules.ridge * UNIT)
        return self.heap


def offset_cells(codes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Coarse codes (``bins`` of them, a power of two), each column's shifted to a range of its own."""
    return np.ascontiguousarray(codes >> (9 - bins.bit_length())).astype(np.int64) + bins * np.arange(codes.shape[1])


def byte_cut(code, bins: int):
    """A cut between coarse codes as a byte code."""
    return (code + 1) * (256 // bins) - 1


def softmax_round(codes: np.ndarray, y: np.ndarray, key: np.ndarray, margin: np.ndarray, rules: SoftmaxRules,
                  seed: int, turn: int) -> list[Heap]:
    """One tree per class; adds their values to ``margin``."""
    grown = []
    gradients = [softmax_gradients(margin, y, k) for k in range(margin.shape[1])]
    for k, (g, h) in enumerate(gradients):
        rows = drawn_rows(key, rules, seed, turn, k)
        tree = SoftmaxTree(drawn_columns(codes.shape[1], rules, seed, turn, k), rules)
        mine, every = codes[rows], np.arange(len(rows))
        cell, place, gk, hk = offset_cells(mine[:, tree.columns], rules.bins), np.zeros(len(rows), np.int64), g[rows], h[rows]
        per = cell.shape[1] * rules.bins
        for level in range(rules.depth):
            best, gain = np.zeros(1 << level, np.int64), np.full(1 << level, -np.inf)
            live = every if tree.open.all() else np.flatnonzero(tree.open[place])  # rows of nodes that may still be split
            if len(live):
                nodes, at = np.unique(place[live], return_inverse=True)
                sums = cell_sums(cell[live] + (at * per)[:, None], [gk[live], hk[live]], len(nodes) * per)
                best[nodes], gain[nodes] = best_softmax_splits(
                    *(x.reshape(len(nodes), -1, rules.bins) for x in sums), rules)
            tree.split(best, gain)
            at = (1 << level) - 1 + place
            place = 2 * place + (mine[every, tree.heap.feature[at]] > tree.heap.cut[at])
        n = 1 << rules.depth
        grown.append(tree.set_leaves(np.bincount(place, weights=gk, minlength=n), np.bincount(place, weights=hk, minlength=n)))
    for k, heap in enumerate(grown):
        margin[:, k] += heap.value[heap.leaf(codes)]
    return grown


# ---------------------------------------------------------------- symmetric trees
@dataclass(frozen=True)
class SymmetricRules:
    depth: int = 6
    rate: float = 0.08
    ridge: float = 3.0
    bins: int = BINS


@dataclass
class Symmetric:
    """An oblivious tree: the i-th split gives the i-th bit of a leaf's number."""
    feature: np.ndarray  # depth
    cut: np.ndarray
    value: np.ndarray  # 2^depth x classes

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        return self.leaf_of(codes.T)

    def leaf_of(self, columns: np.ndarray) -> np.ndarray:
        """Leaves of the rows of a matrix of codes that is given column by column."""
        out = np.zeros(columns.shape[1], np.int64)
        for f, c in zip(self.feature.tolist(), self.cut.tolist(), strict=True):
            out += out
            out += columns[f] > c
        return out


def residuals(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Negative gradients and second derivatives of all classes, as whole numbers."""
    p = softmax(margin)
    r = whole((y[:, None] == np.arange(margin.shape[1])) - p)
    r[:, -1] = -r[:, :-1].sum(axis=1)  # they add up to nothing
    return r, whole(p * (1.0 - p))


def symmetric_scores(left: list[np.ndarray], rules: SymmetricRules) -> np.ndarray:
    """How well each split (column x code) serves all leaves: the squared
    residual sums of all classes over the counts, on both sides.  ``left`` are
    running sums over the codes, by leaf and column: of the classes' residuals
    but the last (they add up to nothing), then of counts."""
    lam = np.float32(rules.ridge)
    *r, n = (x.astype(np.float32) for x in left)
    dl, dr = 1 / (n + lam), 1 / (n[:, :, -1:] - n + lam)
    total = [x[:, :, -1:] for x in r]
    last = sum(total)
    s, quad, lin, whole_quad = np.zeros_like(n), np.zeros_like(n), np.zeros_like(n), last * last
    for x, t in zip(r, total, strict=True):  # left^2 dl + (total - left)^2 dr, summed over the classes
        s += x
        quad += x * x
        lin += x * (2 * (t + last))
        whole_quad = whole_quad + t * t
    s *= s
    quad += s
    dl += dr
    quad *= dl
    lin -= whole_quad
    lin *= dr
    quad -= lin
    return quad.sum(axis=0, dtype=np.float64)[:, :-1]


def split_at(score: np.ndarray) -> tuple[int, int]:
    """The best column and its cut as a byte code; ties to the first."""
    column, code = divmod(int(score.argmax()), score.shape[1])
    return column, byte_cut(code, score.shape[1] + 1)


def random_block(key: np.ndarray, seed: int) -> np.ndarray:
    """Each row's block in the fixed random order."""
    return (mixed(key, seed, 99) >> U64(64 - (BLOCKS - 1).bit_length())).astype(np.int64)


def block_sums(leaf: np.ndarray, block: np.ndarray, r: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Sums of ``r`` and ``h`` by leaf and block: 2 x classes x leaves x blocks."""
    at, n = leaf * BLOCKS + block, leaves * BLOCKS
    return np.array([[np.bincount(at, weights=x[:, k], minlength=n).reshape(leaves, BLOCKS) for k in range(x.shape[1])]
                     for x in (r, h)])


def earlier(sums: np.ndarray) -> np.ndarray:
    """Sums over the blocks before each."""
    return np.cumsum(sums, axis=-1) - sums


def ordered_gain(leaf: np.ndarray, block: np.ndarray, before: np.ndarray, rules: SymmetricRules) -> np.ndarray:
    """What each row's leaf gives it if only rows of earlier blocks count."""
    got = before[:, :, leaf, block]
    return (rules.rate * got[0] / (got[1] + rules.ridge * UNIT)).T


def leaf_values(r: np.ndarray, h: np.ndarray, rules: SymmetricRules) -> np.ndarray:
    """Leaf values from sums by leaf and class."""
    return rules.rate * r / (h + rules.ridge * UNIT)


def symmetric_round(codes: np.ndarray, cell: np.ndarray, block: np.ndarray, y: np.ndarray, ordered: np.ndarray,
                    margin: np.ndarray, rules: SymmetricRules) -> Symmetric:
    """One tree; adds its values to ``margin`` and what earlier rows say to ``ordered``."""
    r, h = residuals(ordered, y)
    width, classes = codes.shape[1], margin.shape[1]
    fields = [r[:, k] for k in range(classes - 1)] + [np.ones(len(codes), np.int64)]
    leaf, per = np.zeros(len(codes), np.int64), width * rules.bins
    feature, cut = [], []
    for _ in range(rules.depth):
        rows = np.flatnonzero(np.bincount(leaf)[leaf] > 1)  # a leaf of one row or none has no say
        there, place = np.unique(leaf[rows], return_inverse=True)
        part = (cell, fields) if len(rows) == len(leaf) else (cell[rows], [x[rows] for x in fields])
        sums = CellSums(part[0] + (place * per)[:, None], part[1], per * len(there))
        score = np.zeros((width, rules.bins - 1))
        for lo in range(0, len(there), LEAVES):
            hi = min(len(there), lo + LEAVES)
            score += symmetric_scores([x.reshape(hi - lo, width, rules.bins) for x in sums.between(lo * per, hi * per, rules.bins)], rules)
        f, c = split_at(score)
        feature.append(f)
        cut.append(c)
        leaf = 2 * leaf + (codes[:, f] > c)
    pr, ph = residuals(margin, y)
    n = 1 << rules.depth
    value = leaf_values(*(np.stack([np.bincount(leaf, weights=x[:, k], minlength=n) for k in range(classes)], axis=1)
                          for x in (pr, ph)), rules)
    tree = Symmetric(np.array(feature, np.int32), np.array(cut, np.int32), value)
    ordered += ordered_gain(leaf, block, earlier(block_sums(leaf, block, r, h, n)), rules)
    margin += tree.value[leaf]
    return tree
