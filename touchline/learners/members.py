"""The three members of the vote: their parameters, fits and predictions.

A fitted member is a few arrays and travels as bytes, so fits can be rows of a
Spark table.  The fits here run in one task on rows it holds; ``large`` grows
the same boosters over rows in many tasks.
"""

from __future__ import annotations

import io
from dataclasses import asdict, dataclass, fields

import numpy as np

from touchline.learners import grow

CLASSES = 3
MEMBERS = ("tree", "xgb", "cat")

#: The published search ranges, whole numbers and reals.
INT_RANGES = {
    "tree_n_estimators": (50, 500), "tree_max_depth": (5, 50), "tree_min_samples_split": (2, 20),
    "tree_min_samples_leaf": (1, 5), "xgb_n_estimators": (50, 200), "xgb_max_depth": (3, 7),
    "cat_iterations": (100, 500), "cat_depth": (3, 8),
}
REAL_RANGES = {
    "xgb_learning_rate": (0.01, 0.2), "xgb_subsample": (0.7, 1.0), "xgb_colsample_bytree": (0.7, 1.0),
    "cat_learning_rate": (0.05, 0.1),
}


@dataclass(frozen=True)
class VoteParams:
    """One point of the published search space; the defaults are its middle."""
    tree_n_estimators: int = 275
    tree_max_depth: int = 27
    tree_min_samples_split: int = 11
    tree_min_samples_leaf: int = 3
    xgb_n_estimators: int = 125
    xgb_max_depth: int = 5
    xgb_learning_rate: float = 0.105
    xgb_subsample: float = 0.85
    xgb_colsample_bytree: float = 0.85
    cat_iterations: int = 300
    cat_depth: int = 5
    cat_learning_rate: float = 0.075
    seed: int = 42
    bins: int = grow.BINS  # codes that the boosters tell apart

    @staticmethod
    def of(row) -> VoteParams:
        """The parameters among the columns of a row or the keys of a dict."""
        have = row.asDict() if hasattr(row, "asDict") else row
        return VoteParams(**{f.name: have[f.name] for f in fields(VoteParams) if f.name in have})

    def plain(self) -> dict:
        return asdict(self)

    def forest(self) -> grow.ForestRules:
        return grow.ForestRules(self.tree_max_depth, self.tree_min_samples_split, self.tree_min_samples_leaf)

    def softmax(self) -> grow.SoftmaxRules:
        return grow.SoftmaxRules(self.xgb_max_depth, self.xgb_learning_rate, self.xgb_subsample, self.xgb_colsample_bytree,
                                 bins=self.bins)

    def symmetric(self) -> grow.SymmetricRules:
        return grow.SymmetricRules(self.cat_depth, self.cat_learning_rate, bins=self.bins)


def balanced(y: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class weights n / (classes present x n of the class)."""
    n = np.bincount(y, minlength=classes)
    return np.where(n > 0, len(y) / (np.maximum(n, 1) * max(1, np.count_nonzero(n))), 0.0)


# ---------------------------------------------------------------- fitted members
def stretches(x: np.ndarray) -> list[np.ndarray]:
    """Views of ``SCORED`` rows at most, about as many in each; one at least."""
    return np.array_split(x, max(1, -(-len(x) // SCORED)))


@dataclass
class Forest:
    trees: list[grow.Trees]

    def votes(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([sum(t.votes(x) for t in self.trees) for x in stretches(codes)])

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        votes = self.votes(codes)
        return votes / votes.sum(axis=1, keepdims=True)

    def arrays(self) -> dict:
        return {f"{name}{i}": getattr(t, name) for i, t in enumerate(self.trees)
                for name in ("trees", "feature", "cut", "left", "value")}


@dataclass
class Softmax:
    rounds: list[list[grow.Heap]]
    classes: int

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        margin = np.zeros((len(codes), self.classes))
        heaps = [(k, heap) for trees in self.rounds for k, heap in enumerate(trees)]
        sides = [heaps[lo:lo + grow.SIDE] for lo in range(0, len(heaps), grow.SIDE)]
        for x, own in zip(stretches(codes), stretches(margin), strict=True):
            columns = np.ascontiguousarray(x.T)
            for side in sides:
                if 2 <= len(side[0][1].value) <= 256:
                    leaves = grow.heap_leaves(columns, np.array([h.feature for _, h in side]), np.array([h.cut for _, h in side]))
                else:  # no split, or more leaves than a byte numbers
                    leaves = [h.leaf(x) for _, h in side]
                for (k, heap), leaf in zip(side, leaves, strict=True):
                    own[:, k] += heap.value.take(leaf)
        return grow.softmax(margin)

    def arrays(self) -> dict:
        return {"classes": self.classes, **{name: np.array([[getattr(t, name) for t in r] for r in self.rounds])
                                            for name in ("feature", "cut", "value")}}


@dataclass
class Symmetric:
    trees: list[grow.Symmetric]
    classes: int

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        margin = np.zeros((len(codes), self.classes))
        for x, own in zip(stretches(codes), stretches(margin), strict=True):
            columns = np.ascontiguousarray(x.T)
            for t in self.trees:
                own += t.value.take(t.leaf_of(columns), axis=0)
        return grow.softmax(margin)

    def arrays(self) -> dict:
        return {"classes": self.classes, **{name: np.array([getattr(t, name) for t in self.trees])
                                            for name in ("feature", "cut", "value")}}


@dataclass
class StoredForest:
    """A forest as a table ``part, blob`` with a row per tree: more nodes than a driver may hold."""
    path: str


Member = Forest | Softmax | Symmetric | StoredForest
SCORED = 10_000  # rows that are scored together, so that their codes stay in the cache


def to_bytes(m: Member) -> bytes:
    out = io.BytesIO()
    np.savez(out, kind=type(m).__name__, **m.arrays())
    return out.getvalue()


def from_bytes(blob: bytes) -> Member:
    with np.load(io.BytesIO(blob)) as z:
        a = {k: z[k] for k in z.files}
    if str(a["kind"]) == "Forest":
        parts = sum(k.startswith("trees") for k in a)
        return Forest([grow.Trees(int(a[f"trees{i}"]), a[f"feature{i}"], a[f"cut{i}"], a[f"left{i}"], a[f"value{i}"])
                       for i in range(parts)])
    k = int(a["classes"])
    if str(a["kind"]) == "Softmax":
        return Softmax([[grow.Heap(*x) for x in zip(*r, strict=True)] for r in zip(a["feature"], a["cut"], a["value"], strict=True)], k)
    return Symmetric([grow.Symmetric(*x) for x in zip(a["feature"], a["cut"], a["value"], strict=True)], k)


def joined(parts: list[Member]) -> Member:
    """One member from its parts (the parts of a forest)."""
    return Forest([t for p in parts for t in p.trees]) if isinstance(parts[0], Forest) else parts[0]


def vote(members: dict[str, Member], codes: np.ndarray) -> np.ndarray:
    """Equal-weight soft vote: the mean of the members' probabilities."""
    return sum(m.probabilities(codes) for m in members.values()) / len(members)


# ---------------------------------------------------------------- fits on rows of one task
FOREST_TREES = 16  # trees that grow side by side


def fit_forest(codes: np.ndarray, y: np.ndarray, key: np.ndarray, p: VoteParams, first: int = 0,
               upto: int | None = None) -> tuple[Forest, np.ndarray]:
    """Trees ``first`` to ``upto`` of the forest, and their summed importance."""
    weight, grown, importance = balanced(y), [], np.zeros(codes.shape[1])
    upto = p.tree_n_estimators if upto is None else upto
    for lo in range(first, upto, FOREST_TREES):
        t, imp = grow.forest_trees(codes, y, key, weight, p.forest(), list(range(lo, min(upto, lo + FOREST_TREES))), p.seed)
        grown.append(t)
        importance += imp
    return Forest(grown), importance


def fit_softmax(codes: np.ndarray, y: np.ndarray, key: np.ndarray, p: VoteParams) -> Softmax:
    margin, rounds = np.zeros((len(y), CLASSES)), []
    for turn in range(p.xgb_n_estimators):
        rounds.append(grow.softmax_round(codes, y, key, margin, p.softmax(), p.seed, turn))
    return Softmax(rounds, CLASSES)


def fit_symmetric(codes: np.ndarray, y: np.ndarray, key: np.ndarray, p: VoteParams) -> Symmetric:
    cell, block = grow.offset_cells(codes, p.bins), grow.random_block(key, p.seed)
    ordered, margin = np.zeros((len(y), CLASSES)), np.zeros((len(y), CLASSES))
    return Symmetric([grow.symmetric_round(codes, cell, block, y, ordered, margin, p.symmetric())
                      for _ in range(p.cat_iterations)], CLASSES)


def fit(member: str, codes: np.ndarray, y: np.ndarray, key: np.ndarray, p: VoteParams, first: int = 0,
        upto: int | None = None) -> Member:
    if member == "tree":
        return fit_forest(codes, y, key, p, first, upto)[0]
    return (fit_softmax if member == "xgb" else fit_symmetric)(codes, y, key, p)


def cost(member: str, p: VoteParams) -> float:
    """About how long a fit takes, to hand out the longest first."""
    if member == "tree":
        return 7.0 * p.tree_n_estimators
    if member == "xgb":
        return 3.0 * p.xgb_n_estimators * p.xgb_max_depth * p.xgb_colsample_bytree
    return p.cat_iterations * (1.0 * p.cat_depth + 0.05 * 2 ** p.cat_depth)
