"""Tree learners against plain ones, rows in many tasks against rows in one, and the search."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.learners import codes as cd
from touchline.learners import grow, large, tpe
from touchline.learners import members as mb
from touchline.learners import search as se


def data(n=400, width=6, seed=0, levels=256):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, (n, width)).astype(np.uint8)
    z = x[:, 0] / 64.0 + (x[:, 1] > 100) * (x[:, 2] / 100.0) + rng.normal(0, 0.7, n)
    y = np.digitize(z, np.quantile(z, [0.45, 0.7]))
    return x, y, rng.integers(0, 2**63, n).astype(np.uint64)


def log_loss(p, y):
    return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())


# ---------------------------------------------------------------- forest
def plain_tree(x, y, w, min_split, min_leaf, depth):
    """Class shares of each row's leaf in a Gini tree on all features; rows carry weights."""
    out = np.zeros((len(y), 3))

    def grow_(rows, left):
        mass = np.array([w[rows][y[rows] == k].sum() for k in range(3)])
        best = None
        if (mass > 0).sum() > 1 and len(rows) >= min_split and left:
            for f in range(x.shape[1]):
                for c in np.unique(x[rows, f])[:-1]:
                    a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if min(len(a), len(b)) < min_leaf:
                        continue
                    g = sum((np.array([w[s][y[s] == k].sum() for k in range(3)]) ** 2).sum() / w[s].sum() for s in (a, b))
                    if best is None or g > best[0] + 1e-9:
                        best = (g, a, b)
        if best is None:
            out[rows] = mass / mass.sum()
        else:
            grow_(best[1], left - 1)
            grow_(best[2], left - 1)
    grow_(np.arange(len(y)), depth)
    return out


@pytest.mark.parametrize("rules", [grow.ForestRules(), grow.ForestRules(4), grow.ForestRules(50, 30, 1), grow.ForestRules(50, 2, 9)])
def test_forest_tree_equals_a_plain_one(monkeypatch, rules):
    """With all features at every node, the tree is the best Gini tree of its bootstrap."""
    x, y, key = data(150, 3, levels=40)
    monkeypatch.setattr(np, "sqrt", lambda v: v if isinstance(v, int) else v ** 0.5)  # all features, not their root
    weight = mb.balanced(y)
    t, imp = grow.forest_trees(x, y, key, weight, rules, [5], 42)
    monkeypatch.undo()
    limits = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])
    times = np.searchsorted(limits, grow.uniform(key, 42, 5), side="right")
    rows = np.flatnonzero(times)
    want = plain_tree(x[rows], y[rows], times[rows] * weight[y[rows]], rules.min_split, rules.min_leaf, rules.max_depth)
    gini = lambda p: (p ** 2).sum(axis=1).mean()
    assert gini(t.votes(x[rows])) == pytest.approx(gini(want), abs=0.02)
    if rules == grow.ForestRules():  # fully grown: every leaf is pure unless its rows are alike
        assert np.allclose(t.votes(x[rows]), want, atol=1e-6)
    assert imp.sum() == pytest.approx(1.0)


def test_forest_respects_its_rules():
    x, y, key = data(500, 9)
    for rules in (grow.ForestRules(3), grow.ForestRules(50, 2, 7), grow.ForestRules(50, 60, 1)):
        t, _ = grow.forest_trees(x, y, key, np.ones(3), rules, [0, 1, 2], 1)
        limits = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])
        for i in range(3):
            bag = np.flatnonzero(np.searchsorted(limits, grow.uniform(key, 1, i), side="right"))
            node, depth = np.full(len(bag), i), np.zeros(len(bag), int)
            while (inner := t.feature[node] >= 0).any():
                sizes = np.bincount(node[inner], minlength=len(t.feature))
                assert sizes[sizes > 0].min() >= rules.min_split
                step = t.left[node] + (x[bag, np.maximum(t.feature[node], 0)] > t.cut[node])
                node, depth = np.where(inner, step, node), depth + inner
            assert depth.max() <= rules.max_depth and np.bincount(node)[np.unique(node)].min() >= rules.min_leaf


# ---------------------------------------------------------------- softmax boosting
def plain_softmax(x, y, depth, rate, rounds, lam=1.0, least=1.0):
    """A booster in exact numbers: margins after ``rounds``."""
    m = np.zeros((len(y), 3))
    coarse = x >> 3
    for _ in range(rounds):
        p = np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        step = np.zeros_like(m)
        for k in range(3):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])

            def node(rows, left, g=g, h=h, k=k):
                G, H = g[rows].sum(), h[rows].sum()
                best = (1e-6, None)
                if left:
                    for f in range(x.shape[1]):
                        for c in np.unique(coarse[rows, f])[:-1]:
                            a = rows[coarse[rows, f] <= c]
                            ga, ha = g[a].sum(), h[a].sum()
                            if ha < least or H - ha < least:
                                continue
                            gain = ga**2 / (ha + lam) + (G - ga) ** 2 / (H - ha + lam) - G**2 / (H + lam)
                            if gain > best[0]:
                                best = (gain, (f, c))
                if best[1] is None:
                    step[rows, k] = -rate * G / (H + lam)
                    return
                f, c = best[1]
                node(rows[coarse[rows, f] <= c], left - 1)
                node(rows[coarse[rows, f] > c], left - 1)
            node(np.arange(len(y)), depth)
        m += step
    return m


@pytest.mark.parametrize("unit, apart", [(1 << 18, 1e-3), (grow.UNIT, None)])
def test_softmax_booster_equals_a_plain_one(monkeypatch, unit, apart):
    """With fine rounding margin by margin; with the usual one, whose ties may fall otherwise, in loss."""
    monkeypatch.setattr(grow, "UNIT", unit)
    x, y, key = data(300, 4)
    m = np.zeros((300, 3))
    rules = grow.SoftmaxRules(depth=3, rate=0.3)
    for turn in range(4):
        grow.softmax_round(x, y, key, m, rules, 1, turn)
    want = plain_softmax(x, y, 3, 0.3, 4)
    assert apart is None or np.abs(m - want).max() < apart
    assert log_loss(grow.softmax(m), y) == pytest.approx(log_loss(grow.softmax(want), y), abs=0.003)


# ---------------------------------------------------------------- symmetric trees
def test_symmetric_booster_equals_a_plain_one(monkeypatch):
    monkeypatch.setattr(grow, "UNIT", 1 << 16)
    x, y, key = data(300, 4)
    rules = grow.SymmetricRules(depth=3, rate=0.3)
    cell, block = grow.offset_cells(x), grow.random_block(key, 1)
    ordered, margin = np.zeros((300, 3)), np.zeros((300, 3))
    want_o, want_m = np.zeros((300, 3)), np.zeros((300, 3))
    for _ in range(3):
        tree = grow.symmetric_round(x, cell, block, y, ordered, margin, rules)
        sm = lambda m: np.exp(m) / np.exp(m).sum(axis=1, keepdims=True)
        hot = np.eye(3)[y]
        po, pm = sm(want_o), sm(want_m)
        # the splits, one level after another, by the plain score
        leaf = np.zeros(300, int)
        for level in range(3):
            score = {}
            for f in range(4):
                for c in range(31):
                    side = (x[:, f] >> 3) > c
                    total = 0.0
                    for part in range(2 ** level):
                        for s in (False, True):
                            rows = (leaf == part) & (side == s)
                            total += ((hot - po)[rows].sum(axis=0) ** 2).sum() / (rows.sum() + rules.ridge)
                    score[f, c] = total
            best = max(score.values())
            got = int(tree.feature[level]), int(tree.cut[level]) >> 3
            assert score[got] >= (1 - 1e-5) * best
            leaf = 2 * leaf + ((x[:, got[0]] >> 3) > got[1])
        assert (leaf == tree.leaf(x)).all()
        for part in range(8):
            rows = leaf == part
            if rows.any():
                want_m[rows] += 0.3 * (hot - pm)[rows].sum(axis=0) / ((pm * (1 - pm))[rows].sum(axis=0) + 3)
        gain = np.zeros((300, 3))
        for i in range(300):
            before = (leaf == leaf[i]) & (block < block[i])
            gain[i] = 0.3 * (hot - po)[before].sum(axis=0) / ((po * (1 - po))[before].sum(axis=0) + 3)
        want_o += gain
    assert np.abs(margin - want_m).max() < 1e-3 and np.abs(ordered - want_o).max() < 1e-3


def test_cell_sums_are_exact():
    rng = np.random.default_rng(0)
    for n in (1, 50, 4000, 70_000):
        cell = rng.integers(0, 50, (n, 3))
        fields = [rng.integers(-255, 256, n), rng.integers(-255, 256, n), rng.integers(0, 256, n)]
        for f, got in zip(fields, grow.cell_sums(cell, fields, 50), strict=True):
            want = np.zeros(50, np.int64)
            np.add.at(want, cell.ravel(), np.repeat(f, 3))
            assert (got == want).all()


# ---------------------------------------------------------------- rows in many tasks
def as_rows(spark, x, y, key, parts=4):
    rows = [(int(k) - (1 << 64) if k >> np.uint64(63) else int(k), int(c), bytearray(r.tobytes())) for k, c, r in zip(key, y, x)]
    return spark.createDataFrame(rows, "key long, outcome int, codes binary").repartition(parts)


def test_many_tasks_grow_the_trees_of_one(spark, monkeypatch):
    x, y, key = data(600, 5)
    p = mb.VoteParams(xgb_n_estimators=3, xgb_max_depth=3, xgb_subsample=0.8, xgb_colsample_bytree=0.8, cat_iterations=3, cat_depth=3)
    monkeypatch.setattr(large, "KEEP", 2)  # margins are written in between
    rows = as_rows(spark, x, y, key)
    for many, one in ((large.fit_softmax(rows, 5, p), mb.fit_softmax(x, y, key, p)),
                      (large.fit_symmetric(rows, 5, p), mb.fit_symmetric(x, y, key, p))):
        a, b = many.arrays(), one.arrays()
        assert (a["feature"] == b["feature"]).all() and (a["cut"] == b["cut"]).all()
        assert np.allclose(a["value"], b["value"], atol=1e-12)


def test_forest_of_shuffled_bootstraps(spark):
    x, y, key = data(2000, 9, seed=3)
    p = mb.VoteParams(tree_n_estimators=30, tree_min_samples_split=2, tree_min_samples_leaf=1)
    counts = {c: int((y == c).sum()) for c in range(3)}
    f = large.fit_forest(as_rows(spark, x, y, key), 9, p, 2000, counts, 400)
    assert sum(t.trees for t in f.trees) == 30
    assert (f.probabilities(x).argmax(axis=1) == y).mean() > 0.75 > max(counts.values()) / 2000


def test_every_tree_has_a_bootstrap_of_all_rows(spark):
    """Fully grown trees know the class of every row that n draws of n rows give them, whether its
    node was split by counts or grew in a task; a tree's part of the importance adds up to 1."""
    x, y, key = data(2000, 9, seed=3)
    p = mb.VoteParams(tree_n_estimators=6, tree_max_depth=99, tree_min_samples_split=2, tree_min_samples_leaf=1)
    counts = {c: int((y == c).sum()) for c in range(3)}
    table = spark.read.parquet(large.forest_table(as_rows(spark, x, y, key), 9, p, 2000, counts, 300)).orderBy("part").collect()
    limits = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])
    assert [r["part"] for r in table] == list(range(6))
    for r in table:
        rows = np.flatnonzero(np.searchsorted(limits, grow.uniform(key, p.seed, r["part"]), side="right"))
        assert 1150 < len(rows) < 1380  # 1 - 1/e of 2,000
        votes = mb.from_bytes(bytes(r["blob"])).votes(x[rows])
        assert (votes.argmax(axis=1) == y[rows]).all() and (votes.max(axis=1) == 1).all()
        assert sum(r["importance"]) == pytest.approx(1.0) and np.argmax(r["importance"]) in (0, 1, 2)


def test_best_split_by_counts_is_that_of_the_rows():
    x, y, _ = data(300, 4, seed=6)
    times = np.random.default_rng(1).integers(1, 4, 300)
    weight = np.array([0.7, 1.0, 1.9])
    counts = np.zeros((4, 256, 4), np.int64)
    for i in range(300):
        for j in range(4):
            counts[j, x[i, j], y[i]] += times[i]
            counts[j, x[i, j], 3] += 1
    rules = grow.ForestRules(min_leaf=20)
    w, best = times * weight[y], (-1.0, None)
    mass = lambda rows: np.bincount(y[rows], weights=w[rows], minlength=3)
    for j in range(4):
        for c in np.unique(x[:, j])[:-1]:
            sides = [np.flatnonzero(x[:, j] <= c), np.flatnonzero(x[:, j] > c)]
            if min(map(len, sides)) >= 20:
                best = max(best, (sum((mass(s) ** 2).sum() / mass(s).sum() for s in sides), (j, int(c))))
    at, code, fall = large.best_split(counts, weight, rules)
    assert (at, code) == best[1]
    assert fall == pytest.approx(best[0] - (mass(np.arange(300)) ** 2).sum() / w.sum())
    assert large.best_split(counts, weight, grow.ForestRules(min_leaf=200))[0] == -1


def test_shuffles_end_with_their_query(spark):
    """Files of a shuffle are gone once the query that wrote them has ended."""
    import glob
    import time

    from touchline.session import scratch_path, shuffles_freed
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in local for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before = files()
    with shuffles_freed(spark):
        spark.range(1000).repartition(7).groupBy("id").count().write.parquet(scratch_path(spark, "freed"))
        kept = spark.range(1000).repartition(5).groupBy("id").count().collect()
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert len(kept) == 1000 and not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_boosters_of_a_task_sum_pairs_of_columns(monkeypatch):
    x, y, key = data(700, 7, seed=9)
    p = mb.VoteParams(xgb_n_estimators=4, xgb_subsample=0.8, xgb_colsample_bytree=0.8, cat_iterations=4)
    plain = {m: large.fit_booster(m, x, y, key, p) for m in ("xgb", "cat")}
    monkeypatch.setattr(large, "PAIRED_ROWS", 0)
    for m, want in plain.items():
        got = large.fit_booster(m, x, y, key, p)
        assert all(np.array_equal(got.arrays()[k], want.arrays()[k]) for k in ("feature", "cut", "value"))
        assert np.array_equal(want.probabilities(x), mb.fit(m, x, y, key, p).probabilities(x))


# ---------------------------------------------------------------- members
@pytest.mark.parametrize("member", mb.MEMBERS)
def test_members_learn_and_travel(member):
    x, y, key = data(900, 8, seed=1)
    tx, ty, _ = data(900, 8, seed=2)
    p = mb.VoteParams(tree_n_estimators=60, xgb_n_estimators=40, cat_iterations=60)
    m = mb.fit(member, x, y, key, p)
    got = m.probabilities(tx)
    assert np.allclose(got.sum(axis=1), 1.0)
    prior = np.bincount(y) / len(y)
    assert log_loss(got, ty) < 0.9 * log_loss(np.tile(prior, (900, 1)), ty)
    assert np.array_equal(mb.from_bytes(mb.to_bytes(m)).probabilities(tx), got)
    order = np.random.default_rng(0).permutation(900)
    again = mb.fit(member, x[order], y[order], key[order], p) if member != "tree" else m
    assert np.allclose(again.probabilities(tx), got)  # boosters do not depend on the order of rows


def test_codes_keep_the_order_of_values(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, float(rng.normal()), float(rng.integers(0, 4)), None if i % 7 == 0 else float(rng.exponential())) for i in range(700)]
    df = spark.createDataFrame(rows, "match_id long, outcome int, a double, b double, c double").repartition(3)
    cuts = cd.cut_points(df, ["a", "b", "c"])
    got = cd.with_codes(df, ["a", "b", "c"], cuts, ["match_id", "outcome"]).toArrow()
    codes = cd.unpacked(got["codes"], 3)
    x = np.array([[r[2], r[3], r[4] or 0.0] for r in sorted(rows)])[got["match_id"].to_numpy()]
    assert (codes == cd.encode(x, cuts)).all()
    for j in range(3):
        for c in (10, 100, 200):
            assert ((codes[:, j] <= c) == (x[:, j] <= cuts[j, c])).all()
    assert len(np.unique(codes[:, 0])) > 200 and len(np.unique(codes[:, 1] >> 3)) == 4
    assert cd.cut_points(df.limit(0), ["a"]).tolist() == [[0.0] * 255]


# ---------------------------------------------------------------- search
def score_of(p):
    """A known function of the parameters, at most 0."""
    target = {"tree_max_depth": 20, "xgb_learning_rate": 0.08, "cat_depth": 6, "xgb_max_depth": 4, "cat_learning_rate": 0.06}
    return -sum((se.SPACE.unit(n, p[n]) - se.SPACE.unit(n, v)) ** 2 for n, v in target.items())


def test_proposals_beat_random_draws():
    random, found = [], []
    for seed in range(12):
        rng = np.random.default_rng(seed)
        draws = [{n: se.SPACE.value(n, rng.random()) for n in se.SPACE.names} for _ in range(50)]
        done = [(p, score_of(p)) for p in draws[:10]]
        while len(done) < 50:
            p = tpe.propose(se.SPACE, done, seed)
            done.append((p, score_of(p)))
        random.append(max(score_of(p) for p in draws))
        found.append(max(s for _, s in done))
    assert np.mean(found) > 0.6 * np.mean(random) and sum(a > b for a, b in zip(found, random)) >= 9


def test_proposals_are_seeded_and_in_range():
    done = [(tpe.propose(se.SPACE, [], s), float(s % 7)) for s in range(20)]
    a = [tpe.propose(se.SPACE, done, s) for s in range(200)]
    assert a == [tpe.propose(se.SPACE, done, s) for s in range(200)]
    assert len({json.dumps(p) for p in a}) > 150
    for name, (lo, hi) in {**se.SPACE.ints, **se.SPACE.reals}.items():
        assert all(lo <= p[name] <= hi for p in a)
        assert all(isinstance(p[name], int) == (name in se.SPACE.ints) for p in a)


def test_density_against_plain_sums():
    x, at = np.array([0.2, 0.25, 0.9]), np.array([0.0, 0.3, 1.0])
    w = [max(0.2, 0.05), max(0.05, 0.65), max(0.65, 0.1)]
    w = [min(1.0, max(v, 1 / 4)) for v in w]
    for i, a in enumerate(at):
        dens = sum(np.exp(-0.5 * ((a - m) / s) ** 2) / (s * np.sqrt(2 * np.pi)) for m, s in zip(x, w))
        assert tpe.log_density(at, x)[i] == pytest.approx(np.log((dens + 1) / 4))


class Stopped(Exception):
    pass


def test_a_stopped_search_goes_on_where_it_was(spark):
    """Fits of finished folds are not repeated, and the end result is that of a search in one go."""
    from touchline.session import scratch_path
    draws = [mb.VoteParams.of(tpe.propose(se.SPACE, [], s)) for s in range(4)]
    asked, limit = [], [7]

    def scorer(votes):
        if len(asked) >= limit[0]:
            raise Stopped
        asked.extend((se.params_hash(p), f) for _, f, p in votes)
        return spark.createDataFrame([(t, f, 1000, int(1000 + 300 * score_of(p.plain())) - f) for t, f, p in votes],
                                     "trial int, fold int, n long, correct long")

    path = scratch_path(spark, "ledger-test")
    with pytest.raises(Stopped):
        se.search(se.Ledger.at(spark, path), scorer, draws, 3, 9, 5, batch=2)
    kept = len(se.Ledger(spark, path).done())
    assert kept == len(asked) and 0 < kept < 27
    limit[0] = 10**9
    got = se.search(se.Ledger.at(spark, path), scorer, draws, 3, 9, 5, batch=2)
    assert len(asked) == len(set(asked)) == 27
    asked.clear()
    whole = se.search(se.Ledger.at(spark), scorer, draws, 3, 9, 5, batch=2)
    assert got == whole and len(got) == 9 and [p for _, p, _ in got[:4]] == draws
    assert se.Ledger(spark, path).rows().count() == 27


# ---------------------------------------------------------------- scoring and fits of many rows
def test_walks_equal_plain_ones_and_take_less_time():
    """Leaves of a forest and of heaps, against the step-by-step walk that took over twice as long."""
    import time
    x, y, key = data(6000, 20, seed=5)
    p = mb.VoteParams(tree_n_estimators=32, tree_min_samples_split=2, tree_min_samples_leaf=1, xgb_n_estimators=5)
    forest, soft = mb.fit("tree", x, y, key, p), mb.fit("xgb", x, y, key, p)

    def votes(t, codes):
        out = np.zeros((len(codes), t.value.shape[1]))
        for i in range(t.trees):
            node = np.full(len(codes), i, np.int64)
            rows = np.flatnonzero(t.feature[node] >= 0)
            while len(rows):
                at = node[rows]
                node[rows] = t.left[at] + (codes[rows, t.feature[at]] > t.cut[at])
                rows = rows[t.feature[node[rows]] >= 0]
            out += t.value[node]
        return out

    def heap_leaf(t, codes):
        node = np.zeros(len(codes), np.int64)
        for _ in range(int(len(t.value)).bit_length() - 1):
            node = 2 * node + 1 + (codes[np.arange(len(codes)), t.feature[node]] > t.cut[node])
        return node - (len(t.value) - 1)

    tx, _, _ = data(20_000, 20, seed=6)
    plain, fast = [], []
    for _ in range(3):
        start = time.process_time()
        want = sum(votes(t, tx) for t in forest.trees)
        plain.append(time.process_time() - start)
        start = time.process_time()
        got = forest.probabilities(tx)
        fast.append(time.process_time() - start)
    assert (got == want / want.sum(axis=1, keepdims=True)).all()
    assert min(fast) < 0.75 * min(plain)
    assert all((h.leaf(tx) == heap_leaf(h, tx)).all() for r in soft.rounds for h in r)
    assert forest.probabilities(tx[:0]).shape == soft.probabilities(tx[:0]).shape == (0, 3)


@pytest.mark.parametrize("bins, width, n", [(32, 5, 70_000), (16, 4, 300), (4, 1, 0)])
def test_sums_of_column_pairs(bins, width, n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 256, (n, width), dtype=np.uint8)
    place, fields = rng.integers(0, 3, n), [rng.integers(-255, 256, n), rng.integers(0, 256, n), np.ones(n, np.int64)]
    pairs = grow.ColumnPairs(x, bins)
    for pick in (None, np.flatnonzero(rng.random(n) < 0.5)):
        at = np.arange(n) if pick is None else pick
        got = pairs.sums(pick, place[at], [f[at] for f in fields], 3)
        for f, g in zip(fields, got, strict=True):
            want = np.zeros((3, width, bins))
            np.add.at(want, (place[at][:, None], np.arange(width), x[at] // (256 // bins)), f[at][:, None])
            assert (g == want).all()


def test_a_booster_is_one_job_a_stretch_and_tasks_may_share_its_rows(spark, monkeypatch):
    """Jobs do not grow with rounds and levels (one a level before), and rows in two tasks give the same trees."""
    x, y, key = data(400, 4)
    p = mb.VoteParams(xgb_n_estimators=2, xgb_max_depth=2, cat_iterations=6, cat_depth=3)
    rows = as_rows(spark, x, y, key)
    sc = spark.sparkContext
    sc.setJobGroup("boosters", "boosters")
    one = large.fit_symmetric(rows, 4, p)
    assert len(sc.statusTracker().getJobIdsForGroup("boosters")) <= 6
    assert (one.arrays()["cut"] == mb.fit_symmetric(x, y, key, p).arrays()["cut"]).all()
    monkeypatch.setattr(large, "BOOSTER_ROWS", 200)
    assert large.tasks_at_once(spark) > 1
    many, want = large.fit_softmax(rows, 4, p).arrays(), mb.fit_softmax(x, y, key, p).arrays()
    assert all(np.array_equal(many[k], want[k]) for k in ("feature", "cut", "value"))


def test_cut_points_build_their_percentages_once(spark, monkeypatch):
    from touchline.learners import codes as cd
    asked, plain = [], cd.F.percentile_approx
    monkeypatch.setattr(cd.F, "percentile_approx", lambda c, at, acc: asked.append(at) or plain(c, at, acc))
    rows = spark.createDataFrame([(float(i), float(-i)) for i in range(512)], "a double, b double")
    cuts = cd.cut_points(rows, ["a", "b"])
    assert len({id(at) for at in asked}) == 1 and not isinstance(asked[0], list)
    assert cuts.shape == (2, 255) and cuts[0].tolist() == [float(2 * i + 1) for i in range(255)]


def test_whole_columns_lead_to_the_leaves_of_a_walk():
    """Forest and boosters compare nodes for all rows at once; every row ends where
    it would alone, also in trees shallower than the levels that are compared."""
    r = np.random.default_rng(5)
    x = r.integers(0, 256, (3000, 7)).astype(np.uint8)
    y, key = (x[:, 0] // 86 + (x[:, 1] > 200)).clip(0, 2).astype(np.int64), np.arange(3000)
    for rules in (grow.ForestRules(30, 2, 1), grow.ForestRules(3, 2, 1)):
        trees, _ = grow.forest_trees(x, y, key, mb.balanced(y), rules, list(range(20)), 3)
        want = np.zeros((3000, 3))
        for root in range(trees.trees):
            at = np.full(3000, root)
            while len(go := np.flatnonzero(trees.feature[at] >= 0)):
                node = at[go]
                at[go] = trees.left[node] + (x[go, trees.feature[node]] > trees.cut[node])
            want += trees.value[at]
        assert np.array_equal(trees.votes(x), want) and trees.votes(x[:0]).shape == (0, 3)
    for depth in (1, 3, 7, 8):
        feature, cut = r.integers(0, 7, (5, 2 ** depth - 1)), r.integers(0, 256, (5, 2 ** depth - 1))
        leaves = grow.heap_leaves(np.ascontiguousarray(x.T), feature, cut)
        for i in range(5):
            assert np.array_equal(leaves[i], grow.Heap(feature[i], cut[i], np.zeros(2 ** depth)).leaf(x))


def test_rows_are_scored_in_few_numpy_calls(monkeypatch):
    """Rows are not followed through the upper levels of a tree one level at a time."""
    r = np.random.default_rng(6)
    x = r.integers(0, 256, (2000, 5)).astype(np.uint8)
    y, key = (x[:, 0] // 86).astype(np.int64), np.arange(2000)
    forest, _ = mb.fit_forest(x, y, key, mb.VoteParams(tree_n_estimators=4, tree_max_depth=6))
    soft = mb.fit_softmax(x, y, key, mb.VoteParams(xgb_n_estimators=3))
    steps, below = [], grow.below
    monkeypatch.setattr(grow, "below", lambda *a: steps.append(1) or below(*a))
    forest.probabilities(x), soft.probabilities(x)
    assert not steps
