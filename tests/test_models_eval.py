"""Evaluation tables against brute force, and the model round trip."""

import itertools
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from touchline.plans import evaluate as ev
from touchline.plans import models as ml
from touchline.plans import prep


def _preds(spark, n=300, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.choice([0, 0, 0, 1, 2, 2])
        raw = [rnd.choice([0.1, 0.2, 0.3, 0.5]) + (0.3 if c == y and rnd.random() < 0.6 else 0) for c in range(3)]
        s = sum(raw)
        rows.append((i, y, raw[0] / s, raw[1] / s, raw[2] / s))
    df = spark.createDataFrame(rows, "match_id long, outcome int, p_home double, p_draw double, p_away double")
    return rows, df.withColumn("predicted", ev.argmax3(F.col("p_home"), F.col("p_draw"), F.col("p_away")))


def test_confusion_report_accuracy(spark):
    rows, df = _preds(spark)
    pred = [max(range(3), key=lambda c: (r[2 + c], -c)) for r in rows]
    cm = {(r.actual, r.predicted): r.n for r in ev.confusion(df).collect()}
    assert len(cm) == 9
    for a, p in itertools.product(range(3), range(3)):
        assert cm[(a, p)] == sum(1 for r, q in zip(rows, pred) if r[1] == a and q == p)
    acc = ev.accuracy(df).first()
    assert acc.correct == sum(1 for r, q in zip(rows, pred) if r[1] == q)
    rep = {r.label: r for r in ev.class_report(df).collect()}
    for c, name in enumerate(["Home Win", "Draw", "Away Win"]):
        tp = cm[(c, c)]
        pp = sum(cm[(a, c)] for a in range(3))
        sup = sum(cm[(c, p)] for p in range(3))
        assert rep[name].precision == pytest.approx(tp / pp if pp else 0)
        assert rep[name].recall == pytest.approx(tp / sup if sup else 0)
        assert rep[name].support == sup
    assert rep["accuracy"].f1_score == pytest.approx(acc.accuracy)


def test_auc_equals_pair_count(spark):
    rows, df = _preds(spark)
    got = {r["class"]: r.auc for r in ev.auc(df).collect()}
    for c in range(3):
        pos = [r[2 + c] for r in rows if r[1] == c]
        neg = [r[2 + c] for r in rows if r[1] != c]
        wins = sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg)
        assert got[c] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    pts = ev.roc_points(df).where(F.col("class") == 0).orderBy(F.col("threshold").desc_nulls_first())
    tprs = [r.tpr for r in pts.collect()]
    assert tprs[0] == 0 and tprs[-1] == 1 and tprs == sorted(tprs)


def test_folds_are_stratified(spark):
    rows, df = _preds(spark, n=500)
    folds = prep.stratified_folds(df.select("match_id", "outcome"), k=5, bucket_rows=32).collect()
    assert len(folds) == 500 and len({r.match_id for r in folds}) == 500
    for c in range(3):
        sizes = [sum(1 for r in folds if r.outcome == c and r.fold == f) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_vote_fit_save_load_round_trip(spark):
    import __spark_entry__ as E
    tr = E._train_rows(spark, SF_SMALL)
    feats = ["H2H_hometeam_wins", "home_win_rate", "away_win_rate", "points_per_game", "momentum_difference"]
    params = ml.VoteParams(tree_n_estimators=5, tree_max_depth=3, xgb_n_estimators=2, xgb_max_depth=2,
                           cat_iterations=2, cat_depth=2)
    model = ml.fit_vote(tr, feats, params)
    test = E._test_rows(spark, SF_SMALL).select("match_id", "outcome", *feats)
    a = model.transform(test)
    sums = a.select((F.col("p_home") + F.col("p_draw") + F.col("p_away")).alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in sums)
    path = tempfile.mkdtemp(prefix="vote-") + "/m"
    model.save(path)
    back = ml.VoteModel.load(spark, path)
    assert back.features == feats and back.params.xgb_n_estimators == 2
    b = {r.match_id: (r.predicted, round(r.p_home, 12)) for r in back.transform(test).collect()}
    assert b == {r.match_id: (r.predicted, round(r.p_home, 12)) for r in a.collect()}


def test_features_do_not_come_back_from_the_model(spark):
    """Scores come with the columns that are asked for; equal to those next to all columns."""
    import __spark_entry__ as E
    feats = ["H2H_hometeam_wins", "home_win_rate", "away_win_rate", "points_per_game", "momentum_difference"]
    model = ml.fit_vote(E._train_rows(spark, SF_SMALL), feats, ml.VoteParams(
        tree_n_estimators=5, xgb_n_estimators=2, xgb_max_depth=9, cat_iterations=2, cat_depth=2))
    test = E._test_rows(spark, SF_SMALL).select("match_id", "outcome", *feats)
    got = model.member_probs(test, ["match_id"])
    probs = [f"p_{m}_{c}" for m in ("tree", "xgb", "cat") for c in range(3)]
    assert got.columns == ["match_id", *probs]
    assert sorted(got.collect()) == sorted(model.member_probs(test).select("match_id", *probs).collect())
    scored = ml.score_fixtures(model, test, ["match_id"])
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if "MapInArrow" in x)
    assert line.split("[", 1)[1].count(",") <= 1 + len(probs)  # match_id and the members' columns
    want = {r.match_id: r.predicted for r in model.transform(test).collect()}
    assert {r.match_id: r.predicted for r in scored.collect()} == want


def test_large_tables_are_fitted_in_many_tasks(spark, monkeypatch):
    import __spark_entry__ as E
    tr = E._train_rows(spark, SF_SMALL)
    feats = ["H2H_hometeam_wins", "home_win_rate", "away_win_rate", "points_per_game", "momentum_difference"]
    params = ml.VoteParams(tree_n_estimators=6, xgb_n_estimators=2, xgb_max_depth=2, cat_iterations=2, cat_depth=2)
    one = ml.fit_vote(tr, feats, params)
    monkeypatch.setattr(ml, "TASK_ROWS", 100)
    monkeypatch.setattr(ml, "TREE_ROWS", 500)
    many = ml.fit_vote(tr, feats, params)
    test = E._test_rows(spark, SF_SMALL).select("match_id", "outcome", *feats)
    a, b = ({r.match_id: r for r in m.member_probs(test).collect()} for m in (one, many))
    for i in a:
        for m in ("xgb", "cat"):
            assert all(a[i][f"p_{m}_{c}"] == pytest.approx(b[i][f"p_{m}_{c}"], abs=1e-12) for c in range(3))
        assert sum(b[i][f"p_tree_{c}"] for c in range(3)) == pytest.approx(1.0)


def test_search_scores_the_whole_train_split(spark, monkeypatch):
    """All trials on all folds; SEARCH_ROWS bounds the fits, not what is scored."""
    import __spark_entry__ as E
    from touchline.learners import fit as ft
    from touchline.learners import search as se
    rnd = random.Random(3)
    train = spark.createDataFrame([(i, (i * 7) % 3, float((i * 7) % 3) + rnd.random()) for i in range(3000)],
                                  "match_id long, outcome int, x double")
    seen = []
    fitted, ledgers = ft.fitted, []

    def fits(session, sample, jobs):
        seen.extend((j.trial, j.fold, j.member, len(sample.value.without(j.fold)[1])) for j in jobs)
        return fitted(session, sample, jobs)

    def at(session, path=None, made=se.Ledger.at):
        ledgers.append(made(session, path))
        return ledgers[-1]

    small = ml.VoteParams(tree_n_estimators=5, xgb_n_estimators=2, cat_iterations=2)
    monkeypatch.setattr(ft, "fitted", fits)
    monkeypatch.setattr(se.Ledger, "at", staticmethod(at))
    monkeypatch.setattr(E, "_train_rows", lambda *_: train)
    monkeypatch.setattr(E, "_top", lambda *_: ["x"])
    monkeypatch.setattr(E, "_FITTED", {})
    monkeypatch.setattr(E, "FIT_ROWS", 600)
    monkeypatch.setattr(E, "SEARCH_ROWS", 300)
    monkeypatch.setattr(ml, "VoteParams", type("Small", (), {"__new__": lambda cls: small, "of": staticmethod(lambda r: small)}))
    monkeypatch.setattr(ml, "TRIALS", 1)
    assert E.q_cv_score(spark, "none").first().cv_accuracy > 0.9
    assert sorted((f, m) for _, f, m, _ in seen) == sorted((f, m) for f in range(5) for m in ml.MEMBERS)
    assert all(450 < n < 750 for *_, n in seen)
    seen.clear()
    assert [r.trial for r in E.q_search_trials(spark, "none").collect()] == [0]
    assert all(200 < n < 400 for *_, n in seen) and len(seen) == 15
    assert ledgers[0].rows().agg(F.sum("n")).first()[0] == 3000


SMALL = ml.VoteParams(tree_n_estimators=4, xgb_n_estimators=2, cat_iterations=2)


def _known(spark, n):
    """Rows whose class follows from ``x``."""
    k = (F.col("id") * 7) % 3
    return spark.range(n).select(F.col("id").alias("match_id"), k.cast("int").alias("outcome"), (k + F.rand(1) * 0.9).alias("x"))


def _seen_fits(monkeypatch):
    """Rows that each fit of a job uses, and the codes its boosters tell apart."""
    from touchline.learners import fit as ft
    seen, fitted = [], ft.fitted

    def fits(session, sample, jobs):
        seen.extend((j.fold, j.member, len(sample.value.without(j.fold)[1]), j.params.bins) for j in jobs)
        return fitted(session, sample, jobs)

    monkeypatch.setattr(ft, "fitted", fits)
    return seen


def _entry_over(monkeypatch, train):
    import __spark_entry__ as E
    monkeypatch.setattr(E, "_train_rows", lambda *_: train)
    monkeypatch.setattr(E, "_top", lambda *_: ["x"])
    monkeypatch.setattr(E, "_FITTED", {})
    monkeypatch.setattr(ml, "VoteParams", type("Small", (), {"__new__": lambda cls: SMALL, "of": staticmethod(lambda r: SMALL)}))
    monkeypatch.setattr(ml, "TRIALS", 1)
    return E


def test_the_vote_is_fitted_on_the_whole_train_split(spark, monkeypatch):
    E = _entry_over(monkeypatch, _known(spark, 26_000))
    assert E._fit_rows(spark, "none").count() == 26_000
    seen = _seen_fits(monkeypatch)
    E._vote(spark, "none")
    assert {n for _, _, n, _ in seen} == {26_000}


def test_cv_fits_use_all_rows_outside_their_fold(spark, monkeypatch):
    E, seen = _entry_over(monkeypatch, _known(spark, 26_000)), _seen_fits(monkeypatch)
    assert E.q_cv_score(spark, "none").first().cv_accuracy > 0.9
    assert len(seen) == 15 and all(abs(n - 20_800) <= 3 for _, _, n, _ in seen)


def test_search_fits_use_all_rows_outside_their_fold(spark, monkeypatch):
    """With the codes of the fits that the best trial is refit with."""
    E, seen = _entry_over(monkeypatch, _known(spark, 3000)), _seen_fits(monkeypatch)
    assert E.q_search_trials(spark, "none").first().cv_accuracy > 0.9
    assert len(seen) == 15 and all(abs(n - 2400) <= 3 and bins == SMALL.bins for _, _, n, bins in seen)


def test_votes_on_rows_in_many_tasks(spark, monkeypatch):
    """CV, importance and a saved vote with a forest that is a table and is scored a group of trees at a time."""
    from touchline.learners import held as hm
    from touchline.learners import members as mb
    train = _known(spark, 3000).withColumn("noise", F.rand(2))
    folds = train.withColumn("fold", (F.col("match_id") % 2).cast("int"))
    seen = _seen_fits(monkeypatch)
    monkeypatch.setattr(ml, "TASK_ROWS", 500)
    monkeypatch.setattr(ml, "TREE_ROWS", 700)
    monkeypatch.setattr(hm, "GROUP_BYTES", 2000)
    assert ml.cv_accuracy(folds, ["x", "noise"], SMALL, 2) > 0.95 and not seen
    imp = {r.feature: r.importance for r in ml.feature_importance(train, ["x", "noise"], num_trees=4).collect()}
    assert imp["x"] > 0.5 > imp["noise"] and sum(imp.values()) == pytest.approx(1.0)
    model = ml.fit_vote(train, ["x", "noise"], SMALL)
    assert isinstance(model.members["tree"], mb.StoredForest) and len(list(hm.tree_groups(spark, model.members["tree"]))) > 1
    a = {r.match_id: r for r in model.member_probs(train).collect()}
    path = tempfile.mkdtemp(prefix="vote-") + "/m"
    model.save(path)
    monkeypatch.setattr(hm, "GROUP_BYTES", 1 << 30)  # one group
    b = {r.match_id: r for r in ml.VoteModel.load(spark, path).member_probs(train).collect()}
    assert len(a) == len(b) == 3000
    for i, r in a.items():
        assert all(r[f"p_{m}_{c}"] == pytest.approx(b[i][f"p_{m}_{c}"], abs=1e-12) for m in ml.MEMBERS for c in range(3))
    assert sum(max(range(3), key=lambda c: r[f"p_tree_{c}"]) == r.outcome for r in a.values()) > 2900


def test_standardise_uses_train_statistics(spark):
    train = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 6.0, 5.0)], "match_id long, a double, b double")
    test = spark.createDataFrame([(4, 3.0, 7.0)], "match_id long, a double, b double")
    out = prep.standardise(test, ["a", "b"], train=train).first()
    mean = 3.0
    std = ((1 - mean) ** 2 + (2 - mean) ** 2 + (6 - mean) ** 2) ** 0.5 / 3 ** 0.5  # population deviation
    assert out.a == pytest.approx((3.0 - mean) / std)
    assert out.b == pytest.approx(7.0 - 5.0)  # zero deviation scales by 1
    stats = {r.feature: r for r in prep.standardise_stats(train, ["a", "b"]).collect()}
    assert stats["a"].mean == 3.0 and stats["a"].std == pytest.approx(std) and stats["b"].std == 0


def test_statistics_of_many_features_are_compiled(spark):
    """An aggregate of all columns at once is interpreted; rows and values are as before."""
    train = spark.range(500).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).cast("double").alias(f"f{i}") for i in range(60)])
    names = train.columns
    got = prep.standardise_stats(train, names)
    rows = {r.feature: r for r in got.collect()}
    want = train.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.avg, F.stddev_pop)]).first()
    assert [rows[c].ord for c in names] == list(range(60)) and got.columns == ["feature", "ord", "mean", "std"]
    for c in names:
        assert rows[c].mean == pytest.approx(want[f"avg_{c}"]) and rows[c].std == pytest.approx(want[f"stddev_pop_{c}"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\*\(\d+\) HashAggregate\(keys=\[\], functions=\[partial_avg", plan)) == 5  # * marks what is compiled


def test_folds_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([(1, 0), (2, None), (3, 0), (4, 1), (5, None)], "match_id long, outcome int")
    assert sorted(r.match_id for r in prep.stratified_folds(df, k=2).collect()) == [1, 2, 3, 4, 5]


def test_seed_decides_the_split(spark):
    """80/20 splits by two seeds differ on 2 * 0.8 * 0.2 = 32 % of the rows."""
    ids = spark.range(20_000).select(F.col("id").alias("match_id"))
    splits = [{r.match_id: r.split for r in prep.train_test_split(ids, seed=s).collect()} for s in (42, 43, 1042)]
    for s in splits:
        assert abs(sum(v == "test" for v in s.values()) / 20_000 - 0.2) < 0.01
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert abs(sum(splits[a][i] != splits[b][i] for i in splits[a]) / 20_000 - 0.32) < 0.02


def test_trial_parameters_lie_in_the_published_ranges(spark):
    rows = ml.trial_parameters(spark).collect()
    assert len(rows) == 50 and len({tuple(r) for r in rows}) == 50
    for name, (lo, hi) in {**ml.INT_RANGES, **ml.REAL_RANGES}.items():
        v = [r[name] for r in rows]
        assert lo <= min(v) and max(v) <= hi and max(v) - min(v) > 0.6 * (hi - lo)
    for name, (lo, hi) in ml.INT_RANGES.items():
        assert lo <= getattr(ml.VoteParams(), name) <= hi
