"""What model queries report, recomputed by DuckDB from the tables they wrote."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

P = ["p_home", "p_draw", "p_away"]


@pytest.fixture(scope="module")
def written(spark):
    """DuckDB with ``imp`` (importance) and ``v`` (members and vote on the test rows)."""
    E.q_feature_importance(spark, SF_SMALL)
    E.q_vote_predict(spark, SF_SMALL)
    db = duckdb.connect()
    for view, key in (("imp", "importance"), ("v", "vote-rows")):
        path = next(p for k, p in E._FITTED.items() if k[0] == key and k[2] == SF_SMALL).removeprefix("file:")
        db.sql(f"CREATE VIEW {view} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return db


def same(db, sql, df, tol=1e-9):
    cols = df.columns
    got = sorted(map(tuple, df.collect()), key=str)
    want = sorted(db.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=str)
    assert len(got) == len(want) > 0
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x == y or x == pytest.approx(y, abs=tol), (a, b)


def test_top_features_and_report(spark, written):
    """SL-4, SL-5, PF-14, EV-7."""
    ranked = "SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp"
    same(written, f"SELECT feature, importance, CAST(rank AS INTEGER) AS rank FROM ({ranked}) WHERE rank <= 80", E.q_top_features(spark, SF_SMALL))
    same(written, f"SELECT feature, importance, importance * 100 AS importance_pct FROM ({ranked}) WHERE rank <= 20",
         E.q_importance_report(spark, SF_SMALL))
    got = E.q_importance_report(spark, SF_SMALL).collect()
    assert [r.importance for r in got] == sorted(r.importance for r in got)
    assert E._top(spark, SF_SMALL) == [r[0] for r in written.sql(f"SELECT feature FROM ({ranked}) WHERE rank <= 80 ORDER BY rank").fetchall()]
    total, rows = written.sql("SELECT sum(importance), count(*) FROM imp").fetchall()[0]
    assert rows == 159 and total == pytest.approx(1.0)


def arg_max(p):
    return f"CASE WHEN {p[0]} >= {p[1]} AND {p[0]} >= {p[2]} THEN 0 WHEN {p[1]} >= {p[2]} THEN 1 ELSE 2 END"


def test_members_and_vote(spark, written):
    """ML-7, ML-8, ML-12: classes of the members, and the vote as their mean."""
    for query, m in (("forest_predict", "tree"), ("boost_a_predict", "xgb"), ("boost_b_predict", "cat")):
        cols = [f"p_{m}_{c}" for c in range(3)]
        sql = f"SELECT match_id, outcome, {', '.join(f'{c} AS {p}' for c, p in zip(cols, P))}, {arg_max(cols)} AS predicted FROM v"
        same(written, sql, E.queries()[query](spark, SF_SMALL))
        worst = written.sql(f"SELECT max(abs({' + '.join(cols)} - 1)), min(least({', '.join(cols)})) FROM v").fetchall()[0]
        assert worst[0] < 1e-9 and worst[1] >= 0
    mean = [f"(p_tree_{c} + p_xgb_{c} + p_cat_{c}) / 3" for c in range(3)]
    sql = f"SELECT match_id, outcome, {', '.join(f'{c} AS {p}' for c, p in zip(mean, P))}, {arg_max(mean)} AS predicted FROM v"
    same(written, sql, E.q_vote_predict(spark, SF_SMALL))


def test_vote_metrics(spark, written):
    """EV-1 to EV-6 on the fitted vote."""
    q = E.queries()
    same(written, "SELECT count(*) AS n, count_if(outcome = predicted) AS correct, avg((outcome = predicted)::INT) AS accuracy FROM v",
         q["vote_accuracy"](spark, SF_SMALL))
    same(written, "SELECT avg(-ln(greatest(CASE outcome WHEN 0 THEN p_home WHEN 1 THEN p_draw ELSE p_away END, 1e-15))) AS log_loss FROM v",
         q["vote_log_loss"](spark, SF_SMALL))
    grid = "SELECT a.i::INT AS actual, b.i::INT AS predicted FROM range(3) a(i), range(3) b(i)"
    same(written, f"SELECT g.actual, g.predicted, count(v.outcome) AS n FROM ({grid}) g LEFT JOIN v ON v.outcome = g.actual "
         "AND v.predicted = g.predicted GROUP BY ALL", q["vote_confusion"](spark, SF_SMALL))
    pairs = " UNION ALL ".join(
        f"SELECT {c} AS class, avg(CASE WHEN a.{p} > b.{p} THEN 1.0 WHEN a.{p} = b.{p} THEN 0.5 ELSE 0 END) AS auc "
        f"FROM v a, v b WHERE a.outcome = {c} AND b.outcome <> {c}" for c, p in enumerate(P))
    same(written, pairs, q["vote_auc"](spark, SF_SMALL))
    per = " UNION ALL ".join(
        f"SELECT '{name}' AS label, count_if(outcome = {c} AND predicted = {c}) / greatest(count_if(predicted = {c}), 1) AS precision, "
        f"count_if(outcome = {c} AND predicted = {c}) / greatest(count_if(outcome = {c}), 1) AS recall, "
        f"count_if(outcome = {c}) AS support FROM v" for c, name in enumerate(["Home Win", "Draw", "Away Win"]))
    report = q["vote_report"](spark, SF_SMALL).where("label in ('Home Win', 'Draw', 'Away Win')").select("label", "precision", "recall", "support")
    same(written, per, report)
    n = written.sql("SELECT count(DISTINCT p_home) + count(DISTINCT p_draw) + count(DISTINCT p_away) + 3 FROM v").fetchall()[0][0]
    roc = q["vote_roc_points"](spark, SF_SMALL)
    assert roc.count() == n
    r = roc.where("class = 1 and threshold is not null").orderBy("threshold").collect()[len(roc.head(5))]
    tp = written.sql(f"SELECT count_if(outcome = 1), count_if(outcome <> 1) FROM v WHERE p_draw >= {r.threshold!r}::DOUBLE").fetchall()[0]
    assert (r.tp, r.fp) == tp
