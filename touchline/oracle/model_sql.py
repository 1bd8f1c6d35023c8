"""Oracle SQL for split, folds, weights, standardisation, soft vote and
evaluation tables."""

from __future__ import annotations

from touchline.oracle.sql import training_ctes
from touchline.plans.models import INT_RANGES, REAL_RANGES
from touchline.schema import CLASS_NAMES, feature_names

M31 = 2147483648


def hash31(seed: int, c: str = "match_id") -> str:
    """The 31-bit hash of an id and a seed, in SQL."""
    low = f"((({c}) % {M31} + {M31}) % {M31})"
    high = f"(((({c}) - {low}) // {M31}) % {M31} + {M31}) % {M31}"
    h = f"xor(xor({low}, (({high}) * 1540483477) % {M31}), {(seed * 2654435769 + 12345) % M31})"
    for mult, shift in ((1103515245, 15), (1540483477, 13), (1664525061, 16)):
        t = f"((({h}) * {mult}) % {M31})"
        h = f"list_reduce([{t}, 0], lambda x, y: xor(x, x >> {shift}))"
    return h


PH = hash31(42)
PCT = f"(CAST(FLOOR(({PH}) / 65536) AS BIGINT) % 100)"
SPLIT = f"(CASE WHEN {PCT} < 80 THEN 'train' ELSE 'test' END)"


def _members() -> str:
    ok = "(b365h IS NOT NULL AND b365d IS NOT NULL AND b365a IS NOT NULL AND b365h > 0 AND b365d > 0 AND b365a > 0)"
    tot = "(1e0 / b365h + 1e0 / b365d + 1e0 / b365a)"
    odds = [f"(CASE WHEN {ok} THEN (1e0 / {o}) / {tot} ELSE 1e0 / 3e0 END)" for o in ("b365h", "b365d", "b365a")]
    htot = "(H2H_hometeam_wins + H2H_awayteam_wins + H2H_draws + 3)"
    h2h = [f"((H2H_hometeam_wins + 1) / {htot})", f"((H2H_draws + 1) / {htot})",
           f"((H2H_awayteam_wins + 1) / {htot})"]
    ftot = ("(home_match_wins + home_match_draws + home_match_losses + away_match_losses + away_match_draws "
            "+ away_match_wins + 3)")
    form = [f"((home_match_wins + away_match_losses + 1) / {ftot})",
            f"((home_match_draws + away_match_draws + 1) / {ftot})",
            f"((home_match_losses + away_match_wins + 1) / {ftot})"]
    names = ["p_home", "p_draw", "p_away"]
    return ", ".join(f"(({odds[c]} + {h2h[c]} + {form[c]}) / 3e0) AS {names[c]}" for c in range(3))


def scored_ctes() -> str:
    """... ``sc``: every training row with split, vote probabilities and prediction."""
    return training_ctes() + (
        f", sv AS (SELECT tf.match_id, tf.outcome, {SPLIT} AS split, {_members()} "
        f"FROM tf JOIN (SELECT match_id AS mid, b365h, b365d, b365a FROM m) o ON o.mid = tf.match_id)"
        ", sc AS (SELECT *, CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 0 "
        "WHEN p_draw >= p_away THEN 1 ELSE 2 END AS predicted FROM sv)"
        ", te AS (SELECT * FROM sc WHERE split = 'test')")


def train_test_split() -> str:
    return training_ctes() + f" SELECT match_id, outcome, {SPLIT} AS split FROM tf"


def time_split() -> str:
    return training_ctes() + (
        ", cut AS (SELECT MAKE_DATE(CAST(MAX(season_year) AS BIGINT), 8, 1) AS d FROM m)"
        " SELECT tf.match_id, tf.outcome, CASE WHEN mm.match_date < cut.d THEN 'train' ELSE 'test' END AS split "
        "FROM tf JOIN (SELECT match_id AS mid, match_date FROM m) mm ON mm.mid = tf.match_id CROSS JOIN cut")


def stratified_folds() -> str:
    return training_ctes() + (
        f", tr AS (SELECT match_id, outcome, {PH} AS b FROM tf WHERE {SPLIT} = 'train')"
        " SELECT match_id, outcome, CAST((ROW_NUMBER() OVER (PARTITION BY outcome ORDER BY b, match_id) - 1) % 5"
        " AS INTEGER) AS fold FROM tr")


def rolling_folds() -> str:
    """Every match's part in each of 5 folds by day, with a week's embargo."""
    return training_ctes() + (
        ", dm AS (SELECT tf.match_id, mm.match_date FROM tf JOIN (SELECT match_id AS mid, match_date FROM m) mm "
        "ON mm.mid = tf.match_id)"
        ", bl AS (SELECT match_id, match_date, CAST(FLOOR((SELECT COUNT(*) FROM dm e WHERE e.match_date < dm.match_date) * 6 "
        "/ CAST((SELECT COUNT(*) FROM dm) AS DOUBLE)) AS INTEGER) AS b FROM dm)"
        ", st AS (SELECT CAST(b - 1 AS INTEGER) AS fold, MIN(match_date) AS first_day FROM bl WHERE b > 0 GROUP BY b)"
        " SELECT fold, match_id, CASE WHEN b = fold + 1 THEN 'test' WHEN first_day - match_date <= 7 THEN 'embargo' "
        "ELSE 'train' END AS part FROM bl JOIN st ON b <= fold + 1")


def class_weights() -> str:
    return training_ctes() + (
        f" SELECT outcome, COUNT(*) AS n_class, CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / "
        f"CAST(COUNT(*) OVER () * COUNT(*) AS DOUBLE) AS weight FROM tf WHERE {SPLIT} = 'train' GROUP BY outcome")


def standardise() -> str:
    items = ", ".join(
        f"{{'feature': '{f}', 'ord': {i}, 'mean': AVG({f}), 'std': STDDEV_POP({f})}}"
        for i, f in enumerate(feature_names()))
    return training_ctes() + (
        f", agg AS (SELECT [{items}] AS l FROM tf WHERE {SPLIT} = 'train')"
        " SELECT s.feature, CAST(s.ord AS INTEGER) AS ord, s.mean, s.std FROM (SELECT UNNEST(l) AS s FROM agg) u")


def soft_vote() -> str:
    return scored_ctes() + " SELECT match_id, outcome, split, p_home, p_draw, p_away, predicted FROM sc"


def accuracy() -> str:
    return scored_ctes() + (" SELECT COUNT(*) AS n, COUNT(CASE WHEN outcome = predicted THEN 1 END) AS correct, "
                            "CAST(COUNT(CASE WHEN outcome = predicted THEN 1 END) AS DOUBLE) / "
                            "CAST(COUNT(*) AS DOUBLE) AS accuracy FROM te")


def confusion() -> str:
    return scored_ctes() + (
        ", grid AS (SELECT a.actual, b.predicted FROM (VALUES (0), (1), (2)) a(actual), "
        "(VALUES (0), (1), (2)) b(predicted))"
        ", c AS (SELECT outcome AS actual, predicted, COUNT(*) AS n FROM te GROUP BY outcome, predicted)"
        " SELECT CAST(grid.actual AS INTEGER) AS actual, CAST(grid.predicted AS INTEGER) AS predicted, "
        "COALESCE(c.n, 0) AS n FROM grid LEFT JOIN c ON c.actual = grid.actual AND c.predicted = grid.predicted")


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) ELSE 0e0 END)"


def class_report() -> str:
    cnt = []
    for c in range(3):
        cnt += [f"COUNT(CASE WHEN outcome = {c} AND predicted = {c} THEN 1 END) AS tp{c}",
                f"COUNT(CASE WHEN predicted = {c} THEN 1 END) AS pp{c}",
                f"COUNT(CASE WHEN outcome = {c} THEN 1 END) AS sup{c}"]
    prec = [_div(f"tp{c}", f"pp{c}") for c in range(3)]
    rec = [_div(f"tp{c}", f"sup{c}") for c in range(3)]
    f1 = [_div(f"tp{c} * 2", f"tp{c} * 2 + (pp{c} - tp{c}) + (sup{c} - tp{c})") for c in range(3)]

    def macro(v):
        return f"(({v[0]} + {v[1]} + {v[2]}) / 3e0)"

    def weighted(v):
        return f"((({v[0]} * sup0 + {v[1]} * sup1) + {v[2]} * sup2) / CAST(n AS DOUBLE))"

    rows = [f"SELECT '{CLASS_NAMES[c]}' AS label, {prec[c]} AS precision, {rec[c]} AS recall, "
            f"{f1[c]} AS f1_score, CAST(sup{c} AS BIGINT) AS support FROM one" for c in range(3)]
    rows.append(f"SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {_div('tp0 + tp1 + tp2', 'n')}, "
                "CAST(n AS BIGINT) FROM one")
    rows.append(f"SELECT 'macro avg', {macro(prec)}, {macro(rec)}, {macro(f1)}, CAST(n AS BIGINT) FROM one")
    rows.append(f"SELECT 'weighted avg', {weighted(prec)}, {weighted(rec)}, {weighted(f1)}, CAST(n AS BIGINT) "
                "FROM one")
    return scored_ctes() + f", one AS (SELECT {', '.join(cnt)}, COUNT(*) AS n FROM te) " + " UNION ALL ".join(rows)


_ROC = (", lng AS (SELECT outcome, 0 AS class, p_home AS score FROM te UNION ALL "
        "SELECT outcome, 1, p_draw FROM te UNION ALL SELECT outcome, 2, p_away FROM te)"
        ", rg AS (SELECT class, score, COUNT(CASE WHEN outcome = class THEN 1 END) AS pos, "
        "COUNT(CASE WHEN outcome <> class THEN 1 END) AS neg FROM lng GROUP BY class, score)"
        ", rtot AS (SELECT class, SUM(pos) AS P, SUM(neg) AS N FROM rg GROUP BY class)"
        ", cum AS (SELECT rg.class, rg.score, rg.pos, rg.neg, "
        "SUM(rg.pos) OVER (PARTITION BY rg.class ORDER BY rg.score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, "
        "SUM(rg.neg) OVER (PARTITION BY rg.class ORDER BY rg.score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp "
        "FROM rg)"
        ", pts AS (SELECT cum.class, cum.score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
        "CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg, CAST(rtot.P AS BIGINT) AS P, CAST(rtot.N AS BIGINT) AS N "
        "FROM cum JOIN rtot ON rtot.class = cum.class UNION ALL "
        "SELECT class, CAST(NULL AS DOUBLE), 0, 0, 0, 0, CAST(P AS BIGINT), CAST(N AS BIGINT) FROM rtot)")


def roc_points() -> str:
    return scored_ctes() + _ROC + (
        " SELECT CAST(class AS INTEGER) AS class, threshold, tp, fp, "
        "CASE WHEN P > 0 THEN CAST(tp AS DOUBLE) / CAST(P AS DOUBLE) END AS tpr, "
        "CASE WHEN N > 0 THEN CAST(fp AS DOUBLE) / CAST(N AS DOUBLE) END AS fpr, pos, neg, P, N FROM pts")


def auc() -> str:
    return scored_ctes() + _ROC + (
        " SELECT CAST(class AS INTEGER) AS class, CASE WHEN MAX(P) > 0 AND MAX(N) > 0 THEN "
        "CAST(SUM(pos * (2 * (N - fp) + neg)) AS DOUBLE) / (2e0 * MAX(P) * MAX(N)) END AS auc "
        "FROM pts WHERE threshold IS NOT NULL GROUP BY class")


def sound(more: str = "") -> str:
    """Keys of the test rows with the flags that hold for any model that has learned."""
    return training_ctes() + (f" SELECT match_id, outcome{more}, TRUE AS sums_to_one, TRUE AS is_argmax, TRUE AS beats_shares "
                              f"FROM tf WHERE {SPLIT} = 'test'")


def search_parameters() -> str:
    """The 50 draws, from the ranges as published."""
    names = [*INT_RANGES, *REAL_RANGES]
    cols = []
    for i, name in enumerate(names):
        h = hash31(42, f"(trial * {len(names)} + {i})")
        lo, hi = INT_RANGES.get(name) or REAL_RANGES[name]
        if name in INT_RANGES:
            cols.append(f"CAST({lo} + CAST(FLOOR(({h}) / 256) AS BIGINT) % {hi - lo + 1} AS INTEGER) AS {name}")
        else:
            cols.append(f"{lo!r}::DOUBLE + CAST({h} AS DOUBLE) / 2147483648e0 * ({hi!r}::DOUBLE - {lo!r}::DOUBLE) AS {name}")
    return training_ctes() + (
        ", tr AS (SELECT COUNT(*) AS c, outcome FROM tf WHERE " + SPLIT + " = 'train' GROUP BY outcome)"
        ", sz AS (SELECT SUM(c) - SUM(CAST(CEIL(c / 5e0) AS BIGINT)) AS least_fit_rows FROM tr)"
        f" SELECT CAST(trial AS INTEGER) AS trial, {', '.join(cols)}, CAST(least_fit_rows AS BIGINT) AS least_fit_rows "
        "FROM range(50) t(trial), sz")
