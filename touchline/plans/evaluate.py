"""Soft voting and evaluation tables (ML-8, SL-6, EV-1..EV-5).

Inputs are DataFrames with a true label ``outcome`` (0/1/2) and class
probabilities ``p_home, p_draw, p_away``; outputs are small DataFrames, never
driver-side arrays.  Charts of the reference are replaced by these tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.prefix import running_totals
from touchline.schema import CLASS_NAMES

P = ["p_home", "p_draw", "p_away"]


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """Index of the largest of three; ties go to the lowest index."""
    return (F.when((p0 >= p1) & (p0 >= p2), F.lit(0)).when(p1 >= p2, F.lit(1)).otherwise(F.lit(2)))


def odds_member(h="b365h", d="b365d", a="b365a") -> list[Column]:
    """Bookmaker-implied probabilities (normalised inverse odds); uniform when
    any price is missing."""
    ih, id_, ia = F.lit(1.0) / F.col(h), F.lit(1.0) / F.col(d), F.lit(1.0) / F.col(a)
    tot = ih + id_ + ia
    ok = F.col(h).isNotNull() & F.col(d).isNotNull() & F.col(a).isNotNull() & (F.col(h) > 0) \
        & (F.col(d) > 0) & (F.col(a) > 0)
    third = F.lit(1.0) / F.lit(3.0)
    return [F.when(ok, x / tot).otherwise(third) for x in (ih, id_, ia)]


def h2h_member() -> list[Column]:
    """Laplace-smoothed outcome shares of the last meetings (block A)."""
    w, d, l_ = F.col("H2H_hometeam_wins"), F.col("H2H_draws"), F.col("H2H_awayteam_wins")
    tot = w + l_ + d + 3
    return [(w + 1) / tot, (d + 1) / tot, (l_ + 1) / tot]


def form_member() -> list[Column]:
    """Smoothed shares from the home side's home record and the away side's
    away record (blocks B and C)."""
    hw, hd, hl = F.col("home_match_wins"), F.col("home_match_draws"), F.col("home_match_losses")
    aw, ad, al = F.col("away_match_wins"), F.col("away_match_draws"), F.col("away_match_losses")
    tot = hw + hd + hl + al + ad + aw + 3
    return [(hw + al + 1) / tot, (hd + ad + 1) / tot, (hl + aw + 1) / tot]


def soft_vote(df: DataFrame, members: list[list[Column]], keep: list[str]) -> DataFrame:
    """ML-8: equal-weight mean of the members' class probabilities, then the
    arg-max class (SL-6)."""
    k = len(members)
    probs = []
    for c in range(3):
        s = members[0][c]
        for m in members[1:]:
            s = s + m[c]
        probs.append((s / F.lit(float(k))).alias(P[c]))
    out = df.select(*keep, *probs)
    return out.withColumn("predicted", argmax3(*[F.col(p) for p in P]))


def accuracy(pred: DataFrame, y: str = "outcome", p: str = "predicted") -> DataFrame:
    """EV-1: one row (n, correct, accuracy)."""
    return pred.agg(F.count(F.lit(1)).alias("n"),
                    F.count(F.when(F.col(y) == F.col(p), 1)).alias("correct")).select(
        "n", "correct", F.when(F.col("n") > 0, F.col("correct").cast("double") / F.col("n").cast("double"))
        .alias("accuracy"))


def confusion(pred: DataFrame, y: str = "outcome", p: str = "predicted") -> DataFrame:
    """EV-3: all 9 (actual, predicted) cells, empty cells as 0."""
    spark = pred.sparkSession
    # The 3 x 3 cells of the three classes.
    grid = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "actual int, predicted int")
    counts = pred.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).alias("n"))


def class_report(pred: DataFrame, y: str = "outcome", p: str = "predicted") -> DataFrame:
    """EV-2: precision, recall, F1 and support per class, then the accuracy,
    macro-average and support-weighted-average rows.  Empty denominators give
    0.  All counts are taken in one aggregate pass."""
    aggs = []
    for c in range(3):
        aggs += [F.count(F.when((F.col(y) == c) & (F.col(p) == c), 1)).alias(f"tp{c}"),
                 F.count(F.when(F.col(p) == c, 1)).alias(f"pp{c}"),
                 F.count(F.when(F.col(y) == c, 1)).alias(f"sup{c}")]
    one = pred.agg(*aggs, F.count(F.lit(1)).alias("n"))

    def div(a, b):
        return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))

    prec = [div(F.col(f"tp{c}"), F.col(f"pp{c}")) for c in range(3)]
    rec = [div(F.col(f"tp{c}"), F.col(f"sup{c}")) for c in range(3)]
    f1 = [div(F.col(f"tp{c}") * 2, F.col(f"tp{c}") * 2 + (F.col(f"pp{c}") - F.col(f"tp{c}"))
              + (F.col(f"sup{c}") - F.col(f"tp{c}"))) for c in range(3)]
    sup = [F.col(f"sup{c}") for c in range(3)]
    n = F.col("n")
    acc = div(F.col("tp0") + F.col("tp1") + F.col("tp2"), n)

    def macro(v):
        return (v[0] + v[1] + v[2]) / F.lit(3.0)

    def weighted(v):
        return F.when(n > 0, ((v[0] * sup[0] + v[1] * sup[1]) + v[2] * sup[2]) / n.cast("double")) \
            .otherwise(F.lit(0.0))

    def row(label, pr, rc, f, s):
        return F.struct(F.lit(label).alias("label"), pr.cast("double").alias("precision"),
                        rc.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        s.cast("bigint").alias("support"))

    rows = [row(CLASS_NAMES[c], prec[c], rec[c], f1[c], sup[c]) for c in range(3)]
    rows += [row("accuracy", F.lit(None), F.lit(None), acc, n),
             row("macro avg", macro(prec), macro(rec), macro(f1), n),
             row("weighted avg", weighted(prec), weighted(rec), weighted(f1), n)]
    return one.select(F.inline(F.array(*rows)))


def _score_groups(pred: DataFrame, y: str) -> DataFrame:
    """(class, score, pos, neg): one row per distinct score of each class."""
    long = pred.select(F.col(y).alias("_y"), F.inline(F.array(
        *[F.struct(F.lit(c).alias("class"), F.col(P[c]).alias("score")) for c in range(3)])))
    return long.groupBy("class", "score").agg(
        F.count(F.when(F.col("_y") == F.col("class"), 1)).alias("pos"),
        F.count(F.when(F.col("_y") != F.col("class"), 1)).alias("neg"))


def _score_buckets(g: DataFrame, rows: int = 4096, cells: int = 1 << 20) -> DataFrame:
    """Adds ``bucket`` to the distinct scores: consecutive ranges of about
    ``rows`` of them per class, in descending order.  The scores are counted
    in fixed value cells (a bounded table, whatever the number of rows) and the
    running count of the cells before gives the bucket, so buckets follow the
    density of the scores and their number the number of rows."""
    g = g.withColumn("_cell", F.floor((F.lit(1.0) - F.col("score")) * F.lit(cells)).cast("long"))
    per = g.groupBy("class", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("class").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("class", "_cell", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(rows))
                     .cast("long").alias("bucket"))
    return g.join(per, ["class", "_cell"]).drop("_cell")


def roc_points(pred: DataFrame, y: str = "outcome") -> DataFrame:
    """EV-4: one-vs-rest ROC points per class: for every distinct score t
    (descending) the counts with score >= t; plus the origin (threshold null).
    Running counts use bucketed prefix sums, so no window spans a whole class."""
    g = _score_groups(pred, y)
    cum = running_totals(_score_buckets(g), ["class"], F.col("bucket"), [F.col("score").desc()], ["pos", "neg"])
    tot = g.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    pts = cum.join(F.broadcast(tot), "class").select(
        "class", F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        "pos", "neg", "P", "N")
    origin = tot.select("class", F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
                        F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("pos"),
                        F.lit(0).cast("bigint").alias("neg"), "P", "N")
    allp = pts.unionByName(origin)
    return allp.select("class", "threshold", "tp", "fp",
                       F.when(F.col("P") > 0, F.col("tp").cast("double") / F.col("P").cast("double")).alias("tpr"),
                       F.when(F.col("N") > 0, F.col("fp").cast("double") / F.col("N").cast("double")).alias("fpr"),
                       "pos", "neg", "P", "N")


def auc(pred: DataFrame, y: str = "outcome") -> DataFrame:
    """EV-5: area under each class's ROC curve.  The trapezoid area equals the
    tie-corrected rank statistic  sum_t pos_t * (2 * neg_below_t + neg_t) / (2PN),
    which is an integer sum, so the result does not depend on summation order."""
    pts = roc_points(pred, y).where(F.col("threshold").isNotNull())
    num = F.sum(F.col("pos") * (F.lit(2) * (F.col("N") - F.col("fp")) + F.col("neg")))
    return pts.groupBy("class").agg(num.alias("_num"), F.max("P").alias("P"), F.max("N").alias("N")).select(
        "class", F.when((F.col("P") > 0) & (F.col("N") > 0),
                        F.col("_num").cast("double") / (F.lit(2.0) * F.col("P") * F.col("N"))).alias("auc"))
