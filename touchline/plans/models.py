"""Model jobs (ML-3..ML-13, UQ-9).

* importance ranking with a fully grown 100-tree forest, top-k features (ML-3, SL-4);
* three voting members: a class-balanced, fully grown random forest (ML-4), boosted
  trees on softmax gradients (ML-5) and boosted symmetric trees with ordered
  statistics (ML-6), all grown by ``touchline.learners``;
* equal-weight soft vote (ML-8), k-fold CV accuracy (ML-9), search over the 12
  published parameters (ML-10) with a resumable ledger (ML-13), refit (ML-11);
* save / load of the fitted members and the kept-feature list (SNK-2, SNK-3);
* batch scoring of a fixtures table (UQ-9).

Fits are Spark jobs with a task per fit (or per part of a forest) and use all
rows they are given.  Beyond ``TASK_ROWS`` rows the work of a fit is dealt over
tasks, and its forest, which grows with the rows, is a table; otherwise the
driver holds the fitted model of a vote.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline.functions.columns import label_text, pct_text
from touchline.functions.ship import ensure_package
from touchline.learners import codes as cd
from touchline.learners import fit as ft
from touchline.learners import held as hm
from touchline.learners import large
from touchline.learners import members as mb
from touchline.learners import search as se
from touchline.learners.members import INT_RANGES, MEMBERS, REAL_RANGES, VoteParams
from touchline.plans.evaluate import P, argmax3
from touchline.plans.prep import portable_hash
from touchline.schema import TOP_K_FEATURES
from touchline.session import scratch_path

LABEL = "outcome"
TRIALS = 50
FOLDS = 5
STARTUP = 10  # trials that are uniform draws; the others follow from results
TREES_A_TASK = 16
TASK_ROWS = 200_000  # rows that a fit may hold in a task
TREE_ROWS = 100_000  # rows of a node that a task grows to the end, if there are more than that


def _coded(train: DataFrame, features: list[str], cuts: np.ndarray) -> DataFrame:
    """``key, outcome, codes`` of each row."""
    ensure_package(train.sparkSession)
    key = F.col("match_id").cast("long") if "match_id" in train.columns else F.xxhash64(*features)
    rows = train.select(key.alias("key"), F.col(LABEL).cast("int").alias(LABEL), *features)
    return cd.with_codes(rows, features, cuts, ["key", LABEL])


def _coded_sample(train: DataFrame, features: list[str], cuts: np.ndarray) -> ft.Sample:
    """Codes of all rows of ``train`` on the driver; callers bound the rows."""
    return ft.Sample.of(_coded(train, features, cuts), len(features))


def _written_codes(train: DataFrame, features: list[str], cuts: np.ndarray) -> DataFrame:
    """``key, outcome, codes`` of all rows as a table, which a fit reads many times."""
    path = scratch_path(train.sparkSession, "coded-rows")
    _coded(train, features, cuts).write.parquet(path)
    return train.sparkSession.read.parquet(path)


def _class_counts(train: DataFrame) -> dict[int, int]:
    return {r[LABEL]: r["n"] for r in train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n")).collect()}


# ---------------------------------------------------------------- ML-3
def feature_importance(train: DataFrame, features: list[str], num_trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, importance) of a random forest whose trees are grown fully:
    the decrease of impurity by feature, as a share of each tree's, averaged
    over the trees.  Tasks grow a part of the trees each; a value per feature
    and part is added up by Spark.  More than ``TASK_ROWS`` rows stay in many
    tasks (``learners.large``)."""
    spark = train.sparkSession
    cuts = cd.cut_points(train, features)
    p = VoteParams(tree_n_estimators=num_trees, tree_max_depth=1 << 20, tree_min_samples_split=2, tree_min_samples_leaf=1, seed=seed)
    counts = _class_counts(train)
    n = sum(counts.values())
    if n > TASK_ROWS:
        rows = _written_codes(train, features, cuts)
        fitted = spark.read.parquet(large.forest_table(rows, len(features), p, n, counts, TREE_ROWS))
    else:
        sample = spark.sparkContext.broadcast(_coded_sample(train, features, cuts))
        fitted = ft.fitted(spark, sample, [j for j in ft.jobs_of(0, ft.NO_FOLD, p, 8) if j.member == "tree"])
    parts = fitted.select(F.posexplode("importance").alias("at", "share"))
    total = parts.groupBy("at").agg((F.sum(F.round("share", 12).cast("decimal(30,12)")).cast("double") / num_trees).alias("importance"))
    names = spark.createDataFrame(list(enumerate(features)), "at int, feature string")  # one row per feature
    return names.join(total, "at", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def top_features(importance: DataFrame, k: int = TOP_K_FEATURES) -> DataFrame:
    """SL-4 / SL-5: the k most important features, with their rank."""
    order = [F.col("importance").desc(), F.col("feature")]
    # ranks k rows (one per kept feature), so the global window stays tiny
    return importance.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def importance_report(importance: DataFrame, n: int = 20) -> DataFrame:
    """SL-5 / EV-7: the n most important features, listed in ascending order
    of importance (the order of a horizontal bar chart), with the share in
    percent."""
    top = importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(n)
    return top.select("feature", "importance", (F.col("importance") * 100).alias("importance_pct")) \
        .orderBy(F.col("importance").asc(), F.col("feature").desc())


# ---------------------------------------------------------------- members
def trial_parameters(spark: SparkSession, trials: int = TRIALS, seed: int = 42) -> DataFrame:
    """ML-10: seeded uniform draws over the published ranges, one row per
    trial; plain integer arithmetic, so any engine draws alike.  A search
    starts with the first of them."""
    t = spark.range(trials).select(F.col("id").cast("int").alias("trial"))
    names = [*INT_RANGES, *REAL_RANGES]
    cols = []
    for i, name in enumerate(names):
        h = portable_hash(F.col("trial").cast("long") * len(names) + i, seed)
        if name in INT_RANGES:
            lo, hi = INT_RANGES[name]
            cols.append((F.lit(lo) + F.floor(h / 256) % (hi - lo + 1)).cast("int").alias(name))
        else:
            lo, hi = REAL_RANGES[name]
            cols.append((F.lit(lo) + h.cast("double") / 2147483648.0 * (hi - lo)).alias(name))
    return t.select("trial", *cols)


@dataclass
class VoteModel:
    features: list
    cuts: np.ndarray
    members: dict
    params: VoteParams

    def member_probs(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Adds p_tree_*, p_xgb_*, p_cat_* (class 0/1/2) to the columns ``keep`` of ``df``
        (default: all); null features count as 0 (PF-15)."""
        spark = df.sparkSession
        ensure_package(spark)
        # a Python worker holds one group of members at a time, with what they lay out for scoring
        held = hm.HeldMembers.of(spark, self.members)
        kept = df.select(*[F.col(f"`{c}`") for c in (df.columns if keep is None else keep)])
        names = [f"c{i}" for i in range(len(kept.columns))]
        out = [f"p_{m}_{c}" for m in MEMBERS for c in range(mb.CLASSES)]
        x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(self.features)]
        cuts = self.cuts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def coded() -> Iterator[tuple[list, np.ndarray]]:
                for b in batches:
                    values = np.stack([b.column(len(names) + j).to_numpy(zero_copy_only=False) for j in range(len(cuts))])
                    yield b.columns[:len(names)], cd.encode(values.T, cuts)

            for own, probs in held.scored(coded()):
                cols = [pa.array(np.ascontiguousarray(probs[m][:, c])) for m in MEMBERS for c in range(mb.CLASSES)]
                yield pa.RecordBatch.from_arrays([*own, *cols], names=[*names, *out])

        work = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept.columns, names, strict=True)], *x)
        schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept.schema.fields, strict=True)]
                           + [f"{o} double" for o in out])
        got = work.mapInArrow(run, schema)
        return got.toDF(*kept.columns, *out)

    def transform(self, df: DataFrame, members: bool = True, keep: list[str] | None = None) -> DataFrame:
        """Soft vote: mean of the three members, arg-max class, next to the columns
        ``keep`` of ``df`` (default: all).  With ``members=False`` the rows carry the
        members' columns already."""
        keep = df.columns if keep is None else keep
        x = self.member_probs(df, keep) if members else df
        probs = [((F.col(f"p_tree_{c}") + F.col(f"p_xgb_{c}") + F.col(f"p_cat_{c}")) / 3.0).alias(P[c])
                 for c in range(3)]
        out = x.select(*keep, *probs)
        return out.withColumn("predicted", argmax3(*[F.col(p) for p in P]))

    def save(self, path: str) -> None:
        """SNK-3 / SNK-2: members as one row each, the feature list with its cut
        points as a table, the parameters as JSON next to them."""
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        held = {m: x for m, x in self.members.items() if not isinstance(x, mb.StoredForest)}
        spark.createDataFrame([(m, bytearray(mb.to_bytes(x))) for m, x in held.items()], "member string, blob binary") \
            .write.mode("overwrite").parquet(f"{path}/members")
        stored = [x for x in self.members.values() if isinstance(x, mb.StoredForest)]
        forest = spark.read.parquet(stored[0].path) if stored else spark.createDataFrame([], "part int, blob binary")
        forest.select("part", "blob").write.mode("overwrite").parquet(f"{path}/forest")  # a row per tree, if it is a table
        save_feature_list(spark, self.features, f"{path}/features")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.cuts)], "ord int, cuts array<double>") \
            .write.mode("overwrite").parquet(f"{path}/cuts")
        spark.createDataFrame([(json.dumps(self.params.plain()),)], "params string") \
            .write.mode("overwrite").json(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "VoteModel":
        feats = load_feature_list(spark, f"{path}/features")
        cuts = np.array([r["cuts"] for r in spark.read.parquet(f"{path}/cuts").orderBy("ord").collect()])
        members = {r["member"]: mb.from_bytes(bytes(r["blob"])) for r in spark.read.parquet(f"{path}/members").collect()}
        if "tree" not in members:
            members["tree"] = mb.StoredForest(f"{path}/forest")
        return VoteModel(feats, cuts, members, VoteParams(**json.loads(spark.read.json(f"{path}/params").first()["params"])))


def save_feature_list(spark: SparkSession, features: list[str], path: str) -> None:
    spark.createDataFrame([(i, f) for i, f in enumerate(features)], "ord int, feature string") \
        .write.mode("overwrite").parquet(path)


def load_feature_list(spark: SparkSession, path: str) -> list[str]:
    return [r.feature for r in spark.read.parquet(path).orderBy("ord").collect()]


def fit_vote(train: DataFrame, features: list[str], params: VoteParams | None = None) -> VoteModel:
    """Fit the three members on the same rows (ML-4..ML-6, ML-11).  Up to
    ``TASK_ROWS`` rows: a task for each booster and for every few trees of the
    forest.  More: the rows stay in many tasks (``learners.large``)."""
    p = params or VoteParams()
    spark = train.sparkSession
    cuts = cd.cut_points(train, features)
    counts = _class_counts(train)
    n = sum(counts.values())
    if n > TASK_ROWS:
        rows = _written_codes(train, features, cuts)
        return VoteModel(list(features), cuts, large.fit_members(rows, len(features), p, n, counts, TREE_ROWS), p)
    sample = spark.sparkContext.broadcast(_coded_sample(train, features, cuts))
    rows = ft.fitted(spark, sample, ft.jobs_of(0, ft.NO_FOLD, p, TREES_A_TASK)).select("member", "part", "blob").collect()
    return VoteModel(list(features), cuts, ft.member_of([r.asDict() for r in rows]), p)


def member_predictions(model: VoteModel, df: DataFrame, member: str) -> DataFrame:
    """Predicted class and probabilities of one member ('tree' | 'xgb' | 'cat')."""
    x = model.member_probs(df)
    probs = [F.col(f"p_{member}_{c}").alias(P[c]) for c in range(3)]
    out = x.select(*df.columns, *probs)
    return out.withColumn("predicted", argmax3(*[F.col(p) for p in P]))


# ---------------------------------------------------------------- ML-9, ML-10
def cv_accuracy(train_with_folds: DataFrame, features: list[str], params: VoteParams, k: int | None = None,
                fit_rows: int | None = None) -> float:
    """Mean held-out accuracy over the folds of column ``fold``.  All fits are
    one job, up to ``TASK_ROWS`` rows; each fold is scored on all its rows.  A
    fit uses all rows outside its fold, unless ``fit_rows`` bounds them."""
    folds = k or train_with_folds.agg(F.max("fold")).first()[0] + 1
    work = ft.Folds.of(train_with_folds, features, folds, fit_rows, task_rows=TASK_ROWS, node_rows=TREE_ROWS)
    got = work.scores([(0, f, params) for f in range(folds)]).collect()  # one row per fold
    return float(sum(r["correct"] / r["n"] if r["n"] else 0.0 for r in got) / folds)


def search_trials(train_with_folds: DataFrame, features: list[str], trials: int = TRIALS, folds: int = FOLDS, seed: int = 42,
                  fit_rows: int | None = None, ledger: str | None = None, batch: int = 20, bins: int = 32) -> DataFrame:
    """ML-10: ``trial, params, cv_accuracy`` of a search over the published
    ranges (ML-13): the first trials are the uniform draws of
    :func:`trial_parameters`, the others proposed from the results so far.
    ``ledger`` names a folder of results to go on with; ``bins`` is how many
    codes of a feature the boosters of the search tell apart."""
    spark = train_with_folds.sparkSession
    work = ft.Folds.of(train_with_folds, features, folds, fit_rows, task_rows=TASK_ROWS, node_rows=TREE_ROWS)
    draws = [VoteParams.of(r) for r in trial_parameters(spark, min(trials, STARTUP), seed).orderBy("trial").collect()]

    def scores(votes: list[tuple[int, int, VoteParams]]) -> DataFrame:
        return work.scores([(t, f, replace(p, bins=bins)) for t, f, p in votes])

    done = se.search(se.Ledger.at(spark, ledger), scores, draws, folds, trials, seed, batch)
    return spark.createDataFrame([(t, json.dumps(p.plain()), a) for t, p, a in done],  # a row per trial
                                 "trial int, params string, cv_accuracy double")


def best_trial(trials: DataFrame) -> DataFrame:
    return trials.orderBy(F.col("cv_accuracy").desc(), F.col("trial")).limit(1)


def params_of(trial_row) -> VoteParams:
    return VoteParams(**json.loads(trial_row["params"]))


# ---------------------------------------------------------------- UQ-9
def score_fixtures(model: VoteModel, fixture_feats: DataFrame, keep: list[str]) -> DataFrame:
    """Batch prediction: class, its text, and the three probabilities as
    numbers and as percent text."""
    out = model.transform(fixture_feats, keep=keep)  # the features stay with the model: only ``keep`` comes back
    return out.select(*keep, "predicted", label_text("predicted").alias("prediction"), *P,
                      *[pct_text(p).alias(f"{p}_text") for p in P])


def log_loss(pred: DataFrame, y: str = LABEL) -> DataFrame:
    """Mean multiclass log loss of p_home/p_draw/p_away (clipped at 1e-15)."""
    p = F.when(F.col(y) == 0, F.col(P[0])).when(F.col(y) == 1, F.col(P[1])).otherwise(F.col(P[2]))
    return pred.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("log_loss"))


__all__ = ["feature_importance", "top_features", "VoteParams", "VoteModel", "fit_vote", "member_predictions", "cv_accuracy",
           "search_trials", "trial_parameters", "best_trial", "score_fixtures", "save_feature_list", "load_feature_list",
           "log_loss"]
