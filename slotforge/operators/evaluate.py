"""Splits, metrics, calibration and model checks on tables."""

from __future__ import annotations

import random

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotforge.operators.ordering import global_rank, rank_within
from slotforge.storage import pin


def walk_forward(ranked: DataFrame, n: int, folds: int = 5, gap: int = 5, rank: str = "rank") -> DataFrame:
    """A row for each fold that uses it: fold k tests [n-(folds-k)*t, +t) with t = n // (folds+1), trains before less the gap."""
    t = n // (folds + 1)
    starts = [(k, n - (folds - k) * t) for k in range(folds)]
    r = F.col(rank)
    uses = [F.when((r >= a) & (r < a + t), F.struct(F.lit(k).alias("fold"), F.lit("test").alias("role"))).when(r < a - gap, F.struct(F.lit(k).alias("fold"), F.lit("train").alias("role"))) for k, a in starts]
    return ranked.select("*", F.explode(F.array_compact(F.array(*uses))).alias("_u")).select(*ranked.columns, "_u.fold", "_u.role")


def holdout(ranked: DataFrame, n: int, share: float = 0.1, embargo: int = 12, rank: str = "rank") -> DataFrame:
    """Adds role: the last share is test, the rows just before it are in the embargo, the rest train."""
    cut = n - int(n * share)
    r = F.col(rank)
    return ranked.withColumn("role", F.when(r >= cut, "test").when(r >= cut - embargo, "embargo").otherwise("train"))


def stratified_folds(df: DataFrame, label: str, key: Column, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold: each label's rows are shuffled by a digest of the key and dealt out in turn, so that a label's counts
    differ by one at most between folds. Rows without a label are left out."""
    mixed = df.where(F.col(label).isNotNull()).withColumn("_mix", F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))).cast("binary")))
    ranked = rank_within(mixed, label, "_mix", name="_r")
    return ranked.select(*df.columns, (F.col("_r") % folds).cast("int").alias("fold"))


def auc(df: DataFrame, score: str, label: str, *by: str) -> DataFrame:
    """ROC AUC by average ranks: positives and negatives are summed for each score before any order is made.

    Scores are cut into ranges that are written once; ranks run inside a range, and each range begins with what lies
    before it (one row for each range and group).
    """
    g = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_n"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = pin(g.repartitionByRange(n, *by, score).withColumn("_part", F.spark_partition_id()), "scores")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy("_part", *by).agg(F.sum("_n").alias("_s")).select("_part", *by, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_a"))
    inside = Window.partitionBy("_part", *by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    r = cut.join(ahead, ["_part", *by]).withColumn("_rank", F.col("_a") + F.coalesce(F.sum("_n").over(inside), F.lit(0)) + (F.col("_n") + 1) / 2)
    n1, n0 = F.sum("_p"), F.sum(F.col("_n") - F.col("_p"))
    return r.groupBy(*by).agg(F.when((n1 > 0) & (n0 > 0), (F.sum(F.col("_p") * F.col("_rank")) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def losses(score: str, label: str) -> list[Column]:
    """Brier score, accuracy (0.5 itself counts as 0) and log loss."""
    p, y = F.col(score), F.col(label)
    q = F.greatest(F.least(p, F.lit(1 - 1e-15)), F.lit(1e-15))
    return [
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(((p > 0.5).cast("int") == y).cast("int")).alias("accuracy"),
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"),
    ]


def metrics(df: DataFrame, score: str = "p", label: str = "target", by: str = "fold") -> DataFrame:
    return auc(df, score, label, by).join(df.groupBy(by).agg(F.count("*").alias("n"), *losses(score, label)), by)


def fold_summary(m: DataFrame) -> DataFrame:
    names = ("auc", "brier", "accuracy", "log_loss")
    return m.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop))))


BINS = ((0.0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 0.85), (0.85, 1.0))


def calibration(df: DataFrame, score: str = "p", label: str = "target", bins: tuple = BINS, least: int = 10) -> DataFrame:
    """Predicted mean against actual rate of each bin that has enough rows."""
    b = F.coalesce(*(F.when((F.col(score) >= lo) & (F.col(score) < hi), k) for k, (lo, hi) in enumerate(bins)))
    g = df.withColumn("bin", b).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), F.avg(label).alias("actual"))
    return g.where(F.col("n") >= least).withColumn("delta", F.abs(F.col("predicted") - F.col("actual")))


def gbt(features: list[str], label: str = "target", depth: int = 3, rounds: int = 15, step: float = 0.1, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=step, seed=seed)])


def logistic(features: list[str], label: str = "target") -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01)])


def predict(model, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def screen(folds: DataFrame, features: list[str], top: int, n_folds: int) -> list[tuple[str, float]]:
    """Importance averaged over the training part of each fold, the ``top`` largest."""
    total = dict.fromkeys(features, 0.0)
    for k in range(n_folds):
        for name, value in importances(gbt(features, rounds=5).fit(folds.where((F.col("fold") == k) & (F.col("role") == "train"))), features):
            total[name] += value / n_folds
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]


def evaluate_folds(folds: DataFrame, features: list[str], n_folds: int, **params) -> DataFrame:
    """Out-of-fold predictions of every fold."""
    out = None
    for k in range(n_folds):
        part = folds.where(F.col("fold") == k)
        p = predict(gbt(features, **params).fit(part.where("role = 'train'")), part.where("role = 'test'"))
        out = p if out is None else out.unionByName(p)
    return out


def search(folds: DataFrame, features: list[str], n_folds: int, trials: int, seed: int = 42) -> list[tuple[float, dict]]:
    """Random search by mean fold AUC less half its deviation."""
    draw, tried = random.Random(seed), []
    for _ in range(trials):
        params = {"depth": draw.choice((2, 3, 4)), "rounds": draw.choice((5, 10, 15)), "step": draw.choice((0.05, 0.1, 0.2))}
        m = fold_summary(metrics(evaluate_folds(folds, features, n_folds, **params))).first()
        tried.append((m.auc_mean - 0.5 * m.auc_std, params))
    return sorted(tried, key=lambda x: -x[0])


def sweep(folds: DataFrame, sets: dict[str, list[str]], n_folds: int, **params) -> list[tuple[str, int, float]]:
    """Mean fold AUC of each named feature set, best first: feature counts, ablations."""
    tried = [(name, len(f), fold_summary(metrics(evaluate_folds(folds, f, n_folds, **params))).first().auc_mean) for name, f in sets.items()]
    return sorted(tried, key=lambda x: -x[2])


def usable(model_metrics: DataFrame, least_auc: float = 0.65) -> DataFrame:
    """Models that meet the minimum bar: AUC and at least one feature."""
    return model_metrics.where((F.col("auc") >= least_auc) & (F.col("n_features") > 0))


def calibrated(train: DataFrame, test: DataFrame, features: list[str], parts: int = 3, label: str = "target") -> DataFrame:
    """Mean of ``parts`` isotonic maps, each fitted on the part its model hasn't seen."""
    dealt = stratified_folds(train, label, F.col("slot_ts"), parts)
    scored = test
    for k in range(parts):
        model = gbt(features, label).fit(dealt.where(F.col("fold") != k))
        held = predict(model, dealt.where(F.col("fold") == k), "_s").select(F.col("_s"), F.col(label).cast("double").alias("_y"))
        iso = IsotonicRegression(featuresCol="_s", labelCol="_y", predictionCol=f"_p{k}").fit(held)
        scored = iso.transform(predict(model, scored, "_s")).drop("_s")
    return scored.withColumn("p", sum((F.col(f"_p{k}") for k in range(parts)), F.lit(0.0)) / parts).drop(*(f"_p{k}" for k in range(parts)))


def blend(first: str, second: str, weight: float = 0.65) -> Column:
    return F.lit(weight) * F.col(first) + F.lit(1 - weight) * F.col(second)


def adversarial_auc(train: DataFrame, test: DataFrame, features: list[str]) -> float:
    """AUC of telling test rows from training rows; near one half when they look alike."""
    both = train.select(*features, F.lit(0).alias("_t")).unionByName(test.select(*features, F.lit(1).alias("_t")))
    dealt = both.withColumn("_u", F.rand(42))
    scored = predict(gbt(features, "_t", rounds=5).fit(dealt.where("_u < 0.7")), dealt.where("_u >= 0.7"))
    return auc(scored, "p", "_t").first().auc


def with_noise(df: DataFrame, columns: int = 5) -> DataFrame:
    return df.withColumns({f"noise_{k}": F.randn(k) for k in range(columns)})


def shuffled(rank: Column, n: int, key: Column, rounds: int = 4) -> Column:
    """A keyed one-to-one map of 0..n-1 onto itself, without a sort: a Feistel network on a square of side s, s*s >= n.

    A place outside is mapped on until it is inside. Fewer than 2*sqrt(n) places lie outside, so 16 steps are enough; a
    row that isn't inside by then is an error.
    """
    side = int(np.ceil(np.sqrt(max(1, n))))

    def network(x: Column) -> Column:
        half = F.struct(F.floor(x / side).cast("long").alias("a"), (x % side).alias("b"))
        mixed = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), half, lambda h, k: F.struct(h["b"].alias("a"), F.pmod(h["a"] + F.pmod(F.xxhash64(key, k, h["b"]), F.lit(side)), F.lit(side)).alias("b")))
        return F.transform(F.array(mixed), lambda h: h["a"] * side + h["b"])[0]

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(16)), F.lit(-1).cast("long"), lambda x, k: F.when((k > 1) & (x < n), x).otherwise(network(F.when(k == 1, rank.cast("long")).otherwise(x))))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a row has left its range")).cast("long"))


def permutation_importance(model, df: DataFrame, features: list[str], label: str = "target", order: str = "slot_ts", harmful: float = -0.005) -> DataFrame:
    """feature, auc_drop, harmful: the AUC lost on ``df`` when one column is dealt to other rows, for all features at once.

    Each feature has its own one-to-one map of ranks; all moved values meet their new rows in one join, and one pass of
    the model scores every row once as it is and once for each feature.
    """
    ranked = global_rank(df.select(order, label, *features), order, name="_r")
    n = ranked.count()
    moved = ranked.select(F.explode(F.array(*(F.struct(F.lit(k).alias("f"), shuffled(F.col("_r"), n, F.lit(k + 1)).alias("to"), F.col(c).cast("double").alias("v")) for k, c in enumerate(features)))).alias("m"))
    dealt = moved.groupBy(F.col("m.to").alias("_r")).agg(*(F.max(F.when(F.col("m.f") == k, F.col("m.v"))).alias(f"_m{k}") for k in range(len(features))))
    both = ranked.join(dealt, "_r")
    cases = [F.struct(F.lit(-1).alias("case"), *(F.col(c).cast("double").alias(c) for c in features))]
    cases += [F.struct(F.lit(k).alias("case"), *(F.col(f"_m{j}" if j == k else c).cast("double").alias(c) for j, c in enumerate(features))) for k in range(len(features))]
    scored = predict(model, both.select(label, F.explode(F.array(*cases)).alias("x")).select(label, "x.*")).select("case", label, "p")
    by_case = pin(auc(scored, "p", label, "case"), "permuted")
    base = by_case.where("case = -1").select(F.col("auc").alias("base"))
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "case int, feature string")
    drops = by_case.join(F.broadcast(names), "case").crossJoin(F.broadcast(base))  # a row for each feature, and one row
    return drops.select("feature", (F.col("base") - F.col("auc")).alias("auc_drop"), (F.col("base") - F.col("auc") < harmful).alias("harmful"))


def early_stopped(features: list[str], label: str, validation: str, rounds: int = 30, tolerance: float = 0.005, depth: int = 3, step: float = 0.1, seed: int = 42) -> Pipeline:
    """Boosted trees that stop once the rows marked ``validation`` gain less than ``tolerance``; the model has the trees used."""
    boosted = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=step, seed=seed, validationIndicatorCol=validation, validationTol=tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"), boosted])


def cross_validated(df: DataFrame, features: list[str], label: str, key: Column, folds: int = 5, **params) -> tuple[DataFrame, list[int]]:
    """Out-of-fold predictions of stratified folds, each model stopped early by its own fold, and the rounds each used."""
    dealt = pin(stratified_folds(df, label, key, folds), "folds")
    out, used = None, []
    for k in range(folds):
        marked = dealt.withColumn("_held", F.col("fold") == k)
        model = early_stopped(features, label, "_held", **params).fit(marked)
        used.append(model.stages[-1].getNumTrees)
        p = predict(model, marked.where("_held")).drop("_held")
        out = p if out is None else out.unionByName(p)
    return out, used


def directional_probes(spark: SparkSession, model, features: list[str], neutral: dict[str, float], up: dict[str, float], down: dict[str, float], least_up: float = 0.40) -> DataFrame:
    """Three made rows that a sound model puts in order. probe, p, passes: Up above neutral above Down, and the Up row
    at ``least_up`` or more. Features that a probe doesn't name keep their neutral value, 0 where there is none."""
    named = (("up", up), ("neutral", {}), ("down", down))
    rows = spark.createDataFrame([(name, *(float({**neutral, **own}.get(f, 0.0)) for f in features)) for name, own in named], "probe string, " + ", ".join(f"`{f}` double" for f in features))
    p = predict(model, rows).select("probe", "p")
    of = lambda name: F.max(F.when(F.col("probe") == name, F.col("p")))
    verdict = p.agg(((of("up") > of("neutral")) & (of("neutral") > of("down")) & (of("up") >= least_up)).alias("passes"))
    return p.crossJoin(F.broadcast(verdict))  # three rows with one


def overfit_checks(measured: DataFrame, top: int) -> DataFrame:
    """check, verdict from one row of adversarial_auc, noise_rank (best rank of a noise column, from 1), auc_drop,
    fold_std, n_trades, pnl. A check whose measure is null is skipped, as is the profit of no trades."""
    rules = {
        "adversarial_auc": F.when(F.col("adversarial_auc") <= 0.65, "PASS").when(F.col("adversarial_auc").isNotNull(), "WARN"),
        "noise_rank": F.when(F.col("noise_rank") > top, "PASS").when(F.col("noise_rank").isNotNull(), "FAIL"),
        "auc_drop": F.when(F.col("auc_drop") <= 0.03, "PASS").when(F.col("auc_drop").isNotNull(), "WARN"),
        "fold_stability": F.when(F.col("fold_std") <= 0.05, "PASS").when(F.col("fold_std").isNotNull(), "WARN"),
        "trading_pnl": F.when(F.col("n_trades") > 0, F.when(F.col("pnl") > 0, "PASS").otherwise("FAIL")),
    }
    return measured.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit("SKIP")).alias("verdict")) for k, v in rules.items()))).alias("r")).select("r.*")


def promotion(champion: dict[str, float], challenger: dict[str, float], needed: int = 2) -> bool:
    """AUC up, Brier down, accuracy up: enough of the three, or a tie with fewer features."""
    better = (challenger["auc"] > champion["auc"]) + (challenger["brier"] < champion["brier"]) + (challenger["accuracy"] > champion["accuracy"])
    same = all(challenger[k] == champion[k] for k in ("auc", "brier", "accuracy"))
    return better >= needed or (same and challenger["n_features"] < champion["n_features"])


def promotion_table(measured: DataFrame, champion: str, needed: int = 2) -> DataFrame:
    """name, auc, brier, accuracy, n_features of models to how many of the three each gains on the champion, whether that
    is enough (or a tie with fewer features), and the one to promote: most gains, then fewest features, then highest AUC.
    """
    held = measured.where(F.col("name") == champion).select(*(F.col(c).alias(f"_{c}") for c in ("auc", "brier", "accuracy", "n_features")))
    rows = measured.where(F.col("name") != champion).crossJoin(F.broadcast(held))  # one champion
    gains = (F.col("auc") > F.col("_auc")).cast("int") + (F.col("brier") < F.col("_brier")).cast("int") + (F.col("accuracy") > F.col("_accuracy")).cast("int")
    tie = (F.col("auc") == F.col("_auc")) & (F.col("brier") == F.col("_brier")) & (F.col("accuracy") == F.col("_accuracy")) & (F.col("n_features") < F.col("_n_features"))
    scored = rows.select("name", "auc", "brier", "accuracy", "n_features", gains.alias("gains"), ((gains >= needed) | tie).alias("passes"))
    best = scored.where("passes").agg(F.max_by("name", F.struct("gains", -F.col("n_features"), "auc", "name")).alias("best"))
    return scored.crossJoin(F.broadcast(best)).withColumn("promoted", F.coalesce(F.col("name") == F.col("best"), F.lit(False))).drop("best")  # one row


def scorecard(spark: SparkSession, checks: dict[str, tuple[float, float, float]]) -> DataFrame:
    """name: (value, warn, fail): PASS below warn, WARN below fail, else FAIL."""
    rows = spark.createDataFrame([(k, *v) for k, v in checks.items()], "check string, value double, warn double, fail double")
    return rows.withColumn("verdict", F.when(F.col("value") < F.col("warn"), "PASS").when(F.col("value") < F.col("fail"), "WARN").otherwise("FAIL"))
