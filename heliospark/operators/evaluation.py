"""Leave-one-interval-out evaluation: folds, scores of groups of features, thresholds, episodes, delays and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import row_mean, row_median, share_there
from .joins import joined
from .statistics import confusion, median, pr_auc_distinct, pr_auc_stable, quantiles, robust_params, roc_auc
from .temporal import order, with_run

QUANTILE, PERSISTENCE, LEAST_SHARE = 0.99, 3, 0.7
#: Intervals, at most: every row is there once for each. More fail.
MOST_FOLDS = 1000
DAY = 1440


def folds(df: DataFrame, interval: str) -> DataFrame:
    """Every row once for each interval as the one left out (fold), with the role it then has. More than MOST_FOLDS intervals fail."""
    names = F.collect_set(interval)
    one = df.select(interval).distinct().agg(F.when(F.size(names) <= MOST_FOLDS, names).otherwise(F.raise_error(F.lit(f"more than {MOST_FOLDS} intervals")).cast("array<string>")).alias("_folds"))
    every = df.join(F.broadcast(one)).withColumn("fold", F.explode("_folds")).drop("_folds")  # one row, of a bounded size
    return every.withColumn("role", F.when(F.col(interval) == F.col("fold"), "test").otherwise("train"))


def _once(df: DataFrame) -> DataFrame:
    """A table with a row a fold, or a few (MOST_FOLDS bounds it), as values: its plan runs now, and not in each branch of what joins it."""
    return F.broadcast(df.sparkSession.createDataFrame(df.collect(), df.schema))


def loo_predictions(df: DataFrame, interval: str, by: str, ts: str, key: str, x: str, target: str) -> DataFrame:
    """Test rows with |z| against the fold's negative training rows, their quantile as threshold, raw and persistent hits."""
    f = folds(df, interval)
    quiet = f.where(f"role = 'train' and {target} = 0")
    params = robust_params(quiet, ["fold"], x)
    score = F.abs((F.col(x) - F.col("center")) / F.col("scale"))
    limit = joined(quiet, params, ["fold"]).groupBy("fold").agg(F.percentile(score, F.lit(QUANTILE)).alias("threshold"))
    test = joined(joined(f.where("role = 'test'"), params, ["fold"]), limit, ["fold"]).withColumn("score", score)
    test = test.withColumn("raw", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    return with_run(test, "raw", by, ts, key).withColumn("predicted", (F.col("run") >= PERSISTENCE).cast("int"))


def group_scores(df: DataFrame, interval: str, target: str, groups: dict[str, list[str]], least: float = LEAST_SHARE) -> DataFrame:
    """folds(df) with a score by group of features, and combined, the mean of those that are there.

    A score is the row's median |z|, null where fewer than that share of the features is there. Centers and scales are of the
    fold's negative training rows, all features' in one pass: values are counted by interval before each count goes to the folds it trains.
    They are found when this is called; by fold they are one small row, sent to all.
    """
    f = folds(df, interval)
    features = sorted({c for g in groups.values() for c in g})
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]))
    counts = df.where(f"{target} = 0").select(interval, each.alias("_v")).groupBy(interval, "_v.feature", "_v.value").agg(F.count(F.lit(1)).alias("_n"))
    names = _once(df.select(F.col(interval).alias("fold")).where(F.col(interval).isNotNull()).distinct())
    tall = counts.join(names, ~F.coalesce(F.col(interval) == F.col("fold"), F.lit(False))).groupBy("fold", "feature", "value").agg(F.sum("_n").alias("_n"))
    params = robust_params(tall, ["fold", "feature"], "value", "_n")
    of = lambda c, part: F.max(F.when(F.col("feature") == c, F.col(part)))
    params = _once(params.groupBy("fold").agg(*(of(c, part).alias(f"_{part}{i}") for i, c in enumerate(features) for part in ("center", "scale"))))
    z = {c: f"_z{i}" for i, c in enumerate(features)}
    out = joined(f, params, ["fold"]).withColumns({z[c]: F.abs((F.col(c) - F.col(f"_center{i}")) / F.col(f"_scale{i}")) for i, c in enumerate(features)})
    scores = {g: F.when(share_there(*[F.col(z[c]) for c in names]) >= least, row_median(*[F.col(z[c]) for c in names])) for g, names in groups.items()}
    out = out.withColumns(scores).withColumn("combined", row_mean(*[F.col(g) for g in groups]))
    return out.drop(*z.values(), *(c for c in params.columns if c != "fold"))


def mode_predictions(scored: DataFrame, by: str, ts: str, key: str, target: str, modes: list[str]) -> DataFrame:
    """Of group_scores, by mode: test rows with score, the threshold of the fold's negative training rows, raw and persistent hits.

    Thresholds are found when this is called, without a group's values in one task.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("score")) for m in modes]))
    tall = scored.select("fold", "role", by, ts, key, target, each.alias("_m")).select("*", "_m.*").drop("_m")
    limit = _once(quantiles(tall.where(f"role = 'train' and {target} = 0"), ["fold", "mode"], "score", {"threshold": QUANTILE}))
    test = joined(tall.where("role = 'test'"), limit, ["fold", "mode"])
    test = test.withColumn("raw", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    return with_run(test, "raw", ["mode", by], ts, key).withColumn("predicted", (F.col("run") >= PERSISTENCE).cast("int")).drop("run", "role")


def model_metrics(predictions: DataFrame, group: str, by: str, ts: str, key: str, target: str, score: str = "score", predicted: str = "predicted", auc: str = "distinct") -> DataFrame:
    """By group (mode, model or fold), over the rows that have a score: records, confusion, precision, recall, f1, areas under both curves, episodes
    a day of negative minutes, detection rate, median delay and missed events. auc: whether precision and recall go by distinct scores or, stable, row by row."""
    p = predictions.where(F.col(score).isNotNull())
    alarms = false_alarm_episodes(p, [group, by], ts, key, target, predicted).groupBy(group).agg(F.sum("episodes").alias("episodes"), F.sum("negative_rows").alias("negative_minutes"))
    events = detection_delay(p, [group, by], ts, target, predicted).where("positive_rows > 0")
    events = events.groupBy(group).agg(F.count(F.lit(1)).alias("positive_events"), F.sum(F.col("detected").cast("long")).alias("detected_events"), median("delay_min").alias("median_delay_min"))
    areas = (pr_auc_distinct(p, target, score, [group]) if auc == "distinct" else pr_auc_stable(p, target, score, by, ts, key, by=[group])).join(roc_auc(p, target, score, [group]), group)
    out = confusion(p, [group], target, predicted).join(areas, group, "left").join(alarms, group, "left").join(events, group, "left")
    per_day = F.try_divide(F.col("episodes"), F.col("negative_minutes") / DAY)
    rate = F.try_divide(F.col("detected_events"), F.col("positive_events"))
    return out.withColumns({"records": F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"), "false_alarms_per_day": per_day, "detection_rate": rate, "missed_events": F.col("positive_events") - F.col("detected_events")})


def mode_summary(predictions: DataFrame, by: str, ts: str, key: str, target: str) -> DataFrame:
    """model_metrics by mode, with scores of all folds pooled as they are and ties in the order of rows."""
    return model_metrics(predictions, "mode", by, ts, key, target, auc="stable")


# The verdicts on what the second group of features adds.
SUPPORT, NO_SUPPORT, MIXED = "EXPLORATORY_SUPPORT_FOR_ADDED_OPDI_INFORMATION", "EXPLORATORY_RESULTS_DO_NOT_SUPPORT_ADDED_OPDI_INFORMATION", "EXPLORATORY_MIXED_EVIDENCE"


def improvements(summary: DataFrame, base: str = "conventional", other: str = "opdi", combined: str = "combined") -> DataFrame:
    """One row: what other and combined have more than base, and the verdict: both f1 and PR-AUC of combined are larger, smaller, or neither."""
    value = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    more = {f"{n}_minus_{base}_{c}": value(m, c) - value(base, c) for n, m, cols in (("opdi", other, ("f1", "pr_auc")), ("combined", combined, ("f1", "pr_auc", "detection_rate", "false_alarms_per_day"))) for c in cols}
    out = summary.agg(*[v.alias(k) for k, v in more.items()])
    f1, auc = F.col(f"combined_minus_{base}_f1"), F.col(f"combined_minus_{base}_pr_auc")
    return out.withColumn("evidence_status", F.when((f1 > 0) & (auc > 0), SUPPORT).when((f1 < 0) & (auc < 0), NO_SUPPORT).otherwise(MIXED))


def ranking(metrics: DataFrame, model: str = "model", first: str = "pr_auc") -> DataFrame:
    """Models with their place by an area and then f1; without a value last. As many rows as models."""
    return metrics.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last(first), F.desc_nulls_last("f1"), model)))


def leakage_checks(df: DataFrame, interval: str, target: str) -> DataFrame:
    """By interval that is left out: its rows, the training rows of both classes, and whether it can be tested so. Fails with fewer than three intervals.

    Training rows are all rows less the interval's own: nothing is copied for each fold.
    """
    own = df.where(F.col(interval).isNotNull()).groupBy(interval).agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) == 0).alias("_n"))
    if own.limit(3).count() < 3:
        raise ValueError("at least three intervals are needed")
    whole = own.agg(F.sum("_p").alias("_all_p"), F.sum("_n").alias("_all_n"))
    out = own.join(F.broadcast(whole)).select(F.col(interval).alias("fold"), "test_rows", (F.col("_all_p") - F.col("_p")).alias("train_positive_rows"), (F.col("_all_n") - F.col("_n")).alias("train_negative_rows"))
    return out.withColumn("usable", (F.col("train_positive_rows") > 0) & (F.col("train_negative_rows") > 0))


def false_alarm_episodes(df: DataFrame, by: str | list[str], ts: str, key: str, target: str, predicted: str) -> DataFrame:
    """Rising edges among the negative rows alone."""
    w = order(by, ts, key)
    d = df.where(f"{target} = 0").withColumn("_e", (F.col(predicted) == 1) & (F.lag(predicted, 1, 0).over(w) == 0))
    return d.groupBy(by).agg(F.count_if("_e").alias("episodes"), F.count(F.lit(1)).alias("negative_rows"))


def detection_delay(df: DataFrame, by: str | list[str], ts: str, target: str, predicted: str) -> DataFrame:
    """By event: its first positive row if that is later than its first row (a positive window's start is no onset), the first hit, and the delay to the first one from the onset on."""
    by = [by] if isinstance(by, str) else by
    first = Window.partitionBy(*by)
    d = df.withColumn("_onset", F.min(F.when(F.col(target) == 1, F.col(ts))).over(first))
    hit = F.col(predicted) == 1
    out = d.groupBy(*by).agg(F.min(ts).alias("_start"), F.first("_onset").alias("onset"), F.max(predicted).alias("detected"), F.min(F.when(hit, F.col(ts))).alias("detected_at"), F.count_if(F.col(target) == 1).alias("positive_rows"), F.min(F.when((F.col(predicted) == 1) & (F.col(ts) >= F.col("_onset")), F.col(ts))).alias("first_hit"))
    internal = F.coalesce(F.col("onset") > F.col("_start"), F.lit(False))
    delay = (F.unix_micros(F.col("first_hit").cast("timestamp")) - F.unix_micros(F.col("onset").cast("timestamp"))) / 60e6
    status = F.when(internal, "INTERNAL_LABELED_BOUNDARY").when(F.col("onset").isNotNull(), "WINDOW_START_NOT_EXACT_ONSET")
    return out.select(*by, F.when(internal, F.col("onset")).alias("onset"), internal.alias("internal_onset"), status.alias("onset_status"), "detected", "detected_at", "positive_rows", F.when(internal, delay).alias("delay_min"))
