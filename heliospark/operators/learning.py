"""Supervised baselines, two of Spark ML and a forest of trees grown in tasks: exact median imputation, scaling, class balance, every interval held out once.

Boosting only asks in which of maxBins bins a value is. So rows of equal bins and label are added up once, and its many passes read those sums.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluation import model_metrics, ranking
from .labels import require_columns
from .statistics import quantiles
from .temporal import with_run
from .trees import Forest, fit_forest

# The baselines' settings.
SEED, THRESHOLD, PERSISTENCE = 42, 0.5, 3
LOGISTIC = {"maxIter": 2500, "elasticNetParam": 0.0}
FOREST = {"trees": 200, "leaf": 5}
BOOSTED = {"maxIter": 120, "stepSize": 0.06, "maxDepth": 4, "maxBins": 255, "minInstancesPerNode": 20}
#: Intervals whose models are fitted at a time: most of their many jobs are too short to keep all cores busy.
AT_ONCE = 4
#: Rows of a task of boosting, about; error of the ranks that part its bins, as a share of all rows.
TASK_ROWS, RANK_ERROR = 100_000, 1e-4


def selection(df: DataFrame, features: list[str], least: float = 0.7) -> DataFrame:
    """By feature: share of rows that have it, distinct values, and whether and why it is kept. One pass for all."""
    wide = df.agg(*[F.struct(F.avg(F.col(c).isNotNull().cast("double")).alias("available"), F.count_distinct(c).alias("n_unique"), F.lit(c).alias("feature")).alias(c) for c in features])
    rows = wide.select(F.explode(F.array(*features)).alias("f")).select("f.feature", "f.available", "f.n_unique")
    return rows.withColumn("reason", F.when(F.col("available") < least, "LOW_AVAILABILITY").when(F.col("n_unique") <= 1, "CONSTANT_OR_EMPTY").otherwise("SELECTED"))


def medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """The training rows' exact medians, 0 without any value. No task holds a feature's values."""
    each = [quantiles(train.select(F.col(f"`{c}`").cast("double").alias("_v")), [], "_v", {"_m": 0.5}).withColumn("_i", F.lit(i)) for i, c in enumerate(features)]
    mid = {r["_i"]: r["_m"] for r in reduce(DataFrame.unionByName, each).collect()}
    return {c: float(mid[i] or 0.0) for i, c in enumerate(features)}


def prepare(train: DataFrame, features: list[str], scale: bool) -> SQLTransformer:
    """Fills what is missing with the median, and scales by mean and population deviation, no spread by 1."""
    filled = {c: f"coalesce(cast(`{c}` as double), {m!r}D)" for c, m in medians(train, features).items()}
    if scale:
        stats = train.agg(*[s(F.expr(filled[c])).alias(f"{n}{c}") for c in features for n, s in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
        filled = {c: f"({e} - {stats[f'm{c}']!r}D) / {stats[f's{c}'] or 1.0!r}D" for c, e in filled.items()}
    return SQLTransformer(statement=f"SELECT *, {', '.join(f'{e} AS `_{c}`' for c, e in filled.items())} FROM __THIS__")


def binned(train: DataFrame, columns: list[str], bins: int) -> Bucketizer:
    """Deals each column (without nulls) to at most so many bins: one for each value where there are no more, else by quantiles of all rows."""
    about = train.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()
    edges = {}
    for c in columns:
        if about[c] <= 2 * bins:  # far from the estimate's error
            edges[c] = sorted(r[0] for r in train.select(c).distinct().limit(bins + 1).collect())
    many = [c for c in columns if len(edges.get(c, ())) not in range(1, bins + 1)]
    if many:
        edges |= zip(many, train.approxQuantile(many, [i / bins for i in range(1, bins)], RANK_ERROR))
    # a value that is an edge begins the bin above it, so the least of few values is none
    splits = [sorted({float("-inf"), float("inf"), *(edges[c] if c in many else edges[c][1:] or edges[c])}) for c in columns]
    return Bucketizer(splitsArray=splits, inputCols=columns, outputCols=[f"{c}_bin" for c in columns])


def added_up(counts: DataFrame, bins: list[str], weights: dict[float, float], least: int) -> DataFrame:
    """bins, label and weight: a few rows that share the weight of those of the same bins (in number: _0 and _1, by label).

    A node of a tree has all rows of some bins. Bins with fewer than ``least`` rows keep their number of rows, and others have ``least`` (or one more).
    So sums stay, and a node has ``least`` rows if and only if it had as many before.
    """
    one = F.least(F.col("_1"), F.lit(least))
    times = {1.0: one, 0.0: F.least(F.col("_0"), F.greatest(F.lit(1), least - one))}
    each = F.array(*(F.struct(F.lit(y).alias("label"), F.try_divide(F.col(f"_{y:.0f}") * F.lit(float(weights[y])), n).alias("weight"), n.alias("_n")) for y, n in times.items()))
    rows = counts.select(*bins, F.explode(each).alias("_e")).where("_e._n > 0").select(*bins, "_e.*")
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n", "_i")


def boost(train: DataFrame, features: list[str], weights: dict[float, float]) -> PipelineModel:
    """Gradient boosting on all rows. It learns from, and scores, the numbers of bins, by sums of rows."""
    filled = prepare(train, features, False)
    rows, names = filled.transform(train), [f"_{c}" for c in features]
    cut = binned(rows, names, BOOSTED["maxBins"])
    bins = cut.getOutputCols()
    # numbers in order: marked as categories they would be split by any sets of bins
    ordered = cut.transform(rows).select("label", *(F.col(c).alias(c, metadata={}) for c in bins))
    counts = ordered.groupBy(*bins).agg(F.count_if(F.col("label") == 1).alias("_1"), F.count_if(F.col("label") == 0).alias("_0")).persist()
    sums = added_up(counts, bins, weights, BOOSTED["minInstancesPerNode"])
    assembled = VectorAssembler(inputCols=bins, outputCol="features")
    fitted = learner("boosted").fit(assembled.transform(sums.repartition(-(-sums.count() // TASK_ROWS), *bins)))
    counts.unpersist()
    return PipelineModel([filled, cut, assembled, fitted])


def learner(kind: str, weight_sum: float = 1.0):
    """kind: logistic or boosted. A logistic loss is a weighted mean here: its penalty is 1 / (C sum of weights), C = 1."""
    cols = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    if kind == "logistic":
        return LogisticRegression(**LOGISTIC, regParam=1 / weight_sum, standardization=False, **cols)
    return GBTClassifier(**BOOSTED, seed=SEED, **cols)


def fit(train: DataFrame, kind: str, features: list[str], label: str) -> PipelineModel | Forest:
    """Classes weigh the same: n / (2 n of the class), in a forest by each tree's bootstrap."""
    train = train.withColumn("label", F.col(label).cast("double"))
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if set(sizes) != {0.0, 1.0}:
        raise ValueError("training rows need both classes")
    if kind == "forest":
        return fit_forest(train, features, "label", **FOREST, seed=SEED)
    n = sum(sizes.values())
    weights = {y: n / (2 * size) for y, size in sizes.items()}
    if kind == "boosted":
        return boost(train, features, weights)
    train = train.withColumn("weight", F.when(F.col("label") == 1, weights[1.0]).otherwise(weights[0.0]))
    steps = [prepare(train, features, True), VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="features"), learner(kind, float(n))]
    return Pipeline(stages=steps).fit(train)


def predict(fitted: PipelineModel | Forest, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows with probability and predicted."""
    out = fitted.transform(rows)
    if isinstance(fitted, PipelineModel):
        out = out.withColumn("probability", vector_to_array("probability")[1])
    return out.withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


def fit_predict(train: DataFrame, test: DataFrame, kind: str, features: list[str], label: str) -> DataFrame:
    return predict(fit(train, kind, features, label), test)


def importances(fitted: PipelineModel | Forest, features: list[str]) -> list[tuple[str, float, float, float | None]]:
    """Feature, importance, its share of all, and the signed coefficient of a logistic model (of standardised features)."""
    learner = None if isinstance(fitted, Forest) else fitted.stages[-1]
    signed = [float(v) for v in learner.coefficients] if hasattr(learner, "coefficients") else None
    raw = [abs(v) for v in signed] if signed else fitted.importances if learner is None else [float(v) for v in learner.featureImportances.toArray()]
    total = sum(raw)
    return [(f, v, v / total if total > 0 else v, signed[i] if signed else None) for i, (f, v) in enumerate(zip(features, raw))]


def forget(fitted: PipelineModel | Forest) -> None:
    """What a fitted model keeps is given back once it has scored all that it is asked."""
    if isinstance(fitted, Forest):
        fitted.forget()


def folds(df: DataFrame, kind: str, features: list[str], label: str, interval: str, least: float = 0.5) -> list[tuple[str, PipelineModel | Forest, list[str], DataFrame]]:
    """By interval: its name, the model fitted without it, the features selected without it, and its rows. A driver loop over the few intervals, AT_ONCE at a time.

    Features are selected by the rows, values and extremes of each interval, which one pass finds for all.
    """
    finite = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in features}
    df = df.withColumns(finite | {label: F.coalesce(F.col(label).cast("int"), F.lit(0))})
    parts = [F.struct(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in features]
    found = df.groupBy(F.col(interval).alias("_interval")).agg(F.count(F.lit(1)).alias("_rows"), *parts).collect()
    names = sorted(r["_interval"] for r in found if r["_interval"] is not None)
    if len(names) < 3:
        raise ValueError("at least three intervals are needed")

    def without(name) -> tuple[str, PipelineModel | Forest, list[str], DataFrame]:
        others = [r for r in found if r["_interval"] != name]
        rows = sum(r["_rows"] for r in others)
        there = {c: [r[c] for r in others if r[c]["n"]] for c in features}
        selected = [c for c, p in there.items() if sum(x["n"] for x in p) >= least * rows and len({x[e] for x in p for e in ("low", "high")}) > 1]
        if not selected:
            raise ValueError(f"no feature is selected without {name}")
        held = F.col(interval).eqNullSafe(F.lit(name))
        return name, fit(df.where(~held), kind, selected, label), selected, df.where(held)

    with ThreadPool(min(AT_ONCE, len(names))) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(without), names)


def held_out(df: DataFrame, kind: str, features: list[str], label: str, interval: str, group: str, *order: str) -> DataFrame:
    """All rows of all intervals, predicted without their own: fold, probability, raw_predicted, and predicted after PERSISTENCE rows of group in a row."""
    each = []
    for name, fitted, _, rows in folds(df, kind, features, label, interval):
        each.append(predict(fitted, rows).withColumnRenamed("predicted", "raw_predicted").select(*df.columns, F.lit(name).alias("fold"), "raw_predicted", "probability"))
        forget(fitted)
    # kept, as runs read it twice: the scores are what costs
    found = reduce(DataFrame.unionByName, each).withColumn("_hit", F.col("raw_predicted") == 1).persist()
    rows = df.where(F.col(interval).isNotNull()).select(F.col(interval).alias("fold"), group, order[0])
    return with_run(found, "_hit", ["fold", group], *order, rows=rows).withColumn("predicted", (F.col("run") >= PERSISTENCE).cast("int")).drop("_hit", "run")


def held_out_importances(df: DataFrame, kind: str, features: list[str], label: str, interval: str) -> DataFrame:
    """By fold and selected feature: importance, normalized_importance and signed_coefficient."""
    rows = []
    for name, fitted, selected, _ in folds(df, kind, features, label, interval):
        rows += [(kind, name, *r) for r in importances(fitted, selected)]
        forget(fitted)
    return df.sparkSession.createDataFrame(rows, "model string, fold string, feature string, importance double, normalized_importance double, signed_coefficient double")


def evaluate_models(df: DataFrame, kinds: list[str], features: list[str], label: str, interval: str, group: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions of several kinds (with the column model), and their metrics with each model's place."""
    out = None
    for kind in kinds:
        found = held_out(df, kind, features, label, interval, group, *order).withColumn("model", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out, ranking(model_metrics(out, "model", group, order[0], order[-1], label, "probability"))


def top_importances(found: DataFrame, n: int = 20) -> DataFrame:
    """By model, the features with the largest mean share over the folds, with their place."""
    mean = found.groupBy("model", "feature").agg(F.avg("normalized_importance").alias("importance"))
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("importance"), "feature"))
    return mean.withColumn("place", place).where(F.col("place") <= n)


def refit(df: DataFrame, kind: str, features: list[str], label: str, path: str, least: float = 0.5) -> list[str]:
    """Fits on all rows, with features selected on all of them, and saves the bundle; returns the features."""
    kept = {r["feature"] for r in selection(df, features, least).where("reason = 'SELECTED'").collect()}
    selected = [c for c in features if c in kept]
    fitted = fit(df, kind, selected, label)
    save_bundle(df.sparkSession, fitted, path, selected)
    forget(fitted)
    return selected


def save_bundle(spark: SparkSession, fitted: PipelineModel | Forest, path: str, features: list[str], persistence: int = PERSISTENCE) -> None:
    """The fitted model, and beside it what its scores need: features, threshold and persistence."""
    forest = isinstance(fitted, Forest)
    if forest:
        fitted.save(spark, f"{path}/model")
    else:
        fitted.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(features, THRESHOLD, persistence, forest)], "features array<string>, threshold double, persistence int, forest boolean").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def score_bundle(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows scored by a saved model; fails if they lack one of its features."""
    settings = spark.read.json(f"{path}/settings").first()
    require_columns(rows, *settings["features"])
    fitted = Forest.load(spark, f"{path}/model") if settings["forest"] else PipelineModel.load(f"{path}/model")
    return predict(fitted, rows, settings["threshold"])


def ensemble(predictions: DataFrame, *keys: str) -> DataFrame:
    """Mean probability of the models, the decision, and how sure it is."""
    mean = F.avg("probability")
    p = F.when(mean.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))  # without any, null
    out = predictions.groupBy(*keys).agg(p.alias("probability"), F.array_join(F.sort_array(F.collect_set("model")), "|").alias("models"))
    return out.withColumn("positive", F.col("probability") >= THRESHOLD).withColumn("confidence", F.greatest(F.col("probability"), 1 - F.col("probability")))
