"""The transition detector: robust z-scores against a quiet baseline, steps, change points, states."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import clip_low, row_mean
from .joins import joined
from .statistics import center_scale
from .temporal import over_ranges, recent, with_change_points

# The detector's published weights and limits.
PLASMA_WEIGHT, FIELD_WEIGHT = 0.925, 0.075
DIVERGENCE_WEIGHTS = {"js_opdi": 0.5, "hellinger_opdi": 0.3, "wasserstein_opdi": 0.2}
PLASMA = ("proton_bulk_speed", "proton_density", "proton_thermal", "alpha_proton_ratio")
FIELD = ("bmag_gse", "Bx_gse", "By_gse", "Bz_gse")
# Weight of a channel's step, and its median and scale in quiet time.
STEP_WEIGHTS = {"bmag_gse": 0.35, "proton_bulk_speed": 0.25, "proton_thermal": 0.15, "proton_density": 0.10, "js_opdi": 0.15}
STEP_PARAMS = {
    "bmag_gse": (0.14208507537841797, 0.14665011348724363),
    "proton_bulk_speed": (5.942427385368035, 5.538786825610111),
    "proton_thermal": (1.546027328047149, 1.780992579041263),
    "proton_density": (0.6092925730448902, 0.6202940001472337),
    "js_opdi": (0.004768596668734391, 0.005200480317682181),
}


@dataclass
class Config:
    """step_params: median and scale of a channel's steps; what isn't given is taken from the baseline's rows."""

    baseline: tuple[str, str]
    divergences: dict[str, float]
    plasma: list[str]
    field: list[str]
    steps: dict[str, float] = field(default_factory=dict)
    lag: int = 4
    threshold: float = 8.0
    min_run: int = 2
    alert_after: int = 1
    candidate_window: int = 35
    candidate_score: float = 3.0
    watch_score: float = 2.8122751666908123
    step_params: dict[str, tuple[float, float]] = field(default_factory=dict)


def published(baseline: tuple[str, str]) -> Config:
    """The published detector: all channels, weights, steps and limits."""
    return Config(baseline, DIVERGENCE_WEIGHTS, list(PLASMA), list(FIELD), STEP_WEIGHTS, step_params=STEP_PARAMS)


def z_scores(df: DataFrame, by: str, ts: str, columns: list[str], baseline: tuple[str, str], prefix: str = "z_") -> DataFrame:
    """(x - center) / scale of each column, both from the baseline's rows of the series, ends included. All columns' take one aggregate and one join."""
    if not columns:
        return df
    quiet = df.where(F.col(ts).between(F.lit(baseline[0]).cast("timestamp_ntz"), F.lit(baseline[1]).cast("timestamp_ntz")))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    params = center_scale(quiet.select(by, each.alias("_v")).select(by, "_v.*"), [by, "column"], "value")
    params = params.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("center", "scale")))).alias("_p"))
    out = joined(df, params, [by], "left")
    return out.withColumns({prefix + c: (F.col(c) - F.col("_p")[c]["center"]) / F.col("_p")[c]["scale"] for c in columns}).drop("_p")


def detect(df: DataFrame, by: str, ts: str, key: str, config: Config) -> DataFrame:
    """Adds anomaly scores, transition_score, is_change_point and state."""
    rows = df.select(by, ts)
    names = list(dict.fromkeys([*config.divergences, *config.plasma, *config.field]))
    df = z_scores(df, by, ts, names, config.baseline)
    z = lambda c: F.col("z_" + c)
    opdi = sum((weight * clip_low(z(c)) for c, weight in config.divergences.items()), F.lit(0.0))
    plasma, mag = (row_mean(*[F.abs(z(c)) for c in g]) for g in (config.plasma, config.field))
    df = df.withColumns({"opdi_anomaly": opdi, "plasma_anomaly": plasma, "mag_anomaly": mag})
    df = df.withColumn("conventional", PLASMA_WEIGHT * F.col("plasma_anomaly") + FIELD_WEIGHT * F.col("mag_anomaly")).withColumn("combined", F.greatest("opdi_anomaly", "conventional"))
    df = over_ranges(df, by, ts, key, rows=rows, before=config.lag, new=lambda w: {f"step_{c}": F.abs(F.col(c) - F.lag(c, config.lag).over(w)) for c in config.steps})
    df = z_scores(df, by, ts, [f"step_{c}" for c in config.steps if c not in config.step_params], config.baseline)
    df = df.withColumns({f"z_step_{c}": (F.col(f"step_{c}") - m) / s for c, (m, s) in config.step_params.items() if c in config.steps})
    score = sum((weight * F.coalesce(clip_low(F.col(f"z_step_{c}")), F.lit(0.0)) for c, weight in config.steps.items()), F.lit(0.0))
    df = df.withColumn("transition_score", score).withColumn("raw_transition", F.col("transition_score") >= config.threshold)
    df = with_change_points(df, "raw_transition", by, ts, key, least=config.min_run, rows=rows)
    point = F.col("is_change_point")
    df = over_ranges(df, by, ts, key, rows=rows, before=max(config.alert_after, config.candidate_window), new=lambda w: {"_alert": recent(point, w, config.alert_after), "_recent": recent(point, w, config.candidate_window)})
    watch = (F.coalesce(F.col("combined"), F.lit(0.0)) >= config.watch_score) | F.col("raw_transition")
    candidate = F.col("_recent") & (F.coalesce(F.col("conventional"), F.lit(0.0)) >= config.candidate_score)
    state = F.when(F.col("_alert"), "ALERT").when(candidate, "ICME CANDIDATE").when(watch, "WATCH").otherwise("NORMAL")
    return df.withColumn("state", state).drop("_alert", "_recent")
