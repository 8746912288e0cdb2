"""The feature matrix of minutes: derivatives, past-only statistics, anomaly, persistence, compression, availability; and its dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import all_there, clip_low, share_there
from .coverage import CONVENTIONAL, OPDI
from .labels import require_columns, require_unique
from .joins import joined
from .statistics import MAD, TINY, quantiles
from .temporal import derivative, over_ranges, past, with_run

# The channels of the matrix.
CORE = ("proton_density", "proton_bulk_speed", "proton_thermal", "alpha_proton_ratio", "bmag_gse", "Bx_gse", "By_gse", "Bz_gse")
ROLLED = ("proton_density", "proton_bulk_speed", "proton_thermal", "alpha_proton_ratio", "bmag_gse")
DERIVED = ("proton_bulk_speed", "proton_density", "bmag_gse")
DIVERGENCES = ("js_opdi", "hellinger_opdi", "wasserstein_opdi")
COMPRESSED = {"density": "proton_density", "bmag": "bmag_gse", "speed": "proton_bulk_speed", "dynamic_pressure": "dynamic_pressure_proxy"}
SHAPES = {"cosine": "th1_th2_cosine_similarity", "angle": "th1_th2_spectral_angle_rad", "centroid_delta": "crossplane_centroid_delta_ev", "width_delta": "crossplane_width_delta_ev", "log_peak_ratio": "crossplane_log_peak_energy_ratio"}
STATISTICS = ("mean", "median", "variance")
#: Series whose spreads are sent to all tasks, at most; more are joined by a shuffle.
MOST_SERIES = 100_000
LEAK = ("research_label", "ground_truth_state", "phase3_label_confidence", "phase3_policy")


@dataclass(frozen=True)
class Config:
    """Rows of the windows, and when an anomaly counts."""

    windows: tuple[int, ...] = (5, 15, 60)
    primary: int = 15
    compression: int = 15
    anomaly: int = 60
    anomaly_least: int = 15
    anomaly_from: float = 3.0
    opdi: str = "js_opdi"


def dictionary_rows(config: Config = Config()) -> list[tuple[str, str]]:
    """Group and column of each feature, in order; none of them uses a label."""
    rolled = [f"{c}_rolling_{s}_{w}m" for c in ROLLED for w in config.windows for s in STATISTICS]
    groups = {
        "conventional_raw": CORE,
        "conventional_derivative": [f"d_{c}_dt" for c in DERIVED],
        "conventional_rolling": rolled,
        "compression": [f"{k}_compression_ratio" for k in ("density", "bmag", "speed")] + ["dynamic_pressure_proxy", "dynamic_pressure_compression_ratio", "joint_compression_index"],
        "cross_plane_opdi": DIVERGENCES,
        "cross_plane_derivative": [f"d_{c}_dt" for c in (*DIVERGENCES, "opdi")],
        "cross_plane_rolling": [f"opdi_rolling_{s}" for s in STATISTICS],
        "cross_plane_anomaly": ["opdi_anomaly", "opdi_persistence"],
        "cross_plane_shape": list(SHAPES.values()),
    }
    return [(g, c) for g, names in groups.items() for c in names]


def dictionary(spark: SparkSession, config: Config = Config()) -> DataFrame:
    """place, feature_group, column and uses_ground_truth_label."""
    return spark.createDataFrame([(i, g, c, False) for i, (g, c) in enumerate(dictionary_rows(config))], "place int, feature_group string, column string, uses_ground_truth_label boolean")


def model_features(entries: DataFrame, target: str) -> list[str]:
    """Columns of the dictionary that use no label, in its order; fails if one of them is the target or a label."""
    require_columns(entries, "column", "uses_ground_truth_label")
    key = "place" if "place" in entries.columns else "column"
    found = list(dict.fromkeys(r["column"] for r in entries.where("not coalesce(uses_ground_truth_label, false)").orderBy(key).collect()))
    if leaks := sorted({target, *LEAK} & set(found)):
        raise ValueError(f"labels among the features: {', '.join(leaks)}")
    return found


def attach_shapes(minutes: DataFrame, shapes: DataFrame, source: str, ts: str) -> DataFrame:
    """The shapes of the same source and time; of several at one time the first by their values. Minutes without have nulls.

    shapes: source, ts, and shape, a struct as functions.spectrum.shape makes it.
    """
    one = shapes.groupBy(source, ts).agg(F.min("shape").alias("_s"))
    out = minutes.join(one, [source, ts], "left")
    return out.withColumns({name: F.col(f"_s.{part}") for part, name in SHAPES.items()}).drop("_s")


def _looking_back(w, ts: str, config: Config) -> dict[str, Column]:
    """Derivatives and statistics of the rows before, which all share one sort."""
    primary = F.col(config.opdi)
    new = {f"d_{c}_dt": derivative(F.col(c), F.col(ts), w) for c in (*DERIVED, *DIVERGENCES)}
    new |= {f"{c}_rolling_{s}_{n}m": past(s, F.col(c), w, n) for c in ROLLED for n in config.windows for s in STATISTICS}
    new |= {f"opdi_rolling_{s}": past(s, primary, w, config.primary) for s in STATISTICS}
    new |= {"_middle": past("median", primary, w, config.anomaly, config.anomaly_least), "_spread": past("mad", primary, w, config.anomaly, config.anomaly_least)}
    new |= {f"{k}_compression_ratio": F.try_divide(F.col(c), F.nullif(past("median", F.col(c), w, config.compression), F.lit(0.0))) for k, c in COMPRESSED.items()}
    return new


def _by_series(df: DataFrame) -> DataFrame:
    """A table with a row a series, found now; up to MOST_SERIES it goes to all tasks, so that no few tasks get all rows of the few series."""
    df = df.persist()
    rows = df.limit(MOST_SERIES + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= MOST_SERIES else df


def feature_matrix(df: DataFrame, by: str, ts: str, *keys: str, config: Config = Config()) -> DataFrame:
    """df with every feature of the dictionary (shapes only where df has them), availabilities, and whether a row is ready for the ablation.

    df: the channels in CORE and DIVERGENCES, and eligible_for_exploratory_modeling. All statistics look back only, count rows, and share one
    sort of each range of a series; but the scale of an anomaly without spread in its window is the whole series'. A repeated time of a series fails.
    """
    require_columns(df, by, ts, *CORE, *DIVERGENCES, "eligible_for_exploratory_modeling")
    require_unique(df, by, ts, *keys)
    primary, rows = F.col(config.opdi), df.select(by, ts)
    # the whole series' spread, of the rows as they came: no task holds a series' values
    apart = joined(df.select(by, config.opdi), _by_series(quantiles(df, [by], config.opdi, {"_c": 0.5})), [by])
    whole = _by_series(quantiles(apart.select(by, F.abs(primary - F.col("_c")).alias("_d")), [by], "_d", {"_w": 0.5}).select(by, (F.col("_w") * MAD).alias("_whole")))
    df = df.withColumn("dynamic_pressure_proxy", F.col("proton_density") * F.pow("proton_bulk_speed", 2))
    reach = max(1, *config.windows, config.primary, config.anomaly, config.compression)
    df = over_ranges(df, by, ts, *keys, before=reach, new=lambda w: _looking_back(w, ts, config)).withColumn("d_opdi_dt", F.col(f"d_{config.opdi}_dt"))
    df = joined(df, whole, [by], "left")
    scale = F.coalesce(F.when(MAD * F.col("_spread") > TINY, MAD * F.col("_spread")), F.when(F.col("_whole") > 0, F.col("_whole")), F.lit(1e-6))
    df = df.withColumn("opdi_anomaly", F.abs(primary - F.col("_middle")) / scale).withColumn("_high", F.col("opdi_anomaly") >= config.anomaly_from)
    df = with_run(df, "_high", by, ts, *keys, out="opdi_persistence", rows=rows).drop("_middle", "_spread", "_whole", "_high")
    over = [F.pow(clip_low(F.col(f"{k}_compression_ratio") - 1), 2) for k in ("density", "bmag", "speed")]
    conventional, opdi = share_there(*map(F.col, CORE)), share_there(*map(F.col, (*DIVERGENCES, "d_opdi_dt")))
    df = df.withColumns({"joint_compression_index": F.sqrt(over[0] + over[1] + over[2]), "phase4_conventional_available_fraction": conventional, "phase4_opdi_available_fraction": opdi})
    if set(SHAPES.values()) <= set(df.columns):
        df = df.withColumn("phase4_spectral_shape_complete", all_there(*[F.col(SHAPES[k]) for k in ("cosine", "centroid_delta", "width_delta")]))
    enough = (F.col("phase4_conventional_available_fraction") >= CONVENTIONAL) & (F.col("phase4_opdi_available_fraction") >= OPDI)
    return df.withColumn("phase4_ready_for_exploratory_ablation", F.coalesce(F.col("eligible_for_exploratory_modeling"), F.lit(False)) & enough)


def event_summary(matrix: DataFrame, by: str, interval: str, label: str) -> DataFrame:
    """By event, interval and label (null too): rows, ready rows and mean availabilities."""
    return matrix.groupBy(by, interval, label).agg(
        F.count(F.lit(1)).alias("records"), F.count_if("phase4_ready_for_exploratory_ablation").alias("exploratory_rows"), F.avg("phase4_conventional_available_fraction").alias("conventional_available_fraction"), F.avg("phase4_opdi_available_fraction").alias("opdi_available_fraction")
    )


def blocked_events(matrix: DataFrame, by: str) -> DataFrame:
    """Events none of whose rows may be explored."""
    return matrix.groupBy(by).agg(F.bool_or(F.coalesce("eligible_for_exploratory_modeling", F.lit(False))).alias("_ok")).where("not _ok").select(by)
