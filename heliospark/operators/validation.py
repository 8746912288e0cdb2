"""Contracts of registries, policies, spectra and labelled minutes. What fails raises ValueError and names the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import ICME, LABELS, require_columns, require_unique

# What a registry may say.
EVENT_CLASSES = ("QUIET", "SHOCK", "SHEATH", "ICME", "COMPLEX_ICME", "POST_ICME", "CIR_SIR", "ORIENTATION_CONTROL", "OTHER_DISTURBANCE", "UNKNOWN")
SAMPLE_ROLES = ("POSITIVE", "CONTROL")
POLICIES = ("CONSTANT", "ICME_SUBSTRUCTURE")
SPECTRA = ("time", "energy", "th1_probability", "th2_probability")


def _refuse(what: str, bad: DataFrame) -> None:
    if names := sorted({str(r[0]) for r in bad.limit(20).collect()}):
        raise ValueError(f"{what}: {', '.join(names)}")


def overlaps(registry: DataFrame) -> DataFrame:
    """Events whose window begins before the one before it in their interval has ended."""
    w = Window.partitionBy("independent_interval_id").orderBy("start_utc", "event_id")
    return registry.withColumn("_e", F.lag("end_utc").over(w)).where("start_utc <= _e").select("event_id")


def checked_registry(registry: DataFrame) -> DataFrame:
    """The registry with class and role in capitals and negative_control a boolean; fails on what its rules forbid."""
    require_columns(registry, "event_id", "independent_interval_id", "event_class", "sample_role", "start_utc", "end_utc")
    if registry.isEmpty():
        raise ValueError("the registry has no event")
    _refuse("events without an id", registry.where("event_id is null or trim(event_id) = ''").select(F.lit("unnamed")))
    require_unique(registry, "event_id")
    control = F.coalesce(F.col("negative_control"), F.lit(False)) if "negative_control" in registry.columns else F.lit(False)
    out = registry.withColumns({"event_class": F.upper("event_class"), "sample_role": F.upper("sample_role"), "negative_control": control})
    _refuse("unknown class", out.where(~F.coalesce(F.col("event_class").isin(*EVENT_CLASSES), F.lit(False))).select("event_id"))
    _refuse("unknown role", out.where(~F.coalesce(F.col("sample_role").isin(*SAMPLE_ROLES), F.lit(False))).select("event_id"))
    _refuse("start after end", out.where("start_utc > end_utc").select("event_id"))
    _refuse("overlapping windows", overlaps(out))
    return out


def checked_policies(policies: DataFrame) -> DataFrame:
    """The policies with names and labels in capitals; fails on unknown ones and on boundaries out of order. Fields that no policy of a file has are
    null, and the label before a shock is quiet by default."""
    require_unique(policies, "event_id")
    kinds = {"constant_label": "string", "pre_shock_label": "string", "shock_reference": "timestamp_ntz", "ejecta_start": "timestamp_ntz", "ejecta_end": "timestamp_ntz"}
    policies = policies.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in policies.columns})
    out = policies.withColumns({"policy": F.upper("policy"), "constant_label": F.upper("constant_label")})
    out = out.withColumn("pre_shock_label", F.when(F.col("policy") == "ICME_SUBSTRUCTURE", F.coalesce(F.upper("pre_shock_label"), F.lit("QUIET"))))
    _refuse("unknown policy", out.where(~F.coalesce(F.col("policy").isin(*POLICIES), F.lit(False))).select("event_id"))
    _refuse("unknown label", out.where((F.col("policy") == "CONSTANT") & ~F.coalesce(F.col("constant_label").isin(*LABELS), F.lit(False))).select("event_id"))
    _refuse("boundaries out of order", out.where("policy = 'ICME_SUBSTRUCTURE' and not coalesce(shock_reference < ejecta_start and ejecta_start < ejecta_end, false)").select("event_id"))
    return out


def spectra_contract(spectra: DataFrame | None) -> tuple[bool, str]:
    """Whether a table of spectra may be used, and why not: missing, lacking columns, arrays of other lengths than the energies', or unreadable."""
    if spectra is None:
        return False, "missing"
    if lacking := sorted(set(SPECTRA) - set(spectra.columns)):
        return False, "missing keys: " + ", ".join(lacking)
    try:
        odd = spectra.where("size(th1_probability) != size(energy) or size(th2_probability) != size(energy)")
        return (True, "available") if odd.isEmpty() else (False, "time/probability length mismatch")
    except Exception as e:  # whatever a reader raises
        return False, f"unreadable: {type(e).__name__}"


def label_checks(rows: DataFrame, expected: DataFrame, by: str = "event_id", ts: str = "timestamp", label: str = "label") -> DataFrame:
    """One row of checks on labelled minutes. expected: event_id and records. rows: label, icme_binary, shock_binary and phase3_ready as well."""
    w = Window.partitionBy(by).orderBy("_place")
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    icme, shock = F.coalesce(F.col(label).isin(*ICME), F.lit(False)).cast("int"), F.coalesce(F.col(label) == "SHOCK", F.lit(False)).cast("int")
    every = placed.withColumn("_back", F.coalesce(F.col(ts) < F.lag(ts).over(w), F.lit(False))).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(by).alias("event_windows"), (F.count(F.lit(1)) - F.count_distinct(by, ts)).alias("duplicate_event_timestamps"), (~F.bool_or("_back")).alias("timestamps_monotonic_within_events"),
        F.count_if(F.coalesce(F.col(label) == "UNKNOWN", F.lit(True))).alias("unknown_labels"), F.bool_and(F.col("icme_binary") == icme).alias("icme_binary_consistent"), F.bool_and(F.col("shock_binary") == shock).alias("shock_binary_consistent"), F.count_distinct(F.when(F.col("phase3_ready"), F.col(by))).alias("phase3_ready_events"),
    )
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).join(expected.select(F.col("event_id").alias(by), F.col("records").alias("_x")), by, "full")
    match = counts.agg(F.coalesce(F.bool_and(F.coalesce(F.col("_n") == F.col("_x"), F.lit(False))), F.lit(True)).alias("event_counts_match"), F.sum("_x").alias("expected_records"))
    out = every.join(F.broadcast(match)).withColumn("record_count_matches", F.col("records") == F.coalesce("expected_records", F.lit(0)))
    valid = F.col("record_count_matches") & (F.col("duplicate_event_timestamps") == 0) & F.col("timestamps_monotonic_within_events") & (F.col("unknown_labels") == 0) & F.col("event_counts_match") & F.col("icme_binary_consistent") & F.col("shock_binary_consistent")
    return out.withColumn("phase3_valid", F.coalesce(valid, F.lit(False)))
