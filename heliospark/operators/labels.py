"""Minute labels by policy, windows of events, and what they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Labels in their order, and those that count for each target.
LABELS = ("QUIET", "SHOCK", "SHEATH", "ICME/EJECTA", "COMPLEX_ICME", "POST-ICME", "CIR/HSS", "ORIENTATION-CONTROL")
ICME = ("SHOCK", "SHEATH", "ICME/EJECTA", "COMPLEX_ICME")
TRANSIENT = (*ICME, "CIR/HSS")


def rank(label: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), label)


def in_windows(df: DataFrame, registry: DataFrame, ts: str, source: str) -> DataFrame:
    """Rows of a source in each of its registered windows, ends included, joined by source."""
    return df.join(registry, (df[source] == registry["source"]) & df[ts].between(registry["start_utc"], registry["end_utc"]))


def label(ts: Column) -> Column:
    """By the row's policy: its constant label, or the substructure around shock and ejecta: quiet before, if the policy names nothing else; the shock is one minute."""
    c = F.col
    parts = F.when(ts < c("shock_reference"), F.coalesce(c("pre_shock_label"), F.lit("QUIET"))).when(ts == c("shock_reference"), "SHOCK").when(ts < c("ejecta_start"), "SHEATH").when(ts < c("ejecta_end"), "ICME/EJECTA").otherwise("POST-ICME")
    return F.when(c("policy") == "CONSTANT", c("constant_label")).otherwise(parts)


def targets(label: Column, role: Column | None = None) -> dict[str, Column]:
    """0 or 1 by label; with the window's sample role also whether that is POSITIVE. Null is 0."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = {"icme_binary": flag(label.isin(*ICME)), "shock_binary": flag(label == "SHOCK"), "solar_transient_binary": flag(label.isin(*TRANSIENT))}
    return out if role is None else out | {"event_positive_binary": flag(role == "POSITIVE")}


def require_unique(df: DataFrame, *keys: str) -> None:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"duplicate {', '.join(keys)}")


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_same_events(catalog: DataFrame, policies: DataFrame) -> None:
    """Catalog and policies name exactly the same events."""
    odd = catalog.select("event_id").exceptAll(policies.select("event_id")).union(policies.select("event_id").exceptAll(catalog.select("event_id")))
    if names := sorted(r[0] for r in odd.limit(20).collect()):
        raise ValueError(f"events without policy, or policies without event: {', '.join(names)}")


# Kinds of boundaries, the policies' columns that hold them, and what is said of them.
BOUNDARIES = (
    ("EVENT_WINDOW_START", "start_utc", None, "Start of the registered Phase 2 scientific window."),
    ("EVENT_WINDOW_END", "end_utc", None, "Inclusive end of the registered Phase 2 scientific window."),
    ("SHOCK_REFERENCE", "shock_reference", "shock_reference_status", "Minute isolated as SHOCK."),
    ("ICME_EJECTA_START", "ejecta_start", "ejecta_start_status", "Start of the half-open ICME/ejecta interval."),
    ("ICME_EJECTA_END", "ejecta_end", "ejecta_end_status", "End of ICME/ejecta; post-ICME begins here."),
)


def boundary_register(policies: DataFrame) -> DataFrame:
    """One row for each window edge, each boundary that a policy names, and each reference that labels nothing.

    Columns that policies may lack: boundary_status, label_status, shock_reference_status, ejecta_start_status, ejecta_end_status, label_source, and
    references (array of boundary_type, boundary_time_utc, scientific_status, notes). A boundary's status is its own, else the policy's, else the label's.
    """
    col = lambda c: F.col(c) if c and c in policies.columns else F.lit(None).cast("string")
    general = F.coalesce(col("boundary_status"), col("label_status"))
    row = lambda kind, at, status, used, notes: F.struct(kind.alias("boundary_type"), at.alias("boundary_time_utc"), status.alias("scientific_status"), F.lit(used).alias("used_for_minute_labeling"), notes.alias("notes"))
    inner = F.col("policy") == "ICME_SUBSTRUCTURE"
    rows = [F.when(inner | F.lit(i < 2), row(F.lit(kind), F.col(at), F.coalesce(col(status), general), True, F.lit(notes))) for i, (kind, at, status, notes) in enumerate(BOUNDARIES)]
    every = F.array(*rows)
    if "references" in policies.columns:
        every = F.concat(every, F.coalesce(F.transform("references", lambda r: row(r["boundary_type"], r["boundary_time_utc"], r["scientific_status"], False, F.coalesce(r["notes"], F.lit("")))), F.array()))
    return policies.select("event_id", col("label_source").alias("label_source"), F.explode(every).alias("b")).select("event_id", "b.*", "label_source").where("boundary_time_utc is not null")


def boundaries_inside(rows: DataFrame, policies: DataFrame, by: str = "event_id", ts: str = "timestamp") -> DataFrame:
    """Events whose substructure isn't in order or doesn't lie inside of their rows, a minute behind the last one allowed."""
    ends = rows.groupBy(by).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    at = policies.where("policy = 'ICME_SUBSTRUCTURE'").join(ends, by, "left")
    ok = (F.col("_a") <= F.col("shock_reference")) & (F.col("shock_reference") < F.col("ejecta_start")) & (F.col("ejecta_start") < F.col("ejecta_end")) & (F.col("ejecta_end") <= F.col("_b") + F.expr("interval 1 minute"))
    return at.where(~F.coalesce(ok, F.lit(False))).select(by)
