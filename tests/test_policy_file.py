"""From a policy file, with its published names, to labels and the boundary register."""

from pyspark.sql import functions as F

from heliospark.operators import labels as L
from heliospark.operators import validation as V
from heliospark.sources.files import read_registry

POLICIES = """
events:
  - event_id: CALM
    policy: constant
    constant_label: quiet
    boundary_status: CONFIGURED
  - event_id: STORM
    policy: ICME_SUBSTRUCTURE
    shock_reference: '2024-10-10 14:45:00'
    shock_reference_status: APPROXIMATE
    ejecta_start: '2024-10-10 20:00:00'
    ejecta_end: '2024-10-11 06:00:00'
    boundary_status: CONFIGURED
    reference_boundaries:
      - boundary_type: OTHER_SHOCK
        boundary_time_utc: '2024-10-10 14:50:00'
        scientific_status: REPORTED
        notes: elsewhere
"""


def test_file_to_labels_and_register(spark, tmp_path):
    (tmp_path / "policies.yaml").write_text(POLICIES)
    policies = V.checked_policies(read_registry(spark, str(tmp_path / "policies.yaml")))
    minutes = spark.sql("select e as event_id, explode(sequence(timestamp_ntz'2024-10-10 14:00:00', timestamp_ntz'2024-10-11 07:00:00', interval 15 minutes)) as timestamp from values ('CALM'), ('STORM') as t(e)")
    got = minutes.join(policies, "event_id").select("event_id", "timestamp", L.label(F.col("timestamp")).alias("label")).collect()
    assert {r.label for r in got if r.event_id == "CALM"} == {"QUIET"}
    storm = {str(r.timestamp)[5:16]: r.label for r in got if r.event_id == "STORM"}
    # before the shock a policy that names no label is quiet
    assert [storm[t] for t in ("10-10 14:30", "10-10 14:45", "10-10 15:00", "10-10 20:00", "10-11 05:45", "10-11 06:00")] == ["QUIET", "SHOCK", "SHEATH", "ICME/EJECTA", "ICME/EJECTA", "POST-ICME"]
    edges = policies.withColumns({"start_utc": F.expr("timestamp_ntz'2024-10-10 14:00:00'"), "end_utc": F.expr("timestamp_ntz'2024-10-11 07:00:00'")})
    register = L.boundary_register(edges).collect()
    assert len(register) == 2 + 2 + 3 + 1
    by = {(r.event_id, r.boundary_type): r for r in register}
    assert by["STORM", "SHOCK_REFERENCE"].scientific_status == "APPROXIMATE" and by["STORM", "ICME_EJECTA_START"].scientific_status == "CONFIGURED"
    assert not by["STORM", "OTHER_SHOCK"].used_for_minute_labeling and by["STORM", "OTHER_SHOCK"].notes == "elsewhere"
