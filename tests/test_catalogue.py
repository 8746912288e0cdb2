"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from heliospark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: Where two sums that differ in the sixteenth digit may fall on both sides of a rounded last place: that place.
PLACES = {"rolling_variance": 1.1e-5, "rolling_mean": 1.1e-5, "rolling_mad": 1.1e-5, "derivative": 1.1e-5, "opdi_anomaly": 1.1e-5, "compression": 1.1e-4, "feature_matrix": 1.1e-3, "spectral_shape": 1.1e-3, "anomaly_scores": 1.1e-5, "transition_score": 1.1e-5, "evidence_breakdown": 1.1e-5, "group_score": 1.1e-5, "mode_predictions": 1.1e-5, "loo_predictions": 1.1e-5, "row_completeness": 1.1e-6, "safe_ratio": 1.1e-6}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    for c in df.select_dtypes("floating"):  # pandas has whole numbers with nulls as floats
        if (df[c].dropna() % 1 == 0).all():
            df[c] = df[c].astype("Int64")

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        return v if isinstance(v, float) else str(v)

    # numbers last, and in order by whole numbers first: what differs in the last digits must not come out of step
    return sorted((tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: [(isinstance(x, float), f"{x:.3g}" if isinstance(x, float) else x) for x in sorted(r, key=lambda x: isinstance(x, float))])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, wanted = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.sql(ORACLE_SQL[name]).df())
    assert len(got) == len(wanted)
    places = PLACES.get(name.rstrip("_0123456789"), 0)
    for g, w in zip(got, wanted):
        for a, b in zip(g, w):
            assert a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= max(1e-6 * abs(b), 1e-9, places), (g, w)


@pytest.mark.parametrize("name", ["mann_whitney_p", "ml_logistic"])
def test_without_sql(spark, name):
    out = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) and out.iloc[:, -1 if name == "mann_whitney_p" else -2].between(0, 1).all()


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
