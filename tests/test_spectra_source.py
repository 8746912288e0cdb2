"""NPZ spectra as a source: equal to their Parquet form, planned by row ranges, files outside a filter unopened."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from heliospark.operators.validation import spectra_contract
from heliospark.sources import spectra

ENERGY = np.exp(np.linspace(np.log(320), np.log(2100), 64))


def write(path, n, seed, compressed=False, energy=ENERGY, kind="datetime64[ns]", **other):
    r = np.random.default_rng(seed)
    p = [r.random((n, 64)).astype(t) for t in (np.float32, np.float64)]
    for x in p:
        x[r.random(x.shape) < 0.1] = np.nan
    time = np.datetime64("2024-10-09T00:00:00.000000") + np.arange(n) * np.timedelta64(60, "s")
    arrays = {"time": time.astype(kind), "energy": energy, "th1_probability": p[0], "th2_probability": p[1]} | other
    (np.savez_compressed if compressed else np.savez)(path, **{k: v for k, v in arrays.items() if v is not None})
    return time, p


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spectra.register(spark)
    top = tmp_path_factory.mktemp("npz")
    (top / "deep").mkdir()
    made = {"L2_TH1_20241009_V01.npz": write(top / "L2_TH1_20241009_V01.npz", 130, 1), "L2_TH2_20241010_V01.npz": write(top / "deep/L2_TH2_20241010_V01.npz", 75, 2, True, kind="U26"), "plain.npz": write(top / "plain.npz", 3, 3)}
    (top / "notes.txt").write_text("no spectra")
    return top, made


def nulls(a):
    return [None if np.isnan(v) else float(v) for v in a]


def test_equals_the_arrays_and_their_parquet_form(spark, folder, tmp_path):
    top, made = folder
    df = spark.read.format("spectra_npz").option("rows", 40).load(str(top))
    got = {(r.file, r.time): r for r in df.collect()}
    assert len(got) == sum(len(t) for t, _ in made.values())
    for name, (time, p) in made.items():
        for i, t in enumerate(time):
            r = got[name, t.astype("datetime64[us]").item()]
            assert r.th1_probability == nulls(p[0][i]) and r.th2_probability == nulls(p[1][i]) and r.energy == ENERGY.tolist()
    df.write.parquet(str(tmp_path / "p"))
    again = spark.read.parquet(str(tmp_path / "p"))
    assert df.exceptAll(again).isEmpty() and again.count() == len(got) and spectra_contract(df) == (True, "available")
    assert df.select("kind", "date").distinct().count() == 3


def test_partitions_are_row_ranges(spark, folder):
    top, _ = folder
    df = spark.read.format("spectra_npz").option("rows", 40).load(f"file://{top}")
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    assert sizes == [3, 10, 35, 40, 40, 40, 40]
    assert df.select("time").where("time >= '2024-10-09 02:09:00'").count() == 1


def test_filters_leave_files_unopened(spark, folder):
    top, _ = folder
    (top / "L2_TH1_20250101_V01.npz").write_bytes(b"not an archive")
    read = lambda: spark.read.format("spectra_npz").load(str(top))
    assert read().where("date = '20241009'").count() == 130
    assert read().where("kind in ('TH2', 'MAG') and date < '20250101' and date >= '20241010'").count() == 75
    assert read().where("kind = 'TH1' and date > '20260101'").count() == 0
    with pytest.raises(PySparkException, match="unreadable"):
        read().where("date = '20250101'").count()


def test_contract(spark, tmp_path):
    spectra.register(spark)
    write(tmp_path / "a.npz", 5, 1, th2_probability=None)
    with pytest.raises(PySparkException, match="missing keys: th2_probability"):
        spark.read.format("spectra_npz").load(str(tmp_path / "a.npz")).count()
    write(tmp_path / "b.npz", 5, 1, th1_probability=np.zeros((4, 64)))
    with pytest.raises(PySparkException, match="length mismatch"):
        spark.read.format("spectra_npz").load(str(tmp_path / "b.npz")).count()
    write(tmp_path / "c.npz", 0, 1)
    assert spark.read.format("spectra_npz").load(str(tmp_path / "c.npz")).count() == 0
    rows = np.tile(ENERGY, (5, 1)) + np.arange(5)[:, None]
    write(tmp_path / "d.npz", 5, 1, energy=rows)
    assert [r.energy[0] for r in spark.read.format("spectra_npz").option("rows", 2).load(str(tmp_path / "d.npz")).orderBy("time").collect()] == rows[:, 0].tolist()
