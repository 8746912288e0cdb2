"""Files: reference feeds as text, inventories, discovery by name, stand-ins for missing days; and report sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import clean_reference, finite, truth
from ..operators.labels import require_columns, require_unique

# The feed's columns in order, and their kinds.
REFERENCE_COLUMNS = {"timestamp": None, "omni_Bx_gse": "field", "omni_By_gse": "field", "omni_Bz_gse": "field", "omni_flow_speed": "speed", "omni_proton_density": "density", "omni_temperature": "temperature"}
KIND = r"(?i)(?:^|[_-])(TH1|TH2|BLK|MAG)(?:[_-])"
DAY_FILE = r"_(20\d{6})_.*_(V\d+)\.cdf$"


def read_reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """The 1-minute feed with a header (first field timestamp or time) or without; fills null, omni_complete and omni_source added.

    Fails if a time occurs twice or can't be read.
    """
    first = spark.read.text(path).limit(1).collect()
    header = bool(first) and first[0][0].split(",")[0].strip().lower() in ("timestamp", "time")
    names = list(REFERENCE_COLUMNS)
    raw = spark.read.csv(path, header=header, schema=None if header else ", ".join(f"`{c}` string" for c in names))
    if header:
        raw = raw.withColumnRenamed(raw.columns[0], "timestamp")
    ts = F.to_timestamp(F.col("timestamp")).cast("timestamp_ntz").alias("timestamp")
    out = raw.select(ts, *[clean_reference(F.expr(f"try_cast(`{c}` as double)"), k).alias(c) for c, k in REFERENCE_COLUMNS.items() if k])
    if not out.groupBy("timestamp").count().where("count > 1").isEmpty():
        raise ValueError("duplicate timestamps")
    complete = F.expr(" and ".join(f"`{c}` is not null" for c in names[1:]))
    return out.withColumn("omni_complete", complete).withColumn("omni_source", F.lit("NASA_CDAWEB_OMNI_HRO_1MIN")).orderBy("timestamp")


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, bytes and SHA-256 of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def day_files(names: DataFrame, column: str = "name") -> DataFrame:
    """Kind, date and version from file names; of each the first name. The kind is the instrument part of the name (TH1, TH2, BLK), null without one."""
    part = lambda pattern: F.regexp_extract(column, pattern, 1)
    found = names.select(column, F.nullif(F.upper(part(KIND)), F.lit("")).alias("kind"), part(DAY_FILE).alias("date"), F.regexp_extract(column, DAY_FILE, 2).alias("version")).where("date != ''")
    return found.groupBy("kind", "date", "version").agg(F.min(column).alias(column))


def paired_days(files: DataFrame, first: str = "TH1", second: str = "TH2") -> DataFrame:
    """Dates and versions of which both kinds are there."""
    key = lambda kind: files.where(F.col("kind") == kind).select("date", "version")
    return key(first).intersect(key(second))


def coverage_matrix(spark: SparkSession, files: DataFrame, start: str, end: str, kinds: tuple[str, ...]) -> DataFrame:
    """By day from start to end: OK or MISSING for each kind, and whether all are there."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 day)")).alias("_d")).select(F.date_format("_d", "yyyyMMdd").alias("date"))
    there = files.groupBy("date").agg(F.collect_set("kind").alias("_k"))
    out = days.join(there, "date", "left")
    return out.select("date", *[F.when(F.array_contains(F.coalesce("_k", F.array()), k), "OK").otherwise("MISSING").alias(k) for k in kinds], (F.size(F.array_except(F.array(*map(F.lit, kinds)), F.coalesce("_k", F.array().cast("array<string>")))) == 0).alias("complete"))


def placeholder_day(spark: SparkSession, date: str, columns: list[str]) -> DataFrame:
    """All minutes of a missing day, with null values and usable_opdi false."""
    minutes = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{date} 00:00:00', timestamp_ntz'{date} 23:59:00', interval 1 minute)")).alias("timestamp"))
    return minutes.withColumns({c: F.lit(None).cast("double") for c in columns} | {"usable_opdi": F.lit(False), "source_status": F.lit("MISSING_ADITYA_SWIS")})


#: The 1-minute table: its columns besides the time, and what is not a number.
FEATURES = ("js_opdi", "hellinger_opdi", "wasserstein_opdi", "proton_density", "proton_bulk_speed", "proton_thermal", "alpha_proton_ratio", "Bx_gse", "By_gse", "Bz_gse", "bmag_gse")


def read_features(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A 1-minute feature table from Parquet or CSV with a header: time and numbers typed, NaN null, other columns as they are. Fails if a column
    is missing or a time repeats."""
    raw = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True)
    require_columns(raw, "timestamp", *FEATURES)
    out = raw.withColumns({"timestamp": F.col("timestamp").cast("timestamp_ntz")} | {c: finite(F.expr(f"try_cast(`{c}` as double)")) for c in FEATURES})
    if "usable_opdi" in raw.columns:
        out = out.withColumn("usable_opdi", truth(F.col("usable_opdi").cast("string")))
    require_unique(out, "timestamp")
    return out


def read_spectra(spark: SparkSession, path: str) -> DataFrame | None:
    """Spectra of a minute a row (time, energy, arrays of both planes); None if there is no such table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def read_registry(spark: SparkSession, path: str, key: str = "events") -> DataFrame:
    """A YAML list of events or policies as a table: every field that one of them has, times typed by name, nested references as an array."""
    import yaml

    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a short file
    rows = (yaml.safe_load(text) or {}).get(key) or []
    names = list(dict.fromkeys(c for r in rows for c in r if c != "reference_boundaries"))
    value = lambda v: v if v is None or isinstance(v, bool) else str(v)
    flags = {c for c in names if any(isinstance(r.get(c), bool) for r in rows)}
    reference = ("boundary_type", "boundary_time_utc", "scientific_status", "notes")
    data = [(*[value(r.get(c)) for c in names], [tuple(str(b[x]) if b.get(x) is not None else None for x in reference) for b in r.get("reference_boundaries") or []]) for r in rows]
    fields = [f"`{c}` {'boolean' if c in flags else 'string'}" for c in names]
    out = spark.createDataFrame(data, ", ".join([*fields, "references array<struct<boundary_type:string,boundary_time_utc:string,scientific_status:string,notes:string>>"]))
    times = [c for c in names if c.endswith("_utc") or c in ("shock_reference", "ejecta_start", "ejecta_end")]
    out = out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})
    return out.withColumn("references", F.transform("references", lambda r: r.withField("boundary_time_utc", r["boundary_time_utc"].cast("timestamp_ntz"))))


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """A table as Parquet, or as CSV with a header, in folders by the columns in ``by``; replaces what was there."""
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).format(kind).save(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report, over several lines or one, as one row."""
    return spark.read.json(path, multiLine=True)


def write_report(df: DataFrame, path: str) -> dict:
    """A table of one row as JSON text in a folder; returns it."""
    df = df.limit(1)
    row = df.first()
    spark = df.sparkSession
    (spark.createDataFrame([row], df.schema) if row else df).coalesce(1).write.mode("overwrite").json(path)
    return row.asDict(True) if row else {}
