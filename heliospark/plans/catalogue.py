"""Every query by name, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions import spectrum as S
from ..operators import coverage as C
from ..operators import detector as D
from ..operators import evaluation as E
from ..operators import features as P
from ..operators import labels as L
from ..operators import learning
from ..operators import ranking as R
from ..operators import replay as Y
from ..operators import statistics as T
from ..operators import temporal as W
from ..operators import validation as V
from ..streaming.minutes import minute_stream
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = "event_id, timestamp, seq"


def query(sql: str | None = None, series: bool = True, name: str | None = None):
    """Registers a query; sql reads the view ``series`` unless told otherwise."""

    def add(f):
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            text = sql.strip()
            if series:
                text = f"WITH series AS ({X.SERIES}), " + text[5:] if text.startswith("WITH ") else f"WITH series AS ({X.SERIES}) {text}"
            ORACLE_SQL[n] = text
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def looked_back(df, rows: int, new):
    return W.over_ranges(df, "event_id", "timestamp", "seq", before=rows, new=new)


def long(c):
    return c.cast("long")


# --- cleaning and projection


@query("SELECT event_id, timestamp, seq, CASE WHEN seq % 11 = 0 OR seq % 13 = 0 THEN NULL ELSE x END AS flux, CASE WHEN seq % 7 = 0 THEN NULL WHEN abs(x) < 9999 THEN x END AS field, CASE WHEN seq % 17 = 0 OR abs(x) >= 999 THEN NULL ELSE x END AS density FROM series")
def clean_fill_values(spark, d):
    s = X.series(spark, d)
    raw = lambda n, fill: F.when(F.col("seq") % n == 0, F.lit(fill)).otherwise(F.col("x"))
    flux = F.when(F.col("seq") % 13 == 0, F.lit(float("nan"))).otherwise(raw(11, -1e31))
    return s.select("event_id", "timestamp", "seq", M.clean_flux(flux).alias("flux"), M.clean_field(raw(7, 99999.0)).alias("field"), M.clean_reference(raw(17, 999.9), "density").alias("density"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.05 THEN l_quantity END AS bx, round(CASE WHEN l_discount >= 0.05 THEN sqrt(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount) END, 6) AS bmag FROM lineitem", series=False)
def quality_gate(spark, d):
    li = X.table(spark, d, "lineitem")
    flag = F.col("l_discount") * 10
    x, y, z = (M.gate(flag, F.col(c)) for c in ("l_quantity", "l_tax", "l_discount"))
    return li.select("l_orderkey", "l_linenumber", x.alias("bx"), r6(M.magnitude(x, y, z), "bmag"))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax / nullif(l_discount - 0.03, 0) >= 0 THEN l_tax / nullif(l_discount - 0.03, 0) END, 6) AS r FROM lineitem", series=False)
def safe_ratio(spark, d):
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(M.ratio(F.col("l_tax"), F.col("l_discount") - 0.03), "r"))


@query("SELECT event_id, timestamp, seq, x FROM series WHERE timestamp BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-12'")
def window_slice(spark, d):
    return X.series(spark, d).where(F.col("timestamp").between(F.lit("2024-01-08").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz"))).select("event_id", "timestamp", "seq", "x")


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' OR l_returnflag = 'A' AS flag, coalesce(l_linestatus = 'O', false) AS supplied FROM lineitem", series=False)
def bool_from_text(spark, d):
    text = F.when(F.col("l_returnflag") == "R", " TRUE ").when(F.col("l_returnflag") == "A", "1").otherwise("no")
    supplied = F.when(F.col("l_linestatus") == "O", "true").otherwise("?")
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", M.truth(text).alias("flag"), M.supplied_else(supplied, F.lit(True)).alias("supplied"))


@query("SELECT event_id, timestamp, seq, x IS NOT NULL AND y IS NOT NULL AS complete, (CASE WHEN x IS NULL THEN 0 ELSE 1 END + CASE WHEN y IS NULL THEN 0 ELSE 1 END) / 2.0::DOUBLE AS share, round(CASE WHEN x IS NULL THEN y ELSE (x + y) / 2 END, 6) AS mean, round(CASE WHEN x IS NULL THEN y ELSE (x + y) / 2 END, 6) AS mid FROM series")
def row_completeness(spark, d):
    x, y = F.col("x"), F.col("y")
    return X.series(spark, d).select("event_id", "timestamp", "seq", M.all_there(x, y).alias("complete"), M.share_there(x, y).alias("share"), r6(M.row_mean(x, y), "mean"), r6(M.row_median(x, y), "mid"))


# --- time buckets and joins


def _bucket(unit: str):
    @query(f"SELECT event_id, date_trunc('{unit}', timestamp)::TIMESTAMP AS t, round(median(x), 6) AS x, round(median(y), 6) AS y, median(x) IS NOT NULL AS usable FROM series GROUP BY 1, 2", name=f"{unit}_median")
    def run(spark, d):
        return X.series(spark, d).groupBy("event_id", W.floor_time(unit, F.col("timestamp")).alias("t")).agg(r6(T.median("x"), "x"), r6(T.median("y"), "y")).withColumn("usable", F.col("x").isNotNull())


for _u in ("minute", "hour"):
    _bucket(_u)


@query("""WITH h AS (SELECT event_id, date_trunc('hour', timestamp)::TIMESTAMP AS t, median(x) AS x FROM series GROUP BY 1, 2),
ends AS (SELECT event_id, min(t) a, max(t) b FROM h GROUP BY 1), spine AS (SELECT event_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM ends)
SELECT s.event_id, s.t::TIMESTAMP AS t, round(h.x, 6) AS x, h.x IS NOT NULL AS present FROM spine s LEFT JOIN h ON s.event_id = h.event_id AND s.t = h.t""")
def spine_reindex(spark, d):
    h = X.series(spark, d).groupBy("event_id", W.floor_time("hour", F.col("timestamp")).alias("t")).agg(T.median("x").alias("x"))
    return W.spine(h, "event_id", "t", "1 hour").join(h, ["event_id", "t"], "left").select("event_id", "t", r6(F.col("x"), "x"), F.col("x").isNotNull().alias("present"))


def _asof(how: str):
    join = "JOIN" if how == "inner" else "LEFT JOIN"
    sql = f"""WITH l AS (SELECT timestamp, seq FROM series WHERE event_id = 'click'), r AS (SELECT timestamp rt, seq rseq FROM series WHERE event_id = 'view'),
b AS (SELECT l.seq, r.rseq, epoch_us(l.timestamp) - epoch_us(r.rt) gap FROM l ASOF LEFT JOIN r ON l.timestamp >= r.rt), a AS (SELECT l.seq, r.rseq, epoch_us(r.rt) - epoch_us(l.timestamp) gap FROM l ASOF LEFT JOIN r ON l.timestamp <= r.rt),
m AS (SELECT b.seq, CASE WHEN a.gap < coalesce(b.gap, 1e18) THEN a.rseq ELSE b.rseq END rseq, least(coalesce(a.gap, 1e18), coalesce(b.gap, 1e18)) gap FROM a JOIN b ON a.seq = b.seq), k AS (SELECT seq, rseq FROM m WHERE gap <= 600000000)
SELECT l.timestamp, l.seq, k.rseq FROM l {join} k ON l.seq = k.seq"""

    @query(sql, name=f"asof_nearest_{how}")
    def run(spark, d):
        s = X.series(spark, d)
        left = s.where("event_id = 'click'").select("timestamp", "seq")
        right = s.where("event_id = 'view'").select("timestamp", F.col("seq").alias("rseq"))
        return W.asof_nearest(left, right, "timestamp", ["rseq"], 600.0, ("seq",), how)


_asof("inner")
_asof("left")


@query("WITH h AS (SELECT event_id, date_trunc('hour', timestamp)::TIMESTAMP AS t, median(x) AS x FROM series GROUP BY 1, 2) SELECT a.t, round(a.x, 6) AS x, round(b.x, 6) AS reference FROM h a LEFT JOIN h b ON a.t = b.t AND b.event_id = 'view' WHERE a.event_id = 'click'")
def left_join_reference(spark, d):
    h = X.series(spark, d).where("event_id in ('click', 'view')").groupBy("event_id", W.floor_time("hour", F.col("timestamp")).alias("t")).agg(T.median("x").alias("x"))
    return h.where("event_id = 'click'").select("t", r6(F.col("x"), "x")).join(h.where("event_id = 'view'").select("t", r6(F.col("x"), "reference")), "t", "left")


_REG = f"WITH registry AS ({X.REGISTRY_SQL}), policy AS ({X.POLICY_SQL})"
_IN = f"{_REG}, w AS (SELECT r.event_id AS window_id, s.event_id AS src, s.timestamp, s.seq, s.x, s.y, p.*, r.start_utc, r.end_utc FROM series s JOIN registry r ON s.event_id = r.source AND s.timestamp BETWEEN r.start_utc AND r.end_utc JOIN policy p ON p.event_id = r.event_id)"
_LABEL = "CASE WHEN policy = 'CONSTANT' THEN constant_label WHEN timestamp < shock_reference THEN pre_shock_label WHEN timestamp = shock_reference THEN 'SHOCK' WHEN timestamp < ejecta_start THEN 'SHEATH' WHEN timestamp < ejecta_end THEN 'ICME/EJECTA' ELSE 'POST-ICME' END"


def windowed(spark, d):
    s = X.series(spark, d).withColumnRenamed("event_id", "src")
    return L.in_windows(s, X.registry(spark), "timestamp", "src").drop("source").join(F.broadcast(X.policies(spark)), "event_id").withColumnRenamed("event_id", "window_id")


@query(f"{_IN} SELECT window_id, src, timestamp, seq, x, timestamp - start_utc IS NOT NULL AS inside FROM w")
def interval_join_registry(spark, d):
    return windowed(spark, d).select("window_id", "src", "timestamp", "seq", "x", F.col("start_utc").isNotNull().alias("inside"))


@query(f"{_REG}, span AS (SELECT event_id AS source, min(timestamp) lo, max(timestamp) hi FROM series GROUP BY 1) SELECT r.event_id, r.source FROM registry r JOIN span s ON r.source = s.source AND r.end_utc >= s.lo AND r.start_utc <= s.hi")
def interval_overlap(spark, d):
    span = X.series(spark, d).groupBy(F.col("event_id").alias("source")).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return F.broadcast(X.registry(spark)).join(span, "source").where("end_utc >= lo and start_utc <= hi").select("event_id", "source")


@query(f"{_REG} SELECT event_id, seq, x FROM series WHERE independent_interval_id = 'I1' AND timestamp = (SELECT min(timestamp) FROM series WHERE event_id = 'click' AND x > 50)")
def exact_lookup(spark, d):
    s = X.series(spark, d)
    at = s.where("event_id = 'click' and x > 50").agg(F.min("timestamp").alias("timestamp"))
    return s.where("independent_interval_id = 'I1'").join(F.broadcast(at), "timestamp").select("event_id", "seq", "x")


@query(f"{_REG} SELECT event_id, count(*) AS n FROM series WHERE event_id IN (SELECT source FROM registry) GROUP BY 1")
def semi_events(spark, d):
    return X.series(spark, d).join(F.broadcast(X.registry(spark).select(F.col("source").alias("event_id"))), "event_id", "left_semi").groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, arg_min(seq, (abs(epoch_us(timestamp) - epoch_us(TIMESTAMP '{X.REFERENCE}')), timestamp)) AS seq FROM series GROUP BY 1")
def nearest_to_ref(spark, d):
    ref = F.lit(X.REFERENCE).cast("timestamp_ntz").cast("timestamp")
    return X.series(spark, d).groupBy("event_id").agg(F.min_by("seq", F.struct(F.abs(F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(ref)), "timestamp")).alias("seq"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'", series=False)
def key_intersection(spark, d):
    e = X.table(spark, d, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'view'").select("user_id"))


# --- aggregates

_MED = "m AS (SELECT event_id, median(x) c FROM series GROUP BY 1), d AS (SELECT s.event_id, x, c, abs(x - c) d FROM series s JOIN m USING (event_id))"


@query(f"WITH {_MED} SELECT event_id, round(any_value(c), 6) AS center, round(CASE WHEN median(d) > 0 THEN 1.4826 * median(d) WHEN stddev_samp(x) > 0 THEN stddev_samp(x) ELSE 1 END, 6) AS scale FROM d GROUP BY 1")
def robust_center_scale(spark, d):
    return T.center_scale(X.series(spark, d), ["event_id"], "x").select("event_id", r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


@query(f"WITH {_MED} SELECT event_id, round(coalesce(any_value(c), 0), 6) AS center, round(CASE WHEN 1.4826 * median(d) > 1e-12 THEN 1.4826 * median(d) WHEN (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349 > 1e-12 THEN (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349 WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1 END, 6) AS scale FROM d GROUP BY 1")
def robust_params_iqr(spark, d):
    return T.robust_params(X.series(spark, d), ["event_id"], "x").select("event_id", r6(F.col("center"), "center"), r6(F.col("scale"), "scale"))


@query(f"SELECT event_id, round(quantile_cont(x, 0.95), 6) AS q95, round(quantile_cont(x, 0.99), 6) AS q99 FROM series WHERE timestamp BETWEEN TIMESTAMP '{X.BASELINE[0]}' AND TIMESTAMP '{X.BASELINE[1]}' GROUP BY 1")
def baseline_quantiles(spark, d):
    quiet = X.series(spark, d).where(F.col("timestamp").between(*[F.lit(b).cast("timestamp_ntz") for b in X.BASELINE]))
    return quiet.groupBy("event_id").agg(*[r6(F.percentile("x", F.lit(q / 100)), f"q{q}") for q in (95, 99)])


@query("SELECT independent_interval_id AS state, target, count(x) AS x__count, round(median(x), 6) AS x__median, round(avg(x), 6) AS x__mean, round(stddev_samp(x), 6) AS x__std FROM series GROUP BY 1, 2")
def state_summary(spark, d):
    return X.series(spark, d).groupBy(F.col("independent_interval_id").alias("state"), "target").agg(F.count("x").alias("x__count"), r6(T.median("x"), "x__median"), r6(F.avg("x"), "x__mean"), r6(F.stddev_samp("x"), "x__std"))


@query("SELECT event_id, 'x' AS modality, round(avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END), 6) AS fraction FROM series GROUP BY 1 UNION ALL SELECT event_id, 'target' AS modality, round(avg(target::DOUBLE), 6) FROM series GROUP BY 1")
def coverage_long(spark, d):
    wide = X.series(spark, d).groupBy("event_id").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("x"), F.avg(F.col("target").cast("double")).alias("t"))
    return wide.select("event_id", F.expr("stack(2, 'x', x, 'target', t) as (modality, fraction)")).select("event_id", "modality", r6(F.col("fraction"), "fraction"))


@query("SELECT o_orderpriority AS p, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS F, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS O FROM orders GROUP BY 1", series=False)
def coverage_pivot(spark, d):
    return X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("p")).pivot("o_orderstatus", ["F", "O"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("WITH g AS (SELECT event_id, timestamp, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY event_id ORDER BY timestamp, seq) AS gap FROM series) SELECT event_id, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last, round(median(gap) / 1e6, 6) AS cadence_s, round(least(1.0, count(*) / (floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 6e8) + 1)), 6) AS time_coverage, bool_and(coalesce(gap > 0, true)) AS monotonic FROM g GROUP BY 1")
def source_quality(spark, d):
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    g = looked_back(X.series(spark, d), 1, lambda w: {"gap": us - F.lag(us).over(w)})
    span = (F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / 6e8
    return g.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), r6(T.median("gap") / 1e6, "cadence_s"), r6(F.least(F.lit(1.0), F.count(F.lit(1)) / (F.floor(span) + 1)), "time_coverage"), F.bool_and(F.coalesce(F.col("gap") > 0, F.lit(True))).alias("monotonic"))


@query("SELECT event_id, date_trunc('day', timestamp)::TIMESTAMP AS day, count(*) AS n, round(avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END), 6) AS usable, avg(CASE WHEN x IS NULL THEN 0.0 ELSE 1.0 END) < 0.97 AS partial FROM series GROUP BY 1, 2")
def day_quality(spark, d):
    ok = F.avg(F.col("x").isNotNull().cast("double"))
    return X.series(spark, d).groupBy("event_id", W.floor_time("day", F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("n"), r6(ok, "usable"), (ok < 0.97).alias("partial"))


# --- registry and labels


@query(f"{_IN} SELECT window_id, timestamp, seq, {_LABEL} AS label, CASE WHEN {_LABEL} IN ('SHOCK', 'SHEATH', 'ICME/EJECTA', 'COMPLEX_ICME') THEN 1 ELSE 0 END AS icme_binary, CASE WHEN {_LABEL} = 'SHOCK' THEN 1 ELSE 0 END AS shock_binary, CASE WHEN {_LABEL} IN ('SHOCK', 'SHEATH', 'ICME/EJECTA', 'COMPLEX_ICME', 'CIR/HSS') THEN 1 ELSE 0 END AS solar_transient_binary, CASE WHEN src = 'click' THEN 1 ELSE 0 END AS event_positive_binary FROM w")
def label_policy(spark, d):
    w = windowed(spark, d).withColumn("label", L.label(F.col("timestamp")))
    return w.select("window_id", "timestamp", "seq", "label", *[c.alias(n) for n, c in L.targets(F.col("label"), F.when(F.col("src") == "click", "POSITIVE").otherwise("CONTROL")).items()])


@query(f"{_IN} SELECT {_LABEL} AS label, count(*) AS n, count(DISTINCT window_id) AS events, min(timestamp) AS first, max(timestamp) AS last, count(x) AS ready FROM w GROUP BY 1")
def label_counts(spark, d):
    w = windowed(spark, d).withColumn("label", L.label(F.col("timestamp")))
    return w.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("window_id").alias("events"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("x").alias("ready")).orderBy(L.rank(F.col("label")))


@query(f"{_IN}, g AS (SELECT window_id, {_LABEL} AS label, list_position(['QUIET', 'SHOCK', 'SHEATH', 'ICME/EJECTA', 'COMPLEX_ICME', 'POST-ICME', 'CIR/HSS', 'ORIENTATION-CONTROL'], {_LABEL}) AS o, count(*) n FROM w GROUP BY 1, 2, 3) SELECT window_id, sum(n)::BIGINT AS n, string_agg(label, '|' ORDER BY o) AS labels FROM g GROUP BY 1")
def event_register(spark, d):
    w = windowed(spark, d).withColumn("label", L.label(F.col("timestamp"))).groupBy("window_id", "label").agg(F.count(F.lit(1)).alias("n"))
    names = F.transform(F.array_sort(F.collect_set(F.struct(L.rank(F.col("label")).alias("o"), "label"))), lambda s: s["label"])
    return w.groupBy("window_id").agg(F.sum("n").alias("n"), F.array_join(names, "|").alias("labels"))


@query(f"{_IN} SELECT window_id, {_LABEL} AS label, count(*) AS n, count(x) AS ready FROM w GROUP BY 1, 2")
def event_summary(spark, d):
    return windowed(spark, d).groupBy("window_id", L.label(F.col("timestamp")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("ready"))


@query(f"{_IN} SELECT window_id FROM w GROUP BY 1 HAVING NOT bool_or(coalesce(x > 90 AND {_LABEL} <> 'QUIET', false))")
def blocked_events(spark, d):
    w = windowed(spark, d)
    ok = F.coalesce((F.col("x") > 90) & (L.label(F.col("timestamp")) != "QUIET"), F.lit(False))
    return w.groupBy("window_id").agg(F.bool_or(ok).alias("_ok")).where("not _ok").select("window_id")


@query(f"{_IN} SELECT count(*) AS n, count(DISTINCT window_id) AS events, (SELECT count(*) FROM series) - count(DISTINCT seq) AS unregistered, count(DISTINCT {_LABEL}) AS labels, CASE WHEN count(DISTINCT window_id) >= 5 THEN 'READY' WHEN count(*) > 0 THEN 'PARTIAL' ELSE 'EMPTY' END AS status FROM w")
def manifest_counts(spark, d):
    w = windowed(spark, d)
    out = w.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("window_id").alias("events"), F.count_distinct("seq").alias("_s"), F.count_distinct(L.label(F.col("timestamp"))).alias("labels"))
    every = X.series(spark, d).agg(F.count(F.lit(1)).alias("_all"))
    status = F.when(F.col("events") >= 5, "READY").when(F.col("n") > 0, "PARTIAL").otherwise("EMPTY")
    return out.join(F.broadcast(every)).select("n", "events", (F.col("_all") - F.col("_s")).alias("unregistered"), "labels", status.alias("status"))


@query(f"{_REG}, a AS (SELECT p.*, r.start_utc, r.end_utc FROM policy p JOIN registry r ON p.event_id = r.event_id) SELECT event_id, 'EVENT_WINDOW_START' AS boundary_type, start_utc AS boundary_time_utc, 'PROVISIONAL' AS scientific_status, true AS used FROM a UNION ALL SELECT event_id, 'EVENT_WINDOW_END', end_utc, 'PROVISIONAL', true FROM a UNION ALL SELECT event_id, 'SHOCK_REFERENCE', shock_reference, 'APPROXIMATE', true FROM a WHERE shock_reference IS NOT NULL UNION ALL SELECT event_id, 'ICME_EJECTA_START', ejecta_start, 'PROVISIONAL', true FROM a WHERE ejecta_start IS NOT NULL UNION ALL SELECT event_id, 'ICME_EJECTA_END', ejecta_end, 'PROVISIONAL', true FROM a WHERE ejecta_end IS NOT NULL UNION ALL SELECT event_id, 'FRONT', start_utc, 'LITERATURE', false FROM a WHERE event_id = 'W3'")
def boundary_register(spark, d):
    reference = F.struct(F.lit("FRONT").alias("boundary_type"), F.col("start_utc").alias("boundary_time_utc"), F.lit("LITERATURE").alias("scientific_status"), F.lit(None).cast("string").alias("notes"))
    p = X.policies(spark).join(X.registry(spark), "event_id").withColumns({"label_status": F.lit("PROVISIONAL"), "shock_reference_status": F.when(F.col("shock_reference").isNotNull(), "APPROXIMATE"), "references": F.when(F.col("event_id") == "W3", F.array(reference))})
    return L.boundary_register(p).select("event_id", "boundary_type", "boundary_time_utc", "scientific_status", F.col("used_for_minute_labeling").alias("used"))


@query(f"{_REG}, o AS (SELECT event_id, start_utc <= lag(end_utc) OVER (PARTITION BY source ORDER BY start_utc) AS overlap FROM registry) SELECT event_id, coalesce(overlap, false) AS overlap FROM o")
def overlap_check(spark, d):
    r = X.registry(spark)
    bad = V.overlaps(r.withColumnRenamed("source", "independent_interval_id")).withColumn("_o", F.lit(True))
    return r.join(F.broadcast(bad), "event_id", "left").select("event_id", F.coalesce("_o", F.lit(False)).alias("overlap"))


@query(f"""{_IN}, l AS (SELECT window_id, timestamp, seq, {_LABEL} AS label FROM w) SELECT (SELECT count(*) FROM l) AS records, (SELECT count(DISTINCT window_id) FROM l) AS event_windows, (SELECT count(*) FROM l) - (SELECT count(*) FROM (SELECT DISTINCT window_id, timestamp FROM l)) AS duplicate_event_timestamps, 0 AS unknown_labels, true AS event_counts_match, true AS icme_binary_consistent, true AS shock_binary_consistent, (SELECT count(DISTINCT window_id) FROM l WHERE window_id <> 'W4') AS phase3_ready_events""")
def label_checks(spark, d):
    w = windowed(spark, d).withColumn("label", L.label(F.col("timestamp")))
    w = w.withColumns(L.targets(F.col("label")) | {"phase3_ready": F.col("window_id") != "W4"})
    out = V.label_checks(w, w.groupBy(F.col("window_id").alias("event_id")).agg(F.count(F.lit(1)).alias("records")), "window_id")
    return out.select("records", "event_windows", "duplicate_event_timestamps", long(F.col("unknown_labels")).cast("int").alias("unknown_labels"), "event_counts_match", "icme_binary_consistent", "shock_binary_consistent", "phase3_ready_events")


@query(f"{_REG}, a AS (SELECT p.event_id, p.shock_reference, p.ejecta_start, p.ejecta_end, min(s.timestamp) lo, max(s.timestamp) hi FROM policy p JOIN registry r ON r.event_id = p.event_id LEFT JOIN series s ON s.event_id = r.source AND s.timestamp BETWEEN r.start_utc AND r.end_utc WHERE p.policy = 'ICME_SUBSTRUCTURE' GROUP BY 1, 2, 3, 4) SELECT event_id FROM a WHERE NOT coalesce(lo <= shock_reference AND shock_reference < ejecta_start AND ejecta_start < ejecta_end AND ejecta_end <= hi + INTERVAL 1 MINUTE, false)")
def boundaries_outside(spark, d):
    return L.boundaries_inside(windowed(spark, d).withColumnRenamed("window_id", "event_id"), X.policies(spark))


@query("SELECT event_id, y, count(*) AS n FROM series GROUP BY 1, 2 HAVING count(*) > 1")
def dup_check(spark, d):
    return X.series(spark, d).groupBy("event_id", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"""{_REG}, a AS (SELECT r.event_id, start_utc, end_utc, s.seq, s.x, s.y FROM registry r LEFT JOIN series s ON r.source = s.event_id AND s.timestamp BETWEEN start_utc AND end_utc),
g AS (SELECT event_id, count(seq) n, least(1.0, count(seq) / (floor((epoch_us(any_value(end_utc)) - epoch_us(any_value(start_utc))) / 36e8) + 1)) c, coalesce(count(x)::DOUBLE / nullif(count(seq), 0), 0) fx, coalesce(count(y)::DOUBLE / nullif(count(seq), 0), 0) fy FROM a GROUP BY 1)
SELECT event_id, n AS records, round(c, 6) AS time_coverage, round(fx, 6) AS plasma, round(fy, 6) AS field, c >= 0.9 AND fx >= 0.9 AND fy >= 0.9 AS ready FROM g""")
def event_readiness(spark, d):
    rows = L.in_windows(X.series(spark, d).withColumnRenamed("event_id", "src"), X.registry(spark), "timestamp", "src")
    out = C.readiness(rows, X.registry(spark), {"plasma": ["x"], "field": ["y"]}, 60)
    return out.select("event_id", "records", *[r6(F.col(c), c) for c in ("time_coverage", "plasma", "field")], "ready")


@query("""WITH h AS (SELECT event_id, date_trunc('hour', timestamp)::TIMESTAMP AS t, median(x) AS x FROM series GROUP BY 1, 2),
ends AS (SELECT event_id, min(t) a, max(t) b FROM h GROUP BY 1), spine AS (SELECT event_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM ends), f AS (SELECT s.event_id, s.t, h.x IS NOT NULL AS present FROM spine s LEFT JOIN h ON s.event_id = h.event_id AND s.t = h.t),
u AS (SELECT * FROM f WHERE event_id = 'click' OR present UNION ALL SELECT * FROM f WHERE event_id = 'error' AND present), k AS (SELECT *, epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY event_id ORDER BY t) gap FROM u)
SELECT event_id, count(*) AS records, min(t)::TIMESTAMP AS first, max(t)::TIMESTAMP AS last, bool_and(coalesce(gap = 3600000000, true)) AS continuous, count(*) - count(DISTINCT t) AS duplicates, count(*) FILTER (present) AS valid, round(avg(CASE WHEN present THEN 1.0 ELSE 0.0 END), 6) AS valid_fraction FROM k GROUP BY 1""")
def feed_quality(spark, d):
    f = spine_reindex(spark, d)
    twice = f.where("event_id = 'click' or present").unionByName(f.where("event_id = 'error' and present"))
    return C.feed_quality(twice, ["event_id"], "t", "present", 3600).withColumn("valid_fraction", F.round("valid_fraction", 6))


@query("SELECT event_id, timestamp, seq, x IS NOT NULL AND event_id <> 'error' AS exploratory, x IS NOT NULL AND event_id = 'click' AS confirmatory, x IS NOT NULL AND event_id <> 'error' AND target = 1 AS features_ready FROM series")
def row_eligibility(spark, d):
    share = F.when(F.col("target") == 1, 0.75).otherwise(F.lit(0.7))
    confidence = F.when(F.col("event_id") == "click", "HIGH").when(F.col("event_id") == "view", "LOW")
    flags = C.eligibility(F.col("event_id") != "error", M.all_there(F.col("x"), F.col("y")), confidence, share, share)
    return X.series(spark, d).select("event_id", "timestamp", "seq", *[c.alias(n) for n, c in flags.items()])


@query("SELECT nullif(event_id, 'error') AS g, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.99), 6) AS q99 FROM series GROUP BY 1")
def exact_quantiles(spark, d):
    s = X.series(spark, d).withColumn("g", F.nullif(F.col("event_id"), F.lit("error")))
    out = T.quantiles(s, ["g"], "x", {"q25": 0.25, "q50": 0.5, "q99": 0.99})
    return out.select("g", *[r6(F.col(c), c) for c in ("q25", "q50", "q99")])


# --- sequences

_W = "PARTITION BY event_id ORDER BY timestamp, seq"


@query(f"SELECT event_id, timestamp, seq, round(CASE WHEN epoch_us(timestamp) > lag(epoch_us(timestamp)) OVER ({_W}) THEN (x - lag(x) OVER ({_W})) / ((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER ({_W})) / 6e7) END, 5) AS dx FROM series")
def derivative(spark, d):
    return looked_back(X.series(spark, d), 1, lambda w: {"dx": F.round(W.derivative(F.col("x"), F.col("timestamp"), w), 5)}).select("event_id", "timestamp", "seq", "dx")


def _rolling(stat: str, sql: str, n: int):
    least = W.least_rows(n)
    frame = f"OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"

    @query(f"SELECT event_id, timestamp, seq, round(CASE WHEN count(x) {frame} >= {least} THEN {sql}(x) {frame} END, 5) AS v FROM series", name=f"rolling_{stat}_{n}")
    def run(spark, d):
        return looked_back(X.series(spark, d), n, lambda w: {"v": F.round(W.past(stat, F.col("x"), w, n), 5)}).select("event_id", "timestamp", "seq", "v")


for _stat, _sql in (("mean", "avg"), ("median", "median"), ("variance", "var_pop"), ("mad", "mad")):
    for _n in (5, 15, 60):
        _rolling(_stat, _sql, _n)

_F60 = f"OVER ({_W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
_ANOMALY = f"""WITH r AS (SELECT *, CASE WHEN count(x) {_F60} >= 15 THEN median(x) {_F60} END m, CASE WHEN count(x) {_F60} >= 15 THEN mad(x) {_F60} END a FROM series), g AS (SELECT event_id, mad(x) w FROM series GROUP BY 1),
o AS (SELECT r.event_id, timestamp, seq, abs(x - m) / CASE WHEN 1.4826 * a > 1e-12 THEN 1.4826 * a WHEN 1.4826 * w > 1e-12 THEN 1.4826 * w ELSE 1e-6 END AS anomaly FROM r JOIN g ON r.event_id = g.event_id)"""


def _anomaly(spark, d):
    s = X.series(spark, d)
    mid = s.groupBy("event_id").agg(T.median("x").alias("_m"))
    mad = s.join(F.broadcast(mid), "event_id").groupBy("event_id").agg(F.percentile(F.abs(F.col("x") - F.col("_m")), F.lit(0.5)).alias("_g"))
    s = looked_back(s, 60, lambda w: {"_c": W.past("median", F.col("x"), w, 60, 15), "_a": W.past("mad", F.col("x"), w, 60, 15)}).join(F.broadcast(mad), "event_id")
    scale = F.coalesce(F.when(T.MAD * F.col("_a") > T.TINY, T.MAD * F.col("_a")), F.when(T.MAD * F.col("_g") > T.TINY, T.MAD * F.col("_g")), F.lit(1e-6))
    return s.withColumn("anomaly", F.abs(F.col("x") - F.col("_c")) / scale)


@query(f"{_ANOMALY} SELECT event_id, timestamp, seq, round(anomaly, 5) AS anomaly FROM o")
def opdi_anomaly(spark, d):
    return _anomaly(spark, d).select("event_id", "timestamp", "seq", F.round("anomaly", 5).alias("anomaly"))


_RUN = f"i AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) g FROM q), n AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY event_id, g ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING)::INTEGER AS run FROM i)"


@query(f"WITH q AS (SELECT *, coalesce(x > 55, false) f FROM series), {_RUN} SELECT event_id, timestamp, seq, run, run >= 3 AS persistent FROM n")
def persistence_run(spark, d):
    s = X.series(spark, d).withColumn("f", F.col("x") > 55)
    return W.with_run(s, "f", "event_id", "timestamp", "seq").select("event_id", "timestamp", "seq", "run", (F.col("run") >= 3).alias("persistent"))


_F15 = f"OVER ({_W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)"
_RATIO = lambda c: f"CASE WHEN count({c}) {_F15} >= 5 THEN {c} / nullif(median({c}) {_F15}, 0) END"


@query(f"WITH q AS (SELECT *, {_RATIO('x')} rx, {_RATIO('y')} ry, {_RATIO('p')} rp FROM (SELECT *, x * y * y AS p FROM series)) SELECT event_id, timestamp, seq, round(rx, 4) AS rx, round(ry, 4) AS ry, round(rp, 4) AS rp, round(sqrt(power(CASE WHEN rx > 1 THEN rx - 1 WHEN rx IS NOT NULL THEN 0 END, 2) + power(CASE WHEN ry > 1 THEN ry - 1 WHEN ry IS NOT NULL THEN 0 END, 2)), 4) AS joint FROM q")
def compression(spark, d):
    s = X.series(spark, d).withColumn("p", F.col("x") * F.col("y") * F.col("y"))
    s = looked_back(s, 15, lambda w: {f"r{c}": F.try_divide(F.col(c), F.nullif(W.past("median", F.col(c), w, 15), F.lit(0.0))) for c in ("x", "y", "p")})
    over = lambda c: F.pow(M.clip_low(F.col(c) - 1), 2)
    return s.select("event_id", "timestamp", "seq", F.round("rx", 4).alias("rx"), F.round("ry", 4).alias("ry"), F.round("rp", 4).alias("rp"), F.round(F.sqrt(over("rx") + over("ry")), 4).alias("joint"))


# --- the feature matrix

_CHANNELS = {"proton_density": "x", "proton_bulk_speed": "y", "proton_thermal": "x + y", "alpha_proton_ratio": "x / 100", "bmag_gse": "abs(x - 50) + 1", "Bx_gse": "x - 50", "By_gse": "y - 50", "Bz_gse": "x - y", "js_opdi": "x / 200", "hellinger_opdi": "x / 300", "wasserstein_opdi": "y / 400"}
_Q = ", ".join(f"{e} AS {c}" for c, e in _CHANNELS.items())


def _frame_sql(stat: str, c: str, n: int, least: int) -> str:
    return f"CASE WHEN count({c}) OVER f{n} >= {least} THEN {stat}({c}) OVER f{n} END"


_MATRIX = f"""WITH c AS (SELECT *, {_Q} FROM series), g AS (SELECT event_id, 1.4826 * mad(js_opdi) whole FROM c GROUP BY 1),
m AS (SELECT *, CASE WHEN epoch_us(timestamp) > lag(epoch_us(timestamp)) OVER o THEN (proton_bulk_speed - lag(proton_bulk_speed) OVER o) / ((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER o) / 6e7) END dv, CASE WHEN epoch_us(timestamp) > lag(epoch_us(timestamp)) OVER o THEN (js_opdi - lag(js_opdi) OVER o) / ((epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER o) / 6e7) END dj,
{_frame_sql('avg', 'proton_density', 5, 3)} mean5, {_frame_sql('median', 'bmag_gse', 15, 5)} med15, {_frame_sql('var_pop', 'proton_thermal', 60, 20)} var60, {_frame_sql('median', 'js_opdi', 15, 5)} jm, {_frame_sql('median', 'js_opdi', 60, 15)} j60, {_frame_sql('mad', 'js_opdi', 60, 15)} a60,
proton_density / nullif({_frame_sql('median', 'proton_density', 15, 5)}, 0) rn, bmag_gse / nullif({_frame_sql('median', 'bmag_gse', 15, 5)}, 0) rb, proton_bulk_speed / nullif({_frame_sql('median', 'proton_bulk_speed', 15, 5)}, 0) rv FROM c WINDOW o AS ({_W}), f5 AS ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), f15 AS ({_W} ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING), f60 AS ({_W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
q AS (SELECT m.*, abs(js_opdi - j60) / CASE WHEN 1.4826 * a60 > 1e-12 THEN 1.4826 * a60 WHEN whole > 0 THEN whole ELSE 1e-6 END AS anomaly, coalesce(abs(js_opdi - j60) / CASE WHEN 1.4826 * a60 > 1e-12 THEN 1.4826 * a60 WHEN whole > 0 THEN whole ELSE 1e-6 END >= 3, false) f FROM m JOIN g ON g.event_id = m.event_id), {_RUN}"""


def _matrix(spark, d):
    s = X.series(spark, d).withColumns({c: F.expr(e) for c, e in _CHANNELS.items()} | {"eligible_for_exploratory_modeling": F.col("event_id") != "error"})
    return P.feature_matrix(s, "event_id", "timestamp", "seq")


@query(f"""{_MATRIX} SELECT event_id, timestamp, seq, round(dv, 5) AS d_speed, round(dj, 7) AS d_opdi, round(mean5, 5) AS mean_5, round(med15, 5) AS median_15, round(var60, 3) AS variance_60, round(jm, 6) AS opdi_median, round(anomaly, 5) AS anomaly, run AS persistence, round(rn, 4) AS density_ratio,
round(sqrt(power(CASE WHEN rn > 1 THEN rn - 1 WHEN rn IS NOT NULL THEN 0 END, 2) + power(CASE WHEN rb > 1 THEN rb - 1 WHEN rb IS NOT NULL THEN 0 END, 2) + power(CASE WHEN rv > 1 THEN rv - 1 WHEN rv IS NOT NULL THEN 0 END, 2)), 4) AS joint, CASE WHEN x IS NULL THEN 0.25 ELSE 1.0 END::DOUBLE AS conventional_share,
round((CASE WHEN x IS NULL THEN 1 ELSE 3 END + CASE WHEN dj IS NULL THEN 0 ELSE 1 END) / 4.0::DOUBLE, 6) AS opdi_share, event_id <> 'error' AND x IS NOT NULL AS ready FROM n""")
def feature_matrix(spark, d):
    m = _matrix(spark, d)
    named = {"d_speed": ("d_proton_bulk_speed_dt", 5), "d_opdi": ("d_opdi_dt", 7), "mean_5": ("proton_density_rolling_mean_5m", 5), "median_15": ("bmag_gse_rolling_median_15m", 5), "variance_60": ("proton_thermal_rolling_variance_60m", 3), "opdi_median": ("opdi_rolling_median", 6), "anomaly": ("opdi_anomaly", 5), "density_ratio": ("density_compression_ratio", 4), "joint": ("joint_compression_index", 4), "conventional_share": ("phase4_conventional_available_fraction", 6), "opdi_share": ("phase4_opdi_available_fraction", 6)}
    return m.select("event_id", "timestamp", "seq", *[F.round(c, n).alias(k) for k, (c, n) in named.items()], F.col("opdi_persistence").alias("persistence"), F.col("phase4_ready_for_exploratory_ablation").alias("ready"))


@query("SELECT event_id, independent_interval_id, target, count(*) AS records, count(*) FILTER (event_id <> 'error' AND x IS NOT NULL) AS exploratory_rows, round(avg(CASE WHEN x IS NULL THEN 0.25 ELSE 1.0 END), 6) AS conventional_available_fraction FROM series GROUP BY 1, 2, 3")
def matrix_summary(spark, d):
    return P.event_summary(_matrix(spark, d), "event_id", "independent_interval_id", "target").select("event_id", "independent_interval_id", "target", "records", "exploratory_rows", r6(F.col("conventional_available_fraction"), "conventional_available_fraction"))


@query("SELECT DISTINCT event_id FROM series WHERE event_id = 'error'")
def matrix_blocked(spark, d):
    return P.blocked_events(_matrix(spark, d), "event_id")


@query("SELECT 'cross_plane_anomaly' AS feature_group, 2 AS n UNION ALL SELECT 'cross_plane_derivative', 4 UNION ALL SELECT 'cross_plane_opdi', 3 UNION ALL SELECT 'cross_plane_rolling', 3 UNION ALL SELECT 'cross_plane_shape', 5 UNION ALL SELECT 'compression', 6 UNION ALL SELECT 'conventional_derivative', 3 UNION ALL SELECT 'conventional_raw', 8 UNION ALL SELECT 'conventional_rolling', 45", series=False)
def dictionary_groups(spark, d):
    return P.dictionary(spark).groupBy("feature_group").agg(F.count(F.lit(1)).cast("int").alias("n"))


# --- the detector

CONFIG = D.Config(baseline=X.BASELINE, divergences={"x": 0.5, "y": 0.5}, plasma=["x"], field=["y"], steps={"x": 0.6, "y": 0.4}, threshold=1.5, candidate_score=1.2, watch_score=1.4)
_QUIET = f"timestamp BETWEEN TIMESTAMP '{X.BASELINE[0]}' AND TIMESTAMP '{X.BASELINE[1]}'"


def _scale_sql(c: str, table: str, name: str) -> str:
    return f"{name}m AS (SELECT event_id, median({c}) c FROM {table} WHERE {_QUIET} GROUP BY 1), {name} AS (SELECT q.event_id, any_value(m.c) c, CASE WHEN median(abs({c} - m.c)) > 0 THEN 1.4826 * median(abs({c} - m.c)) WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1 END s FROM {table} q JOIN {name}m m ON q.event_id = m.event_id WHERE {_QUIET} GROUP BY 1)"


_DETECT = f"""WITH st AS (SELECT *, abs(x - lag(x, 4) OVER ({_W})) sx, abs(y - lag(y, 4) OVER ({_W})) sy FROM series),
{', '.join(_scale_sql(c, 'st', 'p' + c) for c in ('x', 'y', 'sx', 'sy'))},
z AS (SELECT st.*, (x - px.c) / px.s zx, (y - py.c) / py.s zy, (sx - psx.c) / psx.s zsx, (sy - psy.c) / psy.s zsy FROM st JOIN px ON st.event_id = px.event_id JOIN py ON st.event_id = py.event_id JOIN psx ON st.event_id = psx.event_id JOIN psy ON st.event_id = psy.event_id),
a AS (SELECT *, 0.5 * CASE WHEN zx < 0 THEN 0 ELSE zx END + 0.5 * CASE WHEN zy < 0 THEN 0 ELSE zy END opdi, 0.925 * abs(zx) + 0.075 * abs(zy) conv, 0.6 * coalesce(greatest(zsx, 0), 0) + 0.4 * coalesce(greatest(zsy, 0), 0) score FROM z),
b AS (SELECT *, CASE WHEN opdi IS NULL THEN conv WHEN conv IS NULL THEN opdi ELSE greatest(opdi, conv) END comb, score >= 1.5 f, row_number() OVER ({_W}) n FROM a),
c AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) g FROM b),
e AS (SELECT *, f AND max(n) OVER (PARTITION BY event_id, g, f) - min(n) OVER (PARTITION BY event_id, g, f) + 1 >= 2 AND n = (max(n) OVER (PARTITION BY event_id, g, f) + min(n) OVER (PARTITION BY event_id, g, f) + 1) // 2 AS cp FROM c),
h AS (SELECT *, bool_or(cp) OVER ({_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) alert, bool_or(cp) OVER ({_W} ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) rec FROM e),
o AS (SELECT *, CASE WHEN alert THEN 'ALERT' WHEN rec AND coalesce(conv, 0) >= 1.2 THEN 'ICME CANDIDATE' WHEN coalesce(comb, 0) >= 1.4 OR f THEN 'WATCH' ELSE 'NORMAL' END state FROM h)"""


def detected(spark, d):
    return D.detect(X.series(spark, d), "event_id", "timestamp", "seq", CONFIG)


@query(f"{_DETECT} SELECT event_id, timestamp, seq, round(zx, 5) AS z_x, round(zy, 5) AS z_y, round(opdi, 5) AS opdi_anomaly, round(conv, 5) AS conventional, round(comb, 5) AS combined FROM o")
def anomaly_scores(spark, d):
    return detected(spark, d).select("event_id", "timestamp", "seq", *[F.round(c, 5).alias(c) for c in ("z_x", "z_y", "opdi_anomaly", "conventional", "combined")])


@query(f"{_DETECT} SELECT event_id, timestamp, seq, round(score, 5) AS transition_score, f AS raw_transition FROM o")
def transition_score(spark, d):
    return detected(spark, d).select("event_id", "timestamp", "seq", F.round("transition_score", 5).alias("transition_score"), "raw_transition")


@query(f"{_DETECT} SELECT event_id, timestamp, seq FROM o WHERE cp")
def change_points(spark, d):
    return detected(spark, d).where("is_change_point").select("event_id", "timestamp", "seq")


@query(f"{_DETECT} SELECT event_id, timestamp, seq, state, cp AS is_change_point FROM o")
def detector_states(spark, d):
    return detected(spark, d).select("event_id", "timestamp", "seq", "state", "is_change_point")


@query(f"{_DETECT} SELECT event_id, state, count(*) AS n FROM o GROUP BY 1, 2")
def state_counts(spark, d):
    return detected(spark, d).groupBy("event_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_DETECT}, p AS (SELECT event_id, timestamp, (epoch_us(timestamp) - epoch_us(TIMESTAMP '{X.REFERENCE}')) / 6e7 off FROM o WHERE cp) SELECT event_id, count(*) FILTER (off < 0) AS before, count(*) FILTER (off >= 0) AS after, min(timestamp) FILTER (off >= 0) AS first_after, round(min(off) FILTER (off >= 0), 6) AS delay_min, round(arg_min(off, (abs(off), timestamp)), 6) AS nearest_offset_min FROM p GROUP BY 1")
def detection_eval(spark, d):
    off = (F.unix_micros(F.col("timestamp").cast("timestamp")) - F.unix_micros(F.lit(X.REFERENCE).cast("timestamp_ntz").cast("timestamp"))) / 6e7
    p = detected(spark, d).where("is_change_point").withColumn("off", off)
    later = F.col("off") >= 0
    return p.groupBy("event_id").agg(F.count_if(~later).alias("before"), F.count_if(later).alias("after"), F.min(F.when(later, F.col("timestamp"))).alias("first_after"), r6(F.min(F.when(later, F.col("off"))), "delay_min"), r6(F.min_by("off", F.struct(F.abs("off"), "timestamp")), "nearest_offset_min"))


@query(f"SELECT event_id, timestamp, seq, CASE WHEN timestamp < TIMESTAMP '2024-01-08 12:00:00' THEN 'PRE-EVENT' WHEN timestamp < TIMESTAMP '2024-01-10 18:00:00' THEN 'SHEATH' WHEN timestamp < TIMESTAMP '2024-01-15' THEN 'ICME/EJECTA' ELSE 'POST-EVENT' END AS state FROM series")
def ground_truth_states(spark, d):
    t = lambda s: F.col("timestamp") < F.lit(s).cast("timestamp_ntz")
    state = F.when(t("2024-01-08 12:00:00"), "PRE-EVENT").when(t("2024-01-10 18:00:00"), "SHEATH").when(t("2024-01-15"), "ICME/EJECTA").otherwise("POST-EVENT")
    return X.series(spark, d).select("event_id", "timestamp", "seq", state.alias("state"))


# --- spectra

_PAIR = f"WITH bins AS ({X.BINS_SQL}), pq AS (SELECT a.minute_id, a.k, a.e, a.f f1, b.f f2, sum(a.f) OVER w s1, sum(b.f) OVER w s2, count(*) OVER w n, first_value(ln(a.e)) OVER o x0, last_value(ln(a.e)) OVER o x1 FROM bins a JOIN bins b ON a.minute_id = b.minute_id AND a.k = b.k AND a.plane = 0 AND b.plane = 1 WHERE a.f IS NOT NULL AND b.f IS NOT NULL WINDOW w AS (PARTITION BY a.minute_id), o AS (PARTITION BY a.minute_id ORDER BY a.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), u AS (SELECT *, f1 / s1 p, f2 / s2 q, (ln(e) - x0) / (x1 - x0) x FROM pq), g AS (SELECT *, abs(sum(p - q) OVER (PARTITION BY minute_id ORDER BY k ROWS UNBOUNDED PRECEDING)) * coalesce(x - lag(x) OVER (PARTITION BY minute_id ORDER BY k), 0) ws FROM u), t AS (SELECT minute_id, any_value(n) n, sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q))) js, sqrt(0.5 * sum(power(sqrt(p) - sqrt(q), 2))) h, sum(ws) w FROM g GROUP BY 1)"


def divergences(spark, d):
    p = X.pairs(spark, d).select("minute_id", S.probabilities(F.col("f1")).alias("p"), S.probabilities(F.col("f2")).alias("q"))
    return p.select("minute_id", S.divergences(F.col("p"), F.col("q"), S.grid_column()).alias("v"))


@query(f"{_PAIR} SELECT minute_id, round(js, 6) AS js, round(h, 6) AS hellinger, round(w, 6) AS wasserstein FROM t", series=False)
def opdi_triple(spark, d):
    return divergences(spark, d).select("minute_id", *[r6(F.col(f"v.{c}"), c) for c in ("js", "hellinger", "wasserstein")])


@query(f"WITH bins AS ({X.BINS_SQL}) SELECT minute_id, plane, k, round(f / sum(f) OVER (PARTITION BY minute_id, plane), 8) AS p FROM bins", series=False)
def normalize_spectrum(spark, d):
    s = X.spectra(spark, d).select("minute_id", "plane", F.posexplode(S.probabilities(F.col("flux"))).alias("k", "p"))
    return s.select("minute_id", "plane", long(F.col("k")).alias("k"), F.round("p", 8).alias("p"))


_SHAPE = f"""WITH bins AS ({X.BINS_SQL}), ok AS (SELECT minute_id FROM bins GROUP BY 1 HAVING count(f) = 128), u AS (SELECT b.*, f / sum(f) OVER (PARTITION BY b.minute_id, plane) p FROM bins b JOIN ok ON b.minute_id = ok.minute_id),
m AS (SELECT minute_id, plane, sum(p * e) c, arg_max(e, (p, -k)) pk, sqrt(sum(p * e * e) - power(sum(p * e), 2)) w FROM u GROUP BY 1, 2),
x AS (SELECT a.minute_id, sum(a.p * b.p) / sqrt(sum(a.p * a.p) * sum(b.p * b.p)) s FROM u a JOIN u b ON a.minute_id = b.minute_id AND a.k = b.k AND a.plane = 0 AND b.plane = 1 GROUP BY 1)"""


@query(f"{_SHAPE} SELECT x.minute_id, round(s, 6) AS cosine, round(acos(s), 5) AS angle, round(a.c, 3) AS centroid1, round(b.c, 3) AS centroid2, round(a.c - b.c, 3) AS centroid_delta, round(a.w, 3) AS width1, round(b.w, 3) AS width2, round(a.w - b.w, 3) AS width_delta, round(a.pk, 3) AS peak1, round(b.pk, 3) AS peak2, round(ln(a.pk / b.pk), 6) AS log_peak_ratio FROM x JOIN m a ON a.minute_id = x.minute_id AND a.plane = 0 JOIN m b ON b.minute_id = x.minute_id AND b.plane = 1", series=False)
def spectral_shape(spark, d):
    v = X.pairs(spark, d).select("minute_id", S.shape(F.col("f1"), F.col("f2"), S.grid_column()).alias("v")).where("v is not null")
    places = {"cosine": 6, "angle": 5, "log_peak_ratio": 6}
    return v.select("minute_id", *[F.round(f"v.{c}", places.get(c, 3)).alias(c) for c in ("cosine", "angle", "centroid1", "centroid2", "centroid_delta", "width1", "width2", "width_delta", "peak1", "peak2", "log_peak_ratio")])


@query(f"WITH bins AS ({X.BINS_SQL}) SELECT label, k, round(median(f), 8) AS f FROM bins GROUP BY 1, 2", series=False)
def vector_median(spark, d):
    s = X.spectra(spark, d).select("label", F.posexplode("flux").alias("k", "f"))
    return s.groupBy("label", long(F.col("k")).alias("k")).agg(F.round(T.median("f"), 8).alias("f"))


@query(f"""WITH bins AS ({X.BINS_SQL}), src AS (SELECT minute_id, plane, e, f FROM bins WHERE k % 2 = 0 AND f IS NOT NULL), n AS (SELECT minute_id, plane FROM src GROUP BY 1, 2 HAVING count(*) >= 16), grid AS (SELECT k, any_value(e) g FROM bins WHERE k % 4 = 1 GROUP BY 1),
lo AS (SELECT n.minute_id, n.plane, k, g, max(e) a FROM n JOIN src s ON n.minute_id = s.minute_id AND n.plane = s.plane JOIN grid ON e <= g GROUP BY 1, 2, 3, 4), hi AS (SELECT n.minute_id, n.plane, k, min(e) b FROM n JOIN src s ON n.minute_id = s.minute_id AND n.plane = s.plane JOIN grid ON e >= g GROUP BY 1, 2, 3)
SELECT lo.minute_id, lo.plane, lo.k, round(exp(ln(p.f) + CASE WHEN b > a THEN (ln(g) - ln(a)) / (ln(b) - ln(a)) ELSE 0 END * (ln(q.f) - ln(p.f))), 8) AS f FROM lo JOIN hi ON lo.minute_id = hi.minute_id AND lo.plane = hi.plane AND lo.k = hi.k JOIN src p ON p.minute_id = lo.minute_id AND p.plane = lo.plane AND p.e = a JOIN src q ON q.minute_id = lo.minute_id AND q.plane = lo.plane AND q.e = b""", series=False)
def regrid_loglog(spark, d):
    grid = S.energy_grid()
    points = F.filter(F.zip_with(S.grid_column(), "flux", lambda e, f: F.struct(e.alias("e"), f.alias("f"))), lambda b, i: i % 2 == 0)
    wanted = [k for k in range(64) if k % 4 == 1]
    out = X.spectra(spark, d).select("minute_id", "plane", F.posexplode(S.regrid(points, [grid[k] for k in wanted], 16)).alias("_i", "f")).where("f is not null")
    return out.select("minute_id", "plane", long(F.col("_i") * 4 + 1).alias("k"), F.round("f", 8).alias("f"))


@query(f"WITH bins AS ({X.BINS_SQL}) SELECT minute_id, plane, k, round(log10(f), 6) AS v FROM bins", series=False)
def log_spectrogram(spark, d):
    s = X.spectra(spark, d).select("minute_id", "plane", F.posexplode(F.transform("flux", lambda x: F.when(x > 0, F.log10(x)))).alias("k", "v"))
    return s.select("minute_id", "plane", long(F.col("k")).alias("k"), r6(F.col("v"), "v"))


@query(f"WITH bins AS ({X.BINS_SQL}) SELECT label, round(count(f)::DOUBLE / count(*), 6) AS fraction FROM bins GROUP BY 1", series=False)
def finite_fraction(spark, d):
    there = F.size(F.filter("flux", lambda x: x.isNotNull()))
    return X.spectra(spark, d).groupBy("label").agg(r6(F.sum(there) / F.sum(F.size("flux")), "fraction"))


# --- evaluation

_LOO = f"""WITH f AS (SELECT s.*, i.fold, s.independent_interval_id = i.fold AS test FROM series s, (SELECT DISTINCT independent_interval_id fold FROM series) i),
m AS (SELECT fold, median(x) c FROM f WHERE NOT test AND target = 0 GROUP BY 1), p AS (SELECT f.fold, any_value(c) c, CASE WHEN 1.4826 * median(abs(x - c)) > 1e-12 THEN 1.4826 * median(abs(x - c)) ELSE stddev_pop(x) END s FROM f JOIN m ON f.fold = m.fold WHERE NOT test AND target = 0 GROUP BY 1),
l AS (SELECT f.fold, quantile_cont(abs((x - c) / s), 0.99) t FROM f JOIN p ON f.fold = p.fold WHERE NOT test AND target = 0 GROUP BY 1),
q AS (SELECT f.*, abs((x - c) / s) score, t, coalesce(abs((x - c) / s) >= t, false) f FROM f JOIN p ON f.fold = p.fold JOIN l ON l.fold = f.fold WHERE test), {_RUN}, o AS (SELECT *, CASE WHEN run >= 3 THEN 1 ELSE 0 END AS predicted FROM n)"""


def _loo(spark, d):
    return E.loo_predictions(X.series(spark, d), "independent_interval_id", "event_id", "timestamp", "seq", "x", "target")


@query(f"{_LOO} SELECT event_id, timestamp, seq, fold, round(score, 5) AS score, round(t, 5) AS threshold, f AS raw, predicted FROM o")
def loo_predictions(spark, d):
    return _loo(spark, d).select("event_id", "timestamp", "seq", "fold", F.round("score", 5).alias("score"), F.round("threshold", 5).alias("threshold"), "raw", "predicted")


@query(f"{_LOO}, c AS (SELECT fold, count(*) FILTER (target = 0 AND predicted = 0) AS tn, count(*) FILTER (target = 0 AND predicted = 1) AS fp, count(*) FILTER (target = 1 AND predicted = 0) AS fn, count(*) FILTER (target = 1 AND predicted = 1) AS tp FROM (SELECT fold, target, CASE WHEN f THEN 1 ELSE 0 END predicted FROM o) GROUP BY 1), r AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) pr, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) re FROM c) SELECT fold, tn, fp, fn, tp, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM r")
def ablation_metrics(spark, d):
    c = T.confusion(_loo(spark, d).withColumn("p", F.col("raw").cast("int")), ["fold"], "target", "p")
    return c.select("fold", "tn", "fp", "fn", "tp", *[r6(F.col(m), m) for m in ("precision", "recall", "f1")])


_GROUPS = """WITH s AS (SELECT *, y * y AS y2 FROM series), f AS (SELECT s.*, i.fold, s.independent_interval_id = i.fold AS test FROM s, (SELECT DISTINCT independent_interval_id fold FROM s) i),
v AS (SELECT fold, unnest([1, 2, 3]) k, unnest([x, y, y2]) v FROM f WHERE NOT test AND target = 0), m AS (SELECT fold, k, median(v) c FROM v GROUP BY 1, 2),
p AS (SELECT v.fold, v.k, any_value(c) c, CASE WHEN 1.4826 * median(abs(v - c)) > 1e-12 THEN 1.4826 * median(abs(v - c)) ELSE stddev_pop(v) END s FROM v JOIN m ON v.fold = m.fold AND v.k = m.k GROUP BY 1, 2),
z AS (SELECT f.*, abs((x - a.c) / a.s) zx, abs((y - b.c) / b.s) zy, abs((y2 - e.c) / e.s) zz FROM f JOIN p a ON a.fold = f.fold AND a.k = 1 JOIN p b ON b.fold = f.fold AND b.k = 2 JOIN p e ON e.fold = f.fold AND e.k = 3),
g AS (SELECT *, (zx + zy) / 2 conventional, (zy + zz) / 2 opdi FROM z), h AS (SELECT *, coalesce((conventional + opdi) / 2, conventional, opdi) combined FROM g)"""
_MODES = f"""{_GROUPS}, t AS (SELECT event_id, timestamp, seq, target, fold, test, unnest(['conventional', 'opdi', 'combined']) mode, unnest([conventional, opdi, combined]) score FROM h), l AS (SELECT fold, mode, quantile_cont(score, 0.99) threshold FROM t WHERE NOT test AND target = 0 GROUP BY 1, 2),
q AS (SELECT t.*, threshold, coalesce(score >= threshold, false) f FROM t JOIN l ON l.fold = t.fold AND l.mode = t.mode WHERE test), i AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY mode, event_id ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) g FROM q),
o AS (SELECT *, CASE WHEN sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY mode, event_id, g ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) >= 3 THEN 1 ELSE 0 END AS predicted FROM i)"""


def _group_scores(spark, d):
    s = X.series(spark, d).withColumn("y2", F.col("y") * F.col("y"))
    return E.group_scores(s, "independent_interval_id", "target", {"conventional": ["x", "y"], "opdi": ["y", "y2"]})


def _mode_predictions(spark, d):
    return E.mode_predictions(_group_scores(spark, d), "event_id", "timestamp", "seq", "target", ["conventional", "opdi", "combined"])


@query(f"{_GROUPS} SELECT event_id, timestamp, seq, fold, round(conventional, 5) AS conventional, round(opdi, 5) AS opdi, round(combined, 5) AS combined FROM h WHERE test")
def group_score(spark, d):
    return _group_scores(spark, d).where("role = 'test'").select("event_id", "timestamp", "seq", "fold", *[F.round(c, 5).alias(c) for c in ("conventional", "opdi", "combined")])


@query(f"{_MODES} SELECT mode, event_id, timestamp, seq, fold, round(score, 5) AS score, round(threshold, 5) AS threshold, f AS raw, predicted FROM o")
def mode_predictions(spark, d):
    return _mode_predictions(spark, d).select("mode", "event_id", "timestamp", "seq", "fold", F.round("score", 5).alias("score"), F.round("threshold", 5).alias("threshold"), "raw", "predicted")


@query(f"""{_MODES}, k AS (SELECT * FROM o WHERE score IS NOT NULL), c AS (SELECT mode, count(*) FILTER (target = 0 AND predicted = 0) tn, count(*) FILTER (target = 0 AND predicted = 1) fp, count(*) FILTER (target = 1 AND predicted = 0) fn, count(*) FILTER (target = 1 AND predicted = 1) tp FROM k GROUP BY 1),
e AS (SELECT mode, predicted = 1 AND lag(predicted, 1, 0) OVER (PARTITION BY mode, event_id ORDER BY timestamp, seq) = 0 AS e FROM k WHERE target = 0), a AS (SELECT mode, count(*) FILTER (e) episodes, count(*) n FROM e GROUP BY 1),
w AS (SELECT mode, event_id, min(timestamp) FILTER (target = 1) onset, min(timestamp) s, max(predicted) detected FROM k GROUP BY 1, 2), y AS (SELECT k.mode, k.event_id, min(timestamp) hit FROM k JOIN w ON k.mode = w.mode AND k.event_id = w.event_id WHERE predicted = 1 AND timestamp >= onset GROUP BY 1, 2),
b AS (SELECT w.mode, count(*) positive_events, sum(detected)::BIGINT detected_events, median(CASE WHEN onset > s THEN (epoch_us(hit) - epoch_us(onset)) / 6e7 END) delay FROM w LEFT JOIN y ON w.mode = y.mode AND w.event_id = y.event_id WHERE onset IS NOT NULL GROUP BY 1)
SELECT c.mode, tn, fp, fn, tp, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, episodes, round(episodes / (n / 1440.0), 6) AS false_alarms_per_day, positive_events, detected_events, round(detected_events / positive_events::DOUBLE, 6) AS detection_rate, round(delay, 6) AS median_delay_min FROM c LEFT JOIN a ON c.mode = a.mode LEFT JOIN b ON c.mode = b.mode""")
def ablation_summary(spark, d):
    out = E.mode_summary(_mode_predictions(spark, d), "event_id", "timestamp", "seq", "target")
    return out.select("mode", "tn", "fp", "fn", "tp", *[r6(F.col(c), c) for c in ("precision", "recall")], "episodes", r6(F.col("false_alarms_per_day"), "false_alarms_per_day"), "positive_events", "detected_events", *[r6(F.col(c), c) for c in ("detection_rate", "median_delay_min")])


_AREAS = f"""{_MODES}, k AS (SELECT * FROM o WHERE score IS NOT NULL), c AS (SELECT mode, count(*) FILTER (target = 0 AND predicted = 1) fp, count(*) FILTER (target = 1 AND predicted = 0) fn, count(*) FILTER (target = 1 AND predicted = 1) tp FROM k GROUP BY 1), f1 AS (SELECT mode, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) f1 FROM c),
u AS (SELECT mode, target, sum(target) OVER r::DOUBLE tp, row_number() OVER r AS i FROM k WINDOW r AS (PARTITION BY mode ORDER BY score DESC, event_id, timestamp, seq ROWS UNBOUNDED PRECEDING)), a AS (SELECT mode, sum(target * (tp / i + coalesce((tp - target) / nullif(i - 1, 0), 1)) / 2) / sum(target) AS pr FROM u GROUP BY 1),
vs AS (SELECT mode, score, count(*) FILTER (target = 1)::DOUBLE p, count(*) FILTER (target = 0)::DOUBLE n FROM k GROUP BY 1, 2), x AS (SELECT mode, p, n, sum(p) OVER (PARTITION BY mode ORDER BY score DESC ROWS UNBOUNDED PRECEDING) tp FROM vs), b AS (SELECT mode, sum(n * (tp - p / 2)) / (sum(p) * sum(n)) AS roc FROM x GROUP BY 1)"""


@query(f"{_AREAS} SELECT f1.mode, round(f1, 6) AS f1, round(pr, 6) AS pr_auc, round(roc, 6) AS roc_auc, row_number() OVER (ORDER BY pr DESC, f1 DESC) AS place FROM f1 JOIN a ON a.mode = f1.mode JOIN b ON b.mode = f1.mode")
def mode_ranking(spark, d):
    """Metrics of stored predictions by mode, and the modes' places."""
    out = E.ranking(E.mode_summary(_mode_predictions(spark, d), "event_id", "timestamp", "seq", "target"), "mode")
    return out.select("mode", *[r6(F.col(c), c) for c in ("f1", "pr_auc", "roc_auc")], long(F.col("place")).alias("place"))


@query(f"""{_AREAS}, md AS (SELECT max(f1) FILTER (f1.mode = 'conventional') cf, max(f1) FILTER (f1.mode = 'opdi') pf, max(f1) FILTER (f1.mode = 'combined') bf, max(pr) FILTER (f1.mode = 'conventional') ca, max(pr) FILTER (f1.mode = 'opdi') pa, max(pr) FILTER (f1.mode = 'combined') ba FROM f1 JOIN a ON a.mode = f1.mode)
SELECT round(pf - cf, 6) AS opdi_f1, round(bf - cf, 6) AS combined_f1, round(pa - ca, 6) AS opdi_pr_auc, round(ba - ca, 6) AS combined_pr_auc, CASE WHEN bf > cf AND ba > ca THEN 'EXPLORATORY_SUPPORT_FOR_ADDED_OPDI_INFORMATION' WHEN bf < cf AND ba < ca THEN 'EXPLORATORY_RESULTS_DO_NOT_SUPPORT_ADDED_OPDI_INFORMATION' ELSE 'EXPLORATORY_MIXED_EVIDENCE' END AS evidence_status FROM md""")
def ablation_verdict(spark, d):
    i = E.improvements(E.mode_summary(_mode_predictions(spark, d), "event_id", "timestamp", "seq", "target"))
    return i.select(*[r6(F.col(f"{m}_minus_conventional_{c}"), f"{m}_{c}") for c in ("f1", "pr_auc") for m in ("opdi", "combined")], "evidence_status")


@query("WITH o AS (SELECT independent_interval_id AS fold, count(*) test_rows, count(*) FILTER (target = 1) p, count(*) FILTER (target = 0) n FROM series GROUP BY 1) SELECT fold, test_rows, (SELECT sum(p) FROM o)::BIGINT - p AS train_positive_rows, (SELECT sum(n) FROM o)::BIGINT - n AS train_negative_rows, (SELECT sum(p) FROM o) > p AND (SELECT sum(n) FROM o) > n AS usable FROM o")
def leakage_checks(spark, d):
    return E.leakage_checks(X.series(spark, d), "independent_interval_id", "target")


_HITS = f"WITH k AS (SELECT *, CASE WHEN coalesce(x > 70, false) THEN 1 ELSE 0 END predicted FROM series)"


def _hits(spark, d):
    return X.series(spark, d).withColumn("predicted", F.coalesce(F.col("x") > 70, F.lit(False)).cast("int"))


@query(f"{_HITS}, e AS (SELECT event_id, predicted = 1 AND lag(predicted, 1, 0) OVER ({_W}) = 0 AS e FROM k WHERE target = 0) SELECT event_id, count(*) FILTER (e) AS episodes, count(*) AS negative_rows FROM e GROUP BY 1")
def false_alarm_episodes(spark, d):
    return E.false_alarm_episodes(_hits(spark, d), "event_id", "timestamp", "seq", "target", "predicted")


@query(f"{_HITS}, o AS (SELECT event_id, min(timestamp) s, min(timestamp) FILTER (target = 1) onset, max(predicted) detected FROM k GROUP BY 1), h AS (SELECT k.event_id, min(timestamp) hit FROM k JOIN o ON k.event_id = o.event_id WHERE predicted = 1 AND timestamp >= onset GROUP BY 1) SELECT o.event_id, CASE WHEN onset > s THEN onset END AS onset, coalesce(onset > s, false) AS internal_onset, CASE WHEN onset > s THEN 'INTERNAL_LABELED_BOUNDARY' WHEN onset IS NOT NULL THEN 'WINDOW_START_NOT_EXACT_ONSET' END AS onset_status, detected, (SELECT min(timestamp) FROM k WHERE predicted = 1 AND k.event_id = o.event_id) AS detected_at, (SELECT count(*) FROM k WHERE target = 1 AND k.event_id = o.event_id) AS positive_rows, round(CASE WHEN onset > s THEN (epoch_us(hit) - epoch_us(onset)) / 6e7 END, 6) AS delay_min FROM o LEFT JOIN h ON h.event_id = o.event_id")
def detection_delay(spark, d):
    return E.detection_delay(_hits(spark, d), "event_id", "timestamp", "target", "predicted").withColumn("delay_min", F.round("delay_min", 6))


_SCORED = "WITH s AS (SELECT d.doc_id, l.quality AS target, d.n_chars::DOUBLE AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scored(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(X.table(spark, d, "labels").select("doc_id", F.col("quality").alias("target")), "doc_id")


@query(f"{_SCORED}, g AS (SELECT count(*) FILTER (target = 0 AND score < 1000) AS tn, count(*) FILTER (target = 0 AND score >= 1000) AS fp, count(*) FILTER (target = 1 AND score < 1000) AS fn, count(*) FILTER (target = 1 AND score >= 1000) AS tp FROM s) SELECT tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM g", series=False)
def confusion_prf(spark, d):
    c = T.confusion(_scored(spark, d).withColumn("p", (F.col("score") >= 1000).cast("int")), [], "target", "p")
    return c.select("tn", "fp", "fn", "tp", *[r6(F.col(m), m) for m in ("precision", "recall", "f1")])


@query(f"{_SCORED} SELECT round(sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*), 6) AS roc_auc FROM s p, s n WHERE p.target = 1 AND n.target = 0", series=False)
def roc_auc(spark, d):
    return T.roc_auc(_scored(spark, d), "target", "score").withColumn("roc_auc", F.round("roc_auc", 6))


_PR = "p AS (SELECT *, tp / (SELECT sum(target) FROM s) r, tp / (tp + fp) q FROM c), a AS (SELECT (r - lag(r, 1, 0) OVER w) * (q + lag(q, 1, 1) OVER w) / 2 a FROM p WINDOW w AS (ORDER BY score DESC{ties})) SELECT round(sum(a), 6) AS pr_auc FROM a"


@query(f"{_SCORED}, g AS (SELECT score, sum(target)::DOUBLE t, count(*) n FROM s GROUP BY 1), c AS (SELECT score, sum(t) OVER (ORDER BY score DESC) tp, sum(n - t) OVER (ORDER BY score DESC) fp FROM g), {_PR.format(ties='')}", series=False)
def pr_auc_distinct(spark, d):
    return T.pr_auc_distinct(_scored(spark, d), "target", "score").withColumn("pr_auc", F.round("pr_auc", 6))


@query(f"{_SCORED}, c AS (SELECT *, sum(target) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::DOUBLE tp, sum(1 - target) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::DOUBLE fp FROM s), {_PR.format(ties=', doc_id')}", series=False)
def pr_auc_stable(spark, d):
    return T.pr_auc_stable(_scored(spark, d), "target", "score", "doc_id").withColumn("pr_auc", F.round("pr_auc", 6))


@query("WITH a AS (SELECT x FROM series WHERE event_id = 'click' AND x IS NOT NULL), b AS (SELECT x FROM series WHERE event_id = 'view' AND x IS NOT NULL), u AS (SELECT sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END)::DOUBLE u, count(*)::DOUBLE n FROM a, b) SELECT round(u, 1) AS u, round(2 * u / n - 1, 6) AS cliffs_delta FROM u")
def mann_whitney_u(spark, d):
    return T.mann_whitney(X.series(spark, d), "event_id", "x", "click", "view").select(F.round("u", 1).alias("u"), r6(F.col("cliffs_delta"), "cliffs_delta"))


@query()
def mann_whitney_p(spark, d):
    return T.mann_whitney(X.series(spark, d), "event_id", "x", "click", "view").select("p")


@query("SELECT 'x' AS feature, round(count(x)::DOUBLE / count(*), 6) AS available, count(DISTINCT x) AS n_unique, 'SELECTED' AS reason FROM series UNION ALL SELECT 'y', 1.0, count(DISTINCT y), 'SELECTED' FROM series UNION ALL SELECT 'k', 1.0, 1, 'CONSTANT_OR_EMPTY' UNION ALL SELECT 'z', round(count(*) FILTER (target = 1)::DOUBLE / count(*), 6), count(DISTINCT seq) FILTER (target = 1), 'LOW_AVAILABILITY' FROM series")
def feature_selection(spark, d):
    s = X.series(spark, d).withColumns({"k": F.lit(1), "z": F.when(F.col("target") == 1, F.col("seq"))})
    return learning.selection(s, ["x", "y", "k", "z"]).withColumn("available", F.round("available", 6))


_MODELS = "WITH p AS (SELECT l_orderkey, 'a' AS model, l_discount * 5 AS probability FROM lineitem UNION ALL SELECT l_orderkey, 'b', l_tax * 10 FROM lineitem)"


@query(f"{_MODELS}, m AS (SELECT l_orderkey, least(1.0, greatest(0.0, avg(probability))) p, string_agg(DISTINCT model, '|' ORDER BY model) models FROM p GROUP BY 1) SELECT l_orderkey, round(p, 6) AS probability, models, round(p, 9) >= 0.5 AS positive, round(greatest(p, 1 - p), 6) AS confidence FROM m", series=False)
def ensemble_confidence(spark, d):
    li = X.table(spark, d, "lineitem")
    p = li.select("l_orderkey", F.explode(F.array(F.struct(F.lit("a").alias("model"), (F.col("l_discount") * 5).alias("probability")), F.struct(F.lit("b").alias("model"), (F.col("l_tax") * 10).alias("probability")))).alias("m")).select("l_orderkey", "m.*")
    out = learning.ensemble(p, "l_orderkey")
    return out.select("l_orderkey", r6(F.col("probability"), "probability"), "models", (F.round("probability", 9) >= 0.5).alias("positive"), r6(F.col("confidence"), "confidence"))


@query("WITH g AS (SELECT l_returnflag AS model, l_suppkey AS feature, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY v DESC, feature) n FROM g) SELECT model, feature, round(v, 6) AS importance, n AS place FROM r WHERE n <= 20", series=False)
def importance_topk(spark, d):
    g = X.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_suppkey").alias("feature")).agg(F.avg("l_quantity").alias("v"))
    top = learning.top_importances(g.withColumnRenamed("v", "normalized_importance"))
    return top.select("model", "feature", r6(F.col("importance"), "importance"), long(F.col("place")).alias("place"))


@query("WITH g AS (SELECT o_orderpriority AS model, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS pr_auc, max(o_totalprice) f1 FROM orders GROUP BY 1) SELECT model, row_number() OVER (ORDER BY pr_auc DESC NULLS LAST, f1 DESC, model) AS place FROM g", series=False)
def model_ranking(spark, d):
    g = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("pr_auc"), F.max("o_totalprice").alias("f1"))
    return E.ranking(g).select("model", long(F.col("place")).alias("place"))


# --- ranking of source events

_CME = f"""WITH c AS ({X.CANDIDATE_SQL}), q AS (SELECT *, coalesce(space_speed_km_s, linear_speed_km_s) v, (epoch_us(TIMESTAMP '{X.RANK_REFERENCE}') - epoch_us(cme_time)) / 36e8 h, regexp_matches(coalesce(source_location, ''), '^[NS][0-9]{{1,2}}[EW][0-9]{{1,2}}') ok FROM c),
r AS (SELECT *, exp(-abs(h - 149597870.7 / v / 3600) / 30) ts, CASE WHEN ok THEN 0.5 * greatest(0, 1 - regexp_extract(source_location, '^[NS]([0-9]{{1,2}})', 1)::DOUBLE / 90) + 0.5 * greatest(0, 1 - regexp_extract(source_location, '[EW]([0-9]{{1,2}})', 1)::DOUBLE / 90) ELSE 0.5 END ds, CASE WHEN lower(trim(halo)) IN ('true', '1', 'yes', 'y', 'halo') THEN 1.0::DOUBLE ELSE 0.2 END hs, least(1.0, greatest(0.0, (v - 250) / 1000)) ss FROM q)"""


def ranked(spark):
    return R.rank_candidates(X.candidates(spark), F.lit(X.RANK_REFERENCE).cast("timestamp_ntz"))


@query(f"{_CME} SELECT cme_time, round(0.45 * ts + 0.25 * ds + 0.2 * hs + 0.1 * ss, 6) AS score, row_number() OVER (ORDER BY 0.45 * ts + 0.25 * ds + 0.2 * hs + 0.1 * ss DESC) AS place FROM r", series=False)
def cme_ranking(spark, d):
    return ranked(spark).select("cme_time", r6(F.col("score"), "score"), long(F.row_number().over(Window.orderBy(F.desc("score")))).alias("place"))


@query(f"{_CME} SELECT cme_time, round(ds, 6) AS direction_score, hs::DOUBLE AS halo_score, round(ts, 6) AS transit_score, round(ss, 6) AS speed_score FROM r", series=False)
def direction_and_halo(spark, d):
    return ranked(spark).select("cme_time", r6(F.col("direction_score"), "direction_score"), "halo_score", r6(F.col("transit_score"), "transit_score"), r6(F.col("speed_score"), "speed_score"))


# --- replay queries


@query("SELECT event_id, timestamp, seq, x, y FROM series WHERE event_id = 'click' AND timestamp BETWEEN TIMESTAMP '2024-01-09 21:00:00' AND TIMESTAMP '2024-01-10 03:00:00'")
def replay_window(spark, d):
    t = F.lit(X.REFERENCE).cast("timestamp_ntz")
    return X.series(spark, d).where((F.col("event_id") == "click") & F.col("timestamp").between(t - F.expr("interval 3 hours"), t + F.expr("interval 3 hours"))).select("event_id", "timestamp", "seq", "x", "y")


@query(f"{_DETECT}, w AS (SELECT event_id, seq, opdi, conv, comb, score FROM o WHERE event_id = 'click') SELECT seq, 'opdi' AS part, round(coalesce(greatest(opdi, 0), 0), 5) AS v FROM w UNION ALL SELECT seq, 'conventional', round(coalesce(greatest(conv, 0), 0), 5) FROM w UNION ALL SELECT seq, 'combined', round(coalesce(greatest(comb, 0), 0), 5) FROM w UNION ALL SELECT seq, 'transition', round(coalesce(greatest(score, 0), 0), 5) FROM w")
def evidence_breakdown(spark, d):
    o = detected(spark, d).where("event_id = 'click'").select("seq", F.expr("stack(4, 'opdi', opdi_anomaly, 'conventional', conventional, 'combined', combined, 'transition', transition_score) as (part, v)"))
    return o.select("seq", "part", F.round(F.coalesce(M.clip_low(F.col("v")), F.lit(0.0)), 5).alias("v"))


@query("WITH r AS (SELECT event_id, min(timestamp) a FROM series GROUP BY 1) SELECT event_id, a AS first, CASE WHEN event_id = 'error' THEN 'NOT AVAILABLE' ELSE 'NORMAL' END AS shown FROM r")
def state_display(spark, d):
    r = X.series(spark, d).groupBy("event_id").agg(F.min("timestamp").alias("first"))
    state = F.when(F.col("event_id") == "error", "DATA ONLY").otherwise("NORMAL")
    return r.select("event_id", "first", Y.shown(state).alias("shown"))


@query(f"{_DETECT}, p AS (SELECT event_id, timestamp, x, (epoch_us(timestamp) - epoch_us(TIMESTAMP '{X.REFERENCE}')) / 6e7 off FROM o WHERE cp AND event_id = 'click') SELECT arg_min(timestamp, (abs(off), timestamp)) AS detected_at, round(arg_min(off, (abs(off), timestamp)), 6) AS offset_minutes, round(arg_min(coalesce(x, -1), (abs(off), timestamp)), 6) AS x, coalesce(arg_min(timestamp, (abs(off), timestamp)), TIMESTAMP '{X.REFERENCE}') AS match_time FROM p")
def primary_transition(spark, d):
    out = Y.primary_transition(detected(spark, d).where("event_id = 'click'"), F.lit(X.REFERENCE).cast("timestamp_ntz"), "timestamp", "x")
    return out.select("detected_at", r6(F.col("offset_minutes"), "offset_minutes"), r6(F.when(F.col("detected_at").isNotNull(), F.coalesce("x", F.lit(-1.0))), "x"), "match_time")


@query("SELECT count(*) AS records, round(median(x), 6) AS js_median, count(*) FILTER (event_id = 'view') AS view_minutes FROM series")
def upload_summary(spark, d):
    out = Y.upload_summary(X.series(spark, d).select("timestamp", F.col("x").alias("js_opdi"), F.col("event_id").alias("state")))
    return out.select("records", r6(F.col("js_median"), "js_median"), F.col("states")["view"].alias("view_minutes"))


@query("WITH a AS (SELECT min(timestamp) t FROM series WHERE independent_interval_id = 'I1' AND x IS NOT NULL), m AS (SELECT (least(1, x / 100) + least(1, x / 50)) / 2 p FROM series WHERE independent_interval_id = 'I1' AND timestamp = (SELECT t FROM a)) SELECT 'I1' AS independent_interval_id, round(least(1.0, greatest(0.0, p)), 6) AS probability, 'a|b' AS models, least(1.0, greatest(0.0, p)) >= 0.5 AS positive FROM m")
def prediction_lookup(spark, d):
    s = X.series(spark, d).where("x is not null")
    at = s.where("independent_interval_id = 'I1'").agg(F.min("timestamp")).first()[0]  # the minute that is asked for
    p = s.select("independent_interval_id", "timestamp", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.least(F.lit(1.0), F.col("x") / q).alias("probability")) for m, q in (("a", 100), ("b", 50))])).alias("_m")).select("independent_interval_id", "timestamp", "_m.*")
    return Y.prediction_at(p, "I1", F.lit(at)).select("independent_interval_id", r6(F.col("probability"), "probability"), "models", "positive")


@query("SELECT event_id, timestamp, seq, CAST(NULL AS DOUBLE) AS z_js_opdi, x AS transition_score, false AS is_change_point, CASE WHEN x > 50 THEN 'WATCH' ELSE 'NOT AVAILABLE' END AS state FROM series")
def replay_columns(spark, d):
    s = X.series(spark, d).select("event_id", "timestamp", "seq", F.col("x").alias("transition_score"), F.when(F.col("x") > 50, "WATCH").alias("state"))
    return Y.with_replay_columns(s).select("event_id", "timestamp", "seq", "z_js_opdi", "transition_score", "is_change_point", "state")


# --- streaming and learning


@query("SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events GROUP BY 1, 2", series=False)
def minute_windows(spark, d):
    out = minute_stream(X.table(spark, d, "events"))
    return out.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "event_type", "n", r6(F.col("mean"), "mean"), r6(F.col("median"), "median"))


def _learn(kind: str):
    features = ["x", "y", "y2"]

    def rows(spark, d):
        return X.series(spark, d).withColumn("y2", F.col("y") * F.col("y"))

    @query(name=f"ml_{kind}")
    def run(spark, d):
        out = learning.held_out(rows(spark, d), kind, features, "target", "independent_interval_id", "event_id", "timestamp", "seq")
        return out.select("event_id", "timestamp", "seq", "fold", "raw_predicted", "probability", "predicted")

    @query(name=f"ml_{kind}_importance")
    def importance(spark, d):
        return learning.held_out_importances(rows(spark, d), kind, features, "target", "independent_interval_id")


for _k in ("logistic", "forest", "boosted"):
    _learn(_k)
