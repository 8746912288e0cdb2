"""Rules on texts, and host verdicts: failures by host, shrunk towards an empirical beta prior. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_side, let, materialize, words_column

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
#: A host is refused if the shrunk rate of some rule is above this ...
HOST_RATE = 0.5
#: ... by this many posterior standard deviations.
HOST_SIGMAS = 2.0
#: Rules whose failures are counted by host, as SQL conditions on the measured columns.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
}
BASE_RULES = ("few_words", "repeats")


def _repeat_words(words: Column, w: int) -> Column:
    """Words in windows of w words that are found twice or more. Windows are compared by their 64-bit hash."""

    def from_windows(wins: Column) -> Column:
        # sorted by (hash, place), equal windows are neighbours
        def marked(s: Column) -> Column:
            at = lambda i: F.get(s, i)["h"]
            return F.array_sort(F.transform(F.filter(F.transform(s, lambda x, i: F.when((at(i - 1) == x["h"]) | (at(i + 1) == x["h"]), x["p"]).otherwise(F.lit(-1))), lambda p: p >= 0), lambda p: p))

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda x, i: F.least(F.lit(w), F.coalesce(F.get(p, i + 1) - x, F.lit(w))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        sort = lambda: F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0).cast("long")).otherwise(let(sort(), lambda s: let(marked(s), covered)))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(w)]))

    few = F.size(words) < w
    return F.when(few, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda x: F.xxhash64(x)), lambda h: let(windows(h), from_windows)))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; all 0 for null."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    count = lambda c: c.cast("long")
    return let(
        words_column(text),
        lambda words: F.struct(
            count(F.size(words)).alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
            count(F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).alias("n_symbols"),
            let(lines, lambda x: count(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
            _repeat_words(words, REPEAT_WINDOW).alias("n_repeat_words"),
        ),
    )


def host_verdicts(docs: DataFrame, host: str, rules: dict[str, str]) -> DataFrame:
    """One row per host: n_docs and, by rule, fails, the shrunk rate and its deviation; refused if a rate is surely high.

    The beta prior of a rule has the mean m of all rows, and the strength s that fits the spread of the hosts' rates (by
    moments, hosts weighted by their rows, s within 2 to 10,000): rate = (fails + s m) / (n + s). Null hosts aren't counted.
    """
    # rows are added up before the shuffle, so a hot host costs no more than others
    by_host = docs.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.expr(f"cast(({c}) as int)")).cast("double").alias(f"fails_{r}") for r, c in rules.items()])
    total = by_host.agg(F.count(F.lit(1)).alias("_k"), F.sum("n_docs").cast("double").alias("_n"), F.sum(F.col("n_docs") * F.col("n_docs").cast("double")).alias("_n2"), *[F.sum(f"fails_{r}").alias(f"_f_{r}") for r in rules], *[F.sum(F.col(f"fails_{r}") * F.col(f"fails_{r}") / F.col("n_docs")).alias(f"_ff_{r}") for r in rules])
    prior = {}
    for r in rules:
        # sum of n (rate - m)^2 has the mean m (1 - m) (k - 1 + (N - sum n^2 / N - (k - 1)) / (s + 1))
        m = F.expr(f"try_divide(_f_{r}, _n)")
        spread = F.col(f"_ff_{r}") - F.col(f"_f_{r}") * m
        rho = F.expr("1.0") * (F.try_divide(spread, m * (1 - m)) - (F.col("_k") - 1)) / F.nullif(F.col("_n") - F.col("_n2") / F.col("_n") - (F.col("_k") - 1), F.lit(0.0))
        prior |= {f"_m_{r}": m, f"_s_{r}": F.least(F.greatest(F.coalesce(F.try_divide(F.lit(1.0), F.greatest(rho, F.lit(1e-4))) - 1, F.lit(2.0)), F.lit(2.0)), F.lit(10_000.0))}
    out = by_host.join(F.broadcast(total.select(*[c.alias(a) for a, c in prior.items()])))  # one row
    for r in rules:
        n = F.col("n_docs") + F.col(f"_s_{r}")
        rate = (F.col(f"fails_{r}") + F.col(f"_s_{r}") * F.col(f"_m_{r}")) / n
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"dev_{r}", F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (n + 1)))
    refused = F.greatest(F.lit(False), *[F.coalesce(F.col(f"rate_{r}") - HOST_SIGMAS * F.col(f"dev_{r}") > HOST_RATE, F.lit(False)) for r in rules])
    return out.withColumn("host_refused", refused).select(host, "n_docs", *[f"{x}_{r}" for r in rules for x in ("fails", "rate")], "host_refused")


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_refused, kept.

    Texts are read once; their measures, a few numbers a row, are written to the shared folder and then both counted by
    host and joined with the verdicts. Null texts have no words and fail; null hosts are never refused. Repeated rows
    each count. An empty table gives none. Hosts are broadcast if they are surely few; a shuffled join's hot host is
    split by Spark (the join stands directly on its exchanges).
    """
    m = docs.select(F.col(key).alias("_key"), F.col(host).alias("_host"), measures(F.col(text)).alias("m")).select("_key", "_host", "m.*")
    m = materialize(m.withColumn("base_failed", F.expr(" or ".join(f"({RULES[r]})" for r in BASE_RULES))), "quality")
    verdicts = host_verdicts(m, "_host", RULES).select("_host", "host_refused")
    verdicts = materialize(verdicts, "hosts")
    out = m.join(join_side(verdicts, 256), "_host", "left").withColumn("host_refused", F.coalesce("host_refused", F.lit(False)))
    return out.select(F.col("_key").alias(key), F.col("_host").alias(host), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_refused", (~F.col("base_failed") & ~F.col("host_refused")).alias("kept"))
