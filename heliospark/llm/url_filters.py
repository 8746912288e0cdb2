"""Allow and block rules for urls, matched in a trie over reversed host labels and path segments."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES

#: Verdict of an url that no rule fits, one without a host included.
DEFAULT = "allow"
MATCH = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    # translate, not lower: other letters stay
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, low)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes by reversed host label; at each, a second trie by path segment.

    A rule's path is a plain prefix of the url's path, so its last segment may end inside one of the url's: the last
    segments hang at their node by their text. The deepest host wins, there the longest path; of rules that are the
    same, block wins.
    """

    def __init__(self, rules):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            *full, rest = path.split("/")
            node = node.setdefault("/", {})  # no label holds a slash
            for segment in full:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})  # the rules that end here, by the rest of their path
            if ends.get(rest, ("", "allow"))[1] == "allow":
                ends[rest] = (host + path, verdict)

    @staticmethod
    def _path(node: dict, segments: list[str]):
        best = None
        for i, segment in enumerate(segments):
            ends = node.get(None)
            if ends:
                if len(segment) < len(ends):
                    found = next((ends[segment[:k]] for k in range(len(segment), -1, -1) if segment[:k] in ends), None)
                else:
                    found = max(((len(e), r) for e, r in ends.items() if segment.startswith(e)), default=(0, None))[1]
                best = found or best
            if i + 1 == len(segments) or (node := node.get(segment)) is None:
                break
        return best

    def match(self, host: str, path: str):
        segments, node, best = path.split("/"), self.root, None
        if "/" in node:
            best = self._path(node["/"], segments)
        for label in reversed(host.split(".")) if host else ():
            if (node := node.get(label)) is None:
                break
            if "/" in node:
                best = self._path(node["/"], segments) or best
        return best


def filter_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], url: str = "url", default: str = DEFAULT, limit: int = BROADCAST_BYTES) -> DataFrame:
    """pages with the columns host, path, rule and verdict (existing columns of these names are replaced).

    rules: (host, path, allow or block). A rule fits its host and all subdomains if the url's path starts with its path;
    the deepest host wins, there the longest path, and block before allow. A rule with an empty host fits every host. Null urls and urls
    without :// have empty host and path and get the default. Tries of up to ``limit`` bytes, as measured, are broadcast;
    larger sets of rules are joined by host suffix and path segment, without a trie in any one process.
    """
    spark = pages.sparkSession
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, DataFrame):
        rules = rules.toDF("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
        size = rules.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 200), F.lit(0))).first()[0]
        if size > limit:
            return _joined(pages, rules, default)
        rules = [tuple(r) for r in rules.collect()]
    trie = Trie(rules)
    if len(pickle.dumps(trie)) > limit:
        return _joined(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default)
    shared = spark.sparkContext.broadcast(trie)

    @F.pandas_udf(MATCH)
    def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = shared.value
        for hosts, paths in parts:
            found = [trie.match(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    found = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ("rule", "verdict")]).alias("_row"), match("host", "path").alias("_m"))
    return found.select("_row.*", "_m.rule", "_m.verdict")


def _joined(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equi-join: each url's host suffixes and path folders against each rule's host and folder."""
    folder = lambda p: F.regexp_extract(p, r"(?s)^(.*/)?", 0)
    rules = rules.select("verdict", F.concat("host", "path").alias("rule"), F.col("host").alias("_h"), folder(F.col("path")).alias("_f"), F.expr("substr(path, length(regexp_extract(path, '(?s)^(.*/)?', 0)) + 1)").alias("_rest"))
    keyed = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parts = F.split("path", "/")
    keys = keyed.withColumn("_h", F.explode(F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))))
    keys = keys.withColumn("_f", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i > 0, "/").otherwise("")))))
    hit = keys.join(rules, ["_h", "_f"]).where(F.expr("startswith(substr(path, length(_f) + 1), _rest)"))
    rank = F.struct(F.length("_h"), F.length("rule"), F.when(F.col("verdict") == "block", 1).otherwise(0))
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_m"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select(*[F.col(c) for c in pages.columns if c not in ("rule", "verdict")], F.col("_m.rule").alias("rule"), F.coalesce("_m.verdict", F.lit(default)).alias("verdict"))
