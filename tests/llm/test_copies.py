"""Repeated rows: however many, they cost one."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospark.llm import jaccard_join, language_id, packing, substring_dedup, toxicity
from heliospark.llm.common import row_name


def near(n):
    r = random.Random(1)
    a = [f"w{r.randrange(10**6)}" for _ in range(300)]
    b = [*a[:-3], "x", "y", "z"]
    return [(1, " ".join(a)), (2, " ".join(b))] * n


@pytest.mark.parametrize("n", [1, 300])
def test_near_copies_are_verified_once(spark, monkeypatch, n):
    sizes = []
    each = jaccard_join.one_each

    def seen(texts, asked):
        out = each(texts, asked)
        sizes.append((out.count(), asked.count()))
        return out

    monkeypatch.setattr(jaccard_join, "one_each", seen)
    got = jaccard_join.similar_documents(spark.createDataFrame(near(n), "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 2 * n and {r.component_id for r in got} == {1}
    assert sizes and all(have == asked <= 2 for have, asked in sizes)


@pytest.mark.parametrize("n", [1, 300])
def test_one_text_a_name_reaches_the_shards(spark, n):
    docs = spark.createDataFrame(near(n), "doc_id long, text string").select(row_name("doc_id", "text").alias("rid"), "text")
    side = docs.select(F.col("rid").alias("_rid"), F.lit(1).alias("asked")).distinct()
    assert substring_dedup.asked_texts(docs, side, side.count()).count() == 2
    cut = substring_dedup.remove_repeats(spark.createDataFrame(near(n), "doc_id long, text string").repartition(3), digest=True).collect()
    assert len(cut) == 2 * n and {r.n_removed for r in cut} == ({297} if n == 1 else {300})


def test_equal_pieces_are_dealt_to_all_groups(spark):
    rows = spark.range(60_000).selectExpr("cast(null as long) doc_id", "5L n_tokens")
    out = packing.pack_documents(rows)
    groups = {r["g"]: r["count"] for r in out.groupBy(F.expr("bin >> 32").alias("g")).count().collect()}
    assert sum(groups.values()) == 60_000 and len(groups) == 3 and max(groups.values()) < 25_000
    bins = out.groupBy("bin").agg(F.sum("length").alias("s"), F.max("used").alias("u"), F.max("capacity").alias("c"), F.count_distinct("place").alias("d"), F.count("*").alias("n")).collect()
    assert all(b.s == b.u <= b.c and b.d == b.n for b in bins)
    again = collections.Counter(tuple(r) for r in packing.pack_documents(rows.repartition(7)).collect())
    assert again == collections.Counter(tuple(r) for r in out.collect())


def test_language_gradients():
    r = np.random.default_rng(4)
    x, V, b, y = r.normal(size=6), r.normal(size=(4, 6)), r.normal(size=4), 2
    loss = lambda x, V, b: float(np.log(np.exp(V @ x + b).sum()) - (V @ x + b)[y])
    g, back = language_id.gradients(x, V, b, y)
    for i in range(6):
        e = np.zeros(6)
        e[i] = 1e-6
        assert abs((loss(x + e, V, b) - loss(x - e, V, b)) / 2e-6 - back[i]) < 1e-6
    for i in range(4):
        e = np.zeros(4)
        e[i] = 1e-6
        assert abs((loss(x, V, b + e) - loss(x, V, b - e)) / 2e-6 - g[i]) < 1e-6
        for j in range(6):
            E = np.zeros((4, 6))
            E[i, j] = 1e-6
            assert abs((loss(x, V + E, b) - loss(x, V - E, b)) / 2e-6 - g[i] * x[j]) < 1e-6


@pytest.mark.parametrize("steep", [1.0, 2.0])
def test_noisy_or_gradient(steep):
    r = np.random.default_rng(5)
    w, b, at, sentence, doc, y = r.normal(size=9), -1.0, r.integers(0, 9, 40), np.sort(r.integers(0, 12, 40)), np.repeat(np.arange(4), 3), np.array([1, 0, 1, 0])

    def loss(w, b):
        total = 0.0
        for d in range(4):
            clean = np.prod([1 - 1 / (1 + np.exp(-steep * (w[at[sentence == s]].sum() + b))) for s in np.flatnonzero(doc == d)])
            total -= np.log(1 - clean) if y[d] else np.log(clean)
        return total / 4

    g, db = toxicity.gradient(w, b, at, sentence, doc, y, steep)
    for i in range(9):
        e = np.zeros(9)
        e[i] = 1e-6
        assert abs((loss(w + e, b) - loss(w - e, b)) / 2e-6 - g[i]) < 1e-5
    assert abs((loss(w, b + 1e-6) - loss(w, b - 1e-6)) / 2e-6 - db) < 1e-5


def test_what_is_of_no_learnt_language_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = ["xqzw kjhg vbnm", "qqq www zzz xxx", "привет как дела", "日本語のテキスト", "مرحبا بالعالم", "ελληνικά γράμματα"]
    rows = docs.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], docs.schema))
    got = language_id.identify_languages(rows).where("doc_id < 0 or rejected").collect()
    assert {r.doc_id for r in got if r.rejected and r.doc_id < 0} == {-1 - i for i in range(len(odd))}
    assert sum(r.doc_id >= 0 for r in got) <= 5
