"""Learnt operators: held-out accuracy, a brute-force language model, and odd inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospark.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


def odd(spark):
    rows = [(1, None, "en", 1.0), (2, "", "en", 1.0), (3, "123 !?", None, 1.0), (4, "x", "en", 1.0), (4, "x", "en", 1.0), (None, "the of", "en", None), (5, "word " * 30_000, "en", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")


def test_language_held_out(spark):
    out = queries.op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert out.where("rejected").count() <= 2


def test_language_odd(spark):
    got = language_id.identify_languages(odd(spark), keep=["score"]).collect()
    assert len(got) == 7 and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    nothing = language_id.identify_languages(odd(spark), learn=F.lit(False)).collect()
    assert all(r.lang_pred == "und" and r.rejected for r in nothing)
    assert language_id.identify_languages(odd(spark).limit(0)).count() == 0


def test_toxicity_held_out(spark):
    out = queries.op5_toxicity(spark, SF.replace("0.01", "0.1")).join(spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet"), "doc_id").where("held_out")
    t = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert t[1, 1] > 0.6 * (t[1, 1] + t.get((1, 0), 0)) and t.get((0, 1), 0) < 0.03 * t[0, 0]


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd(spark), labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert toxicity.score_toxicity(odd(spark).limit(0), labels.limit(0)).count() == 0


def test_offending_sentence():
    import numpy as np

    docs = []
    for i in range(200):
        text = f"Good day number {i}. " + ("You are vile. " if i % 2 else "You are kind. ") + "All is well."
        h, s, _, _ = toxicity.sentence_words(np.frombuffer(text.encode(), np.uint8))
        docs.append((i % 2, h, s))
    model = toxicity.train(docs)
    h, s, first, last = toxicity.sentence_words(np.frombuffer(b"Fine. So vile. Fine again.", np.uint8))
    z = model.sentences(h, s, len(first))
    assert int(np.argmax(z)) == 1 and b"Fine. So vile. Fine again."[first[1] : last[1]] == b"So vile"
    assert z[1] > z[0] + 3


def test_only_texts_apart_tell_how_common_subwords_are():
    """Texts that were learnt from are of common subwords; without others nothing is rejected for its subwords."""
    rows = []
    for i, text in enumerate(["the words of a clean text", "the words of one more text", "some words of another text"]):
        idx, count = np.unique(np.concatenate(list(language_id.subwords(text))), return_counts=True)
        rows.append(("en", idx, count.astype(np.float32), i == 2))
    for some in (rows[:2], rows[2:]):
        model = language_id.train(some)
        assert model.common_below == -np.inf and not model.predict("unlike letters")[2]
    assert np.isfinite(language_id.train(rows).common_below)
