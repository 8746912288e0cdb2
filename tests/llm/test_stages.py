"""Stages of the pipeline by themselves, each against a slow version."""

import collections
import random
import re

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_copies_by_five_words(spark):
    """One word of 50 differs: 41 of 51 five-word shingles are shared (0.804), but only 43 of 51 four-word shingles (0.843)."""
    words = [f"w{i}" for i in range(50)]
    other = words[:25] + ["new"] + words[26:]
    far = words[:49]
    far[20] = far[40] = "new"
    rows = [(1, " ".join(words), "en"), (2, " ".join(other), "en"), (3, " ".join(far), "en"), (4, "something else", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3, 4]


def test_near_duplicates_by_row(spark):
    """Rows of one doc_id, and of none, are judged by their texts; one of each group stays, of repeated rows one."""
    r = random.Random(1)
    a, b, c, d, e = (" ".join(f"{x}{r.randrange(10**6)}" for _ in range(60)) for x in "abcde")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, d), (7, d), (None, a), (None, e), (None, e + " more"), (9, None), (9, ""), (8, None)]
    want = [(3, a), (5, b), (7, c), (7, d), (None, e), (9, None), (9, ""), (8, None)]
    got = left(corpus_pipeline.near_duplicates(spark, table(spark, rows), ""))
    either = left(table(spark, want))
    assert got == either or got == left(table(spark, [x if x[1] != e else (None, e + " more") for x in want]))
    assert corpus_pipeline.near_duplicates(spark, table(spark, rows).limit(0), "").count() == 0


def test_benchmark_passages_by_row(spark, tmp_path):
    r = random.Random(2)
    item = " ".join(f"q{r.randrange(10**6)}" for _ in range(14))
    spark.createDataFrame([(1, item), (2, None)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x " + item), (1, "clean"), (None, item + " y"), (None, "clean too"), (2, None), (2, ""), (3, " ".join(item.split()[:9]))]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    wins = {tuple(words(item)[i : i + 10]) for i in range(5)}
    want = [x for x in rows if not any(tuple(words(x[1])[i : i + 10]) in wins for i in range(len(words(x[1]))))]
    assert left(corpus_pipeline.benchmark_passages(spark, table(spark, rows), str(tmp_path))) == sorted(want, key=str)


def test_repeated_passages(spark):
    r = random.Random(3)
    word = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage = word(50)
    rows = [(1, " ".join(word(20) + passage + word(20))), (2, " ".join(passage + word(30))), (3, " ".join(passage)), (None, " ".join(word(40))), (4, None), (5, "")]
    count = collections.Counter(tuple(w[i : i + 35]) for _, t in rows for w in [(t or "").split()] for i in range(len(w) - 34))
    want = []
    for k, t in rows:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        if not gone:
            want.append((k, t))
        elif len(gone) < len(w):
            want.append((k, " ".join(x for j, x in enumerate(w) if j not in gone)))
    got = corpus_pipeline.repeated_passages(spark, table(spark, rows), "").collect()
    assert sorted(((x.doc_id, x.text and " ".join(x.text.split())) for x in got), key=str) == sorted(want, key=str)
    assert all(x.n_chars == len(x.text or "") for x in got)


def test_language_and_packing(spark):
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "the words of a clean text"), (4, "the words of a clean text"), (None, "other words of a text")]
    got = corpus_pipeline.language(spark, table(spark, rows), "")
    assert left(got) == left(table(spark, rows[3:])) and got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    packed = corpus_pipeline.packing(spark, table(spark, rows), "").collect()
    assert sorted((x.doc_id or 0, x.length) for x in packed) == sorted((k or 0, len((t or "").split())) for k, t in rows)
