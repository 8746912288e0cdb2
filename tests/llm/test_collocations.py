"""Phrase mining against plain counting of all n-grams."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from heliospark.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    r = random.Random(11)
    vocabulary = ["the", "of", "Und", "é", "ÉA", "x" * 30, "\x1c", "a\x00b", "don't", "new", "york", "city", "hall", "(", "0"]
    out = []
    for _ in range(150):
        words = [r.choice(["New York", "new york City", "new york city hall", "of the", "the the the", *vocabulary]) for _ in range(r.randrange(0, 60))]
        out.append("".join(w + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " ; "]) for w in words))
    return [None, "", " \t", "...", "one", *out, "spam " * 400, "spam\t" * 300, "y" * 900 + " z", " ".join(r.choice(vocabulary) for _ in range(3000))]


def table():
    t = texts()
    r = random.Random(3)
    rows = [(i, x, r.choice(["en", "en", "fr", None, "und"]), "p", 1) for i, x in enumerate(t)]
    return rows + [rows[20]] * 5 + [(None, t[21], "en", None, None)]


def ngrams(rows, longest):
    f = collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    return f


def slow(rows, least, longest, contained, top):
    out = set()
    for lang, f in ngrams(rows, longest).items():
        n = sum(c for p, c in f.items() if " " not in p)
        found = {p: c for p, c in f.items() if " " in p and c >= least}
        gone = set()
        for p, c in found.items():
            w = p.split(" ")
            gone |= {s for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * c >= contained * found[s := " ".join(w[i : i + m])]}
        rank = []
        for p, a in found.items():
            w = p.split(" ")
            cuts = [(2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if p not in gone:
                rank.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out |= {(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)) if top is None or i < top}
    return out


@pytest.mark.parametrize("least, longest, contained, top", [(30, 4, 80, 2000), (5, 3, 50, 7), (2, 5, 80, None)])
def test_equals_plain_counting(spark, least, longest, contained, top):
    rows = table()
    got = [tuple(r) for r in C.mine_phrases(spark.createDataFrame(rows, SCHEMA).repartition(5), least=least, longest=longest, contained=contained, top=top).collect()]
    want = slow(rows, least, longest, contained, top)
    assert len(want) > 20 and len(got) == len(want) and set(got) == want


def test_crowded_sketch_and_many_shards_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "CELLS", (1 << 5, 1 << 5))  # all cells overflow: nothing is ruled out
    monkeypatch.setattr(C, "AUTOMATON", 20)
    monkeypatch.setattr(C, "SLICE_WORDS", 50)
    rows = table()
    got = [tuple(r) for r in C.mine_phrases(spark.createDataFrame(rows, SCHEMA).repartition(3), least=10).collect()]
    assert set(got) == slow(rows, 10, 4, 80, 2000)


@pytest.mark.parametrize("chunk", [7, 40, 300, 1 << 20])
def test_long_texts_in_parts(monkeypatch, chunk):
    """Each n-gram is found once, whatever the parts, in shards and by overlapping fragments."""
    monkeypatch.setattr(C, "RUN_BYTES", chunk)
    rows = table()
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]})
    out = [r for b in C._emitted(C.Sketch({}, 1 << 20, 3), 4, 2)(iter([batch])) for r in b.to_pylist()]
    got = collections.defaultdict(collections.Counter)
    patterns = collections.defaultdict(set)
    for r in out:
        if r["k"]:
            patterns[r["lang"], r["shard"]].add((r["phrase"], r["k"]))
    for r in out:
        if not r["k"] and patterns[r["lang"], r["shard"]]:
            mine = sorted(patterns[r["lang"], r["shard"]])
            tables = pa.table({"lang": [r["lang"]] * len(mine), "phrase": [p for p, _ in mine], "k": pa.array([k for _, k in mine], pa.int32())}), pa.table({"texts": [r["texts"]], "numbers": [r["numbers"]]})
            for x in C._scan(1700)(*tables).to_pylist():
                got[r["lang"]][x["phrase"]] += x["a"]
    got = {k: collections.Counter({p: c for p, c in v.items() if c}) for k, v in got.items()}
    want = {lang: {p: c for p, c in f.items() if " " in p} for lang, f in ngrams(rows, 4).items()}
    assert {k: dict(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_sketch_never_rules_out_what_reaches_the_threshold(spark):
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("coalesce(lang, 'und') lang", "text")
    sketch = C.sketch_of(frame, C.Sketch({}, 1 << 20), [2], 30)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows], "text": [r[1] for r in rows]})
    frequent = {(lang, p) for lang, f in ngrams(rows, 2).items() for p, c in f.items() if " " in p and c >= 30}
    found = set()
    for run in C.runs(iter([batch]), 4):
        _, _, ok = next(sketch.live(run, 4))
        found |= {(run.lang[run.part[i]], run.texts(np.array([i]), np.array([i + 2]))[0].decode()) for i in range(len(ok)) if ok[i]}
    assert frequent and frequent <= found and len(found) < 3 * len(frequent)


def test_empty(spark):
    assert C.mine_phrases(spark.createDataFrame([], SCHEMA)).count() == 0
