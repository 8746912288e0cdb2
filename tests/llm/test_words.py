"""The word model: brute force, and word order."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heliospark.llm import queries, word_model


@pytest.mark.parametrize("block", [word_model.BLOCK, 2])
def test_word_perplexity_by_brute_force(spark, block):
    """The second time documents are cut into parts of two words."""
    texts = ["the cat sat on the mat", "The dog sat on the log", "über die Straße", None, " \n", "zq#xv never seen", "the cat sat on the mat"] + [f"the {a} and the {b}" for a in ("cat", "dog", "hen") for b in ("mat", "log", "egg")]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    good = docs.where("doc_id != 5").select("doc_id")
    got = {r.doc_id: r for r in word_model.word_perplexities(docs, good.union(good), block=block).collect()}
    counted = {r[0] for r in docs.where((word_model.hash_share(F.col("doc_id"), 31) >= word_model.CALIBRATE) & (F.col("doc_id") != 5)).select("doc_id").collect()}
    words = lambda t: ("", "", *(t or "").lower().split())
    types = {3: collections.Counter(words(texts[i])[j : j + 3] for i in counted for j in range(len(words(texts[i])) - 2))}
    for k in (2, 1):
        types[k] = collections.Counter(g[1:] for g in types[k + 1])
    off, ctx = {}, {}
    for k, t in types.items():
        n = collections.Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        off[k] = {i: min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)}
        ctx[k] = collections.defaultdict(lambda: [0, 0.0])
        for g, c in t.items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][1] += off[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (len(types[1]) + 1)
        k, rest = len(g), p(g[1:])
        if g[:-1] not in ctx[k]:
            return rest
        n, d = ctx[k][g[:-1]]
        c = types[k].get(g, 0)
        return (max(c - off[k][min(c, 3)], 0) / n if c else 0) + d / n * rest

    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        assert got[i].n_words == len(w) - 2 and got[i].n_bytes == len((t or "").encode())
        if len(w) == 2:
            assert got[i].perplexity is None and not got[i].kept
        else:
            want = math.exp(-sum(math.log(p(w[j : j + 3])) for j in range(len(w) - 2)) / (len(w) - 2))
            assert got[i].perplexity == pytest.approx(want, rel=1e-5)
    assert word_model.word_perplexities(docs.limit(0), good).count() == 0
    assert all(r.kept == (r.n_words > 0) for r in word_model.word_perplexities(docs, good.limit(0)).collect())


def test_senseless_order_is_refused(spark, tmp_path):
    """Held-out sentences are kept by op9, the same words in random order aren't."""
    r = random.Random(6)
    parts = [[f"{c}{r.randrange(10**6)}" for _ in range(12)] for c in "abcdef"]
    sentence = lambda: [r.choice(p) for p in parts]
    rows = [sum((sentence() for _ in range(20)), []) for _ in range(400)]
    for i in range(300, 400):
        if i % 2:
            r.shuffle(rows[i])
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    new = [x for x in queries.op9_quality_classifier(spark, str(tmp_path)).collect() if x.doc_id >= 300]
    good, bad = [x for x in new if x.doc_id % 2 == 0], [x for x in new if x.doc_id % 2]
    assert max(x.perplexity for x in good) * 1.5 < min(x.perplexity for x in bad)
    assert not any(x.kept for x in bad) and sum(x.kept for x in good) >= 45


def test_order_of_rows_as_lexsort():
    rng = np.random.default_rng(5)
    for tops in ([2**62, 2**62], [2**40, 2**21, 2**40], [9, 5, 3], [1], [2**20, 2**20, 2**20]):
        keys = [rng.integers(0, t, 500) for t in tops]
        keys = [np.concatenate((k, k[:200])) for k in keys]
        assert word_model._order(keys).tolist() == np.lexsort(keys[::-1]).tolist()
        known, back = word_model._distinct(keys[0])
        assert known.tolist() == np.unique(keys[0]).tolist() and (known[back] == keys[0]).all()
    assert all(len(x) == 0 for x in (word_model._order([np.zeros(0, np.int64)] * 2), *word_model._distinct(np.zeros(0, np.int64))))


def test_a_question_is_looked_up_once(monkeypatch):
    """A shard's answers are those of dictionaries, and each pair, triple and word is searched for once, not once for each of its counts."""
    rng = np.random.default_rng(6)
    rows = lambda n, k: np.unique(rng.integers(0, 30, (n, k)), axis=0).T
    b, c, a = rows(3000, 3)
    n = rng.integers(1, 9, len(a))
    x, y = rows(300, 2)
    sums = [rng.integers(0, 9, len(x)) for _ in range(4)]
    w = np.arange(0, 30, 2)
    words = [rng.integers(0, 9, len(w)) for _ in range(5)]
    known = pa.table({"shard": [0] * 3, "kind": ["triples", "contexts", "words"], "data": pa.array([word_model.squeeze([b, c, a, n], 3), word_model.squeeze([x, y, *sums], 2), word_model.squeeze([w, *words], 1)], pa.binary())})
    p, q = np.unique(rng.integers(0, 34, (400, 2)), axis=0).T
    many = rng.integers(0, 4, len(p))
    before = rng.integers(0, 34, many.sum())
    asks = np.arange(34)
    asked = pa.table({"shard": [0], "block": [7], "pairs": pa.array([word_model.squeeze([p, q], 2)], pa.binary()), "before": pa.array([word_model.squeeze([many, before])], pa.binary()), "words": pa.array([word_model.squeeze([asks], 1)], pa.binary())})
    found, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda keys, asked, *more, **named: found.append(np.size(asked)) or search(keys, asked, *more, **named))
    got = word_model.expand(word_model._answers((0,), asked, known)["data"][0].as_py())
    assert sum(found) <= 4 * len(p) + len(before) + len(asks)
    pairs, triples = collections.Counter(zip(b.tolist(), c.tolist())), dict(zip(zip(b.tolist(), c.tolist(), a.tolist()), n.tolist()))
    contexts, of_word = dict(zip(zip(x.tolist(), y.tolist()), zip(*(s.tolist() for s in sums)))), dict(zip(w.tolist(), zip(*(s.tolist() for s in words))))
    pq = list(zip(p.tolist(), q.tolist()))
    assert got[0].tolist() == [pairs[k] for k in pq]
    assert list(zip(*(g.tolist() for g in got[1:5]))) == [contexts.get(k, (0,) * 4) for k in pq]
    assert got[5].tolist() == [triples.get((*k, z), 0) for k, z in zip([k for k, m in zip(pq, many) for _ in range(m)], before.tolist())]
    assert list(zip(*(g.tolist() for g in got[6:]))) == [of_word.get(k, (0,) * 5) for k in asks.tolist()]
