"""Source divergence against plain Python integers, with small tiles."""

import collections
import itertools
import random
import re

import numpy as np
import pytest

from heliospark.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    r = random.Random(13)
    words = [f"{a}{b}" for a in ("tom", "Über", "ÉÀ", "x", "Kilo", "straße", "ǅ") for b in ("", "a", "bc", "DE", "éf")]
    out = [(i, r.choice([" ", "-", "\n", "7"]).join(r.choices(words, k=r.randrange(1, 40))), r.choice(["en", "en", "fr", None, ""]), r.choice([f"s{k}" for k in range(7)] + [None, "", "ß", "\x01"]), "t", 1) for i in range(400)]
    out += [(1000 + i, f"tom tom {'zz ' * 50}", "en", "s0", "t", 1) for i in range(300)]
    out += [(None, None, "en", "empty", None, None), (5, "", "en", "s1", None, None), (5, "123 .", "lone", "s1", None, None), (6, "rare words", "none", "a", None, None), (6, "rare words", "none", "b", None, None)]
    return out + [out[0]] * 3


def slow(table, least_docs, top):
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source, *_ in table:
        found = collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW)))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        own = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share({t: sum(c[t] for c in own.values()) for t in kept})
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in own:
            parts = {"pair": [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s], "term": [(t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(items) if part == "pair" or n < top}
    return out


@pytest.mark.parametrize("block, band, top", [(8_000, 64, 10), (5, 2, 3)])
def test_equals_whole_numbers(spark, block, band, top):
    table = rows()
    got = [tuple(r) for r in D.source_divergence(spark.createDataFrame(table, SCHEMA).repartition(5), block_terms=block, band=band, top=top).collect()]
    want = slow(table, D.LEAST_DOCS, top)
    assert len(got) == len(want) and set(got) == want
    assert {x[0] for x in want} >= {"", "none"} and any(x[1] == "empty" for x in want) and not any(x[0] == "lone" for x in want)


def test_flushed_counts_add_up(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 3)
    import pyarrow as pa

    table = rows()
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "" for r in table], "source": [r[3] or "" for r in table], "text": [r[1] for r in table]})
    parts = list(D.count_terms(iter([batch])))
    assert len(parts) > 10
    total = collections.Counter()
    for p in parts:
        for x in p.to_pylist():
            total[x["term"]] += x["n"]
    assert total == collections.Counter(w for r in table for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOW)))


def test_empty(spark):
    assert D.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_64_bits():
    r = random.Random(2)
    totals = [r.randrange(1, 2**53) for _ in range(500)] + [1, 2**53 - 1]
    counts = [r.randrange(0, t + 1) for t in totals]
    got = D.shares(np.array(counts), np.array(totals))
    assert got.tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals)]


def test_pair_sums_in_strips(monkeypatch):
    monkeypatch.setattr(D, "CELLS", 37)
    p = np.random.default_rng(1).integers(1, 10**9, (9, 50))
    want = [[sum((int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(x, y)) for y in p[:4]] for x in p]
    assert D.pair_sums(p, p[:4]).tolist() == want


def test_heap_breaks_ties_by_bytes():
    values, names = np.array([5, 7, 7, 7, 1]), np.array([t.encode() for t in ("z", "é", "e", "ẑ", "a")], object)
    assert [n.decode() for _, n in D.largest(values, names, 3)] == ["e", "é", "ẑ"]
    assert list(itertools.starmap(lambda v, n: -v, D.largest(values, names, 9))) == [7, 7, 7, 5, 1]
