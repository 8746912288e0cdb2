"""Operators against brute force, on small tables with nulls, empty and repeated texts, ties, and other columns."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from heliospark.llm import decontaminate, fm_index, jaccard_join, packing, quality_rules, substring_dedup, token_counts, url_filters
from heliospark.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, sig long, spans string"


def texts():
    r = random.Random(4)
    word = lambda n: " ".join(r.choice("the of and Ünion über a b c d e f g h".split()) + str(r.randrange(60)) for _ in range(n))
    passage, base = word(60), word(150).split(" ")
    out = [None, "", " \t\n", "one", "One", "a b c", "a b c d", passage, passage, "x " + passage + " y", word(5000)]
    for _ in range(40):
        edit = list(base)
        for _ in range(r.randrange(6)):
            edit[r.randrange(len(edit))] = word(1)
        out.append(" ".join(edit))
    out += [word(r.randrange(1, 80)) + (" " + passage if i % 5 == 0 else "") for i in range(60)]
    out += ["spam " * 100, "spam " * 100, "line one\nline one\nline two #$%&|<>*", "\x00zero\x0b\x0cform " * 20]
    return out


@pytest.fixture(scope="module")
def rows():
    t = texts()
    rows = [(i, x, "en", f"s{i % 3}" if i % 7 else None, 0, 1, 2, "z") for i, x in enumerate(t)]
    return rows + [rows[12], rows[12], (None, t[12], None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return SPACE.findall(t or "")


def test_quality_rules(docs, rows, empty):
    def want(t):
        w, seen = words(t), collections.defaultdict(list)
        for i in range(len(w) - 7):
            seen[tuple(w[i : i + 8])].append(i)
        cover = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)

    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_rules(docs).collect())
    assert got == collections.Counter((r[0], *want(r[1])) for r in rows)
    assert quality_rules.quality_rules(empty).count() == 0


def test_bad_host_is_refused(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if h or i % 9 == 0 else "short", "good" if h else "bad") for h in (0, 1) for i in range(200)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    assert {(r.source, r.host_refused) for r in out.collect()} == {("good", False), ("bad", True)}
    assert out.where("kept").select("source").distinct().count() == 1


def test_jaccard_join(docs, rows, empty):
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(LOW))
        sets[r[0]] = frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = [k for k in sets if k is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = jaccard_join.similar_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else find(r.doc_id)), r
    assert jaccard_join.similar_documents(empty).count() == 0


def test_jaccard_join_of_boilerplate(spark):
    """Sets that share most of their tokens with very many others, chains of links, and one large group of near copies."""
    r = random.Random(9)
    word = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    boilerplate = [word(70) for _ in range(3)]
    texts = [sum((b for b in r.sample(boilerplate, r.randrange(1, 4))), []) + word(r.randrange(2, 40)) for _ in range(160)]
    at = list(word(90))
    for _ in range(40):
        at = list(at)
        at[r.randrange(90)] = word(1)[0]
        texts.append(at)
    base = word(120)
    for _ in range(60):
        edit = list(base)
        edit[r.randrange(120)] = word(1)[0]
        texts.append(edit)
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in texts]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string").repartition(5)
    for kind in ({}, {"long": 7, "dense": 0}):
        got = {x.doc_id: x.component_id for x in jaccard_join.similar_documents(docs, **kind).collect()}
        assert got == {i: find(i) for i in range(len(sets))}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {i: 100 for i in range(100, 140)}


def test_fm_index():
    r = random.Random(2)
    import numpy as np

    for _ in range(60):
        width = r.randrange(2, 6)
        segs = list({tuple(r.randrange(5, 8) for _ in range(r.randrange(width, 14))) for _ in range(r.randrange(1, 10))})
        weight = [r.choice([1, 1, 2]) for _ in segs]
        count = collections.Counter()
        for s, w in zip(segs, weight):
            for i in range(len(s) - width + 1):
                count[s[i : i + width]] += w
        want = {(j, i) for j, s in enumerate(segs) for i in range(len(s) - width + 1) if count[s[i : i + width]] > 1}
        bounds = np.cumsum([0, *map(len, segs)])
        got = fm_index.repeated_windows(np.concatenate(segs).astype(np.uint64), bounds, np.array(weight), width)
        assert {(int(a), int(b) + d) for a, b, n in zip(*got) for d in range(n)} == want


def test_substring_dedup(docs, rows, empty):
    count = collections.Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r[1])] for i in range(len(w) - 34))
    want = collections.Counter()
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[r[0], len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()] += 1
    # at most so many segments of an anchor: 1 and 3 cut all, and some, of those that are shared
    for most in (substring_dedup.SEGMENTS, 3, 1):
        out = substring_dedup.remove_repeats(docs, digest=True, most=most).collect()
        assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    for r in substring_dedup.remove_repeats(docs, keep=["source", "rid", "spans", "n_chars"]).collect():
        assert r.spans in ("z", None) and r.rid in (1, None)
        if r.text is not None:
            assert len(words(r.text)) == r.n_words - r.n_removed
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_decontamination(spark, docs, rows, empty):
    t = texts()
    items = [("a", t[7][30:150]), ("b", "ONE"), ("c", None), ("d", "..."), ("e", t[20]), ("f", "no such words at all in any of the documents here"), ("b2", "one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    wins = collections.defaultdict(set)
    for k, x in items:
        w = ALNUM.findall((x or "").translate(LOW))
        for i in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[i : i + 10])].add(k)
    # one key with two texts, and two null keys
    more = [(7, "one", "en", None, 0, 1, 2, "z"), (None, t[20], "en", None, 0, 1, 2, "z"), (None, "", "en", None, 0, 1, 2, "z")]
    rows, docs = rows + more, docs.unionByName(spark.createDataFrame(more, SCHEMA))
    want = collections.Counter()
    for r in rows:
        w, hit, found = ALNUM.findall((r[1] or "").translate(LOW)), set(), set()
        for p, ks in wins.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= ks
        want[r[0], len(w), len(hit), tuple(sorted(found))] += 1
    got = decontaminate.contamination(docs, bench).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_near_matches(spark):
    docs = spark.createDataFrame([(1, "pad rare1 x x x x rare2 pad"), (2, "rare1 rare2 far"), (3, "rare1 x x x rare2"), (4, "rare1 y y y y rare2 not its words")], "doc_id int, text string")
    bench = spark.createDataFrame([(1, "rare1 x x x rare2")], "item_id int, text string")
    got = {(r.doc_id, r.kind) for r in decontaminate.matches(docs, bench, slop=1).collect()}
    assert got == {(1, "near"), (3, "phrase")}


URLS = ["https://www.Example.com/en/77?x", "http://example.com/en/8", "a://b.net/de/", "x://example.net/de/8/9#f", "no scheme", None, "", "s://", "s://org/es/", "s://ORG/es", "s://notexample.com/en/7", "s://a.com/xen/"]
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_url_filters(spark):
    def want(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOW), m[2]) if m else ("", "")
        fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id int, url string, rule string")
    for limit in (1 << 20, 10):
        got = url_filters.filter_urls(pages, RULES, limit=limit).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: want(u) for i, u in enumerate(URLS)}
    assert url_filters.filter_urls(pages.limit(0), RULES).count() == 0


def test_token_counts(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    r = random.Random(1)
    bits = ["'", "r", "e", " ", "  ", "\n", "a", "the", "é", "1", "!", "<|endoftext|>", "<|end", "語", "\u00a0", "😀", "'ve", "\r\n"]
    c = token_counts.counter(path)
    for _ in range(300):
        t = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        counts = c.counts(t)
        assert c.total(t) == n(t)
        for j in range(len(t) + 1):
            assert counts.prefix[len(t[:j].encode())] == n(t[:j])
        cut = counts.truncate(3)
        assert n(t.encode()[:cut].decode()) <= 3
    for x in token_counts.token_counts(docs, path, limit=50).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert (x.n_bytes, x.n_tokens, x.over_limit) == (len((x.text or "").encode()), n(x.text), n(x.text) > 50)
        assert n((x.text or "").encode()[: x.cut_bytes].decode()) <= 50
    assert token_counts.token_counts(empty, path).count() == 0


def test_packing(spark):
    r = random.Random(3)
    lengths = [None, 0, -3, 5000, 20000, 4096, 4097] + [r.randrange(1, 3000) for _ in range(900)]
    docs = spark.createDataFrame([(i if i % 50 else 7, n, 1) for i, n in enumerate(lengths)], "doc_id int, n_tokens int, bin int")
    got = packing.pack_documents(docs, group=300).collect()
    assert sum(x.length for x in got) == sum(max(0, n or 0) for n in lengths)
    bins = collections.defaultdict(list)
    for x in got:
        bins[x.bin].append(x)
    for items in bins.values():
        used, at = sum(x.length for x in items), 0
        assert {(x.used, x.capacity) for x in items} == {(used, min(c for c in packing.CAPACITIES if c >= used))}
        for x in sorted(items, key=lambda x: (x.place, x.length)):
            assert x.place == at
            at += x.length
    assert len(got) == sum(max(1, -(-max(0, n or 0) // 4096)) for n in lengths)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_best_fit_by_brute_force():
    """The same choices by looking at every bin and every capacity."""
    r = random.Random(8)
    for _ in range(60):
        capacities = tuple(sorted(r.sample(range(8, 60), r.randrange(1, 4))))
        lengths = [r.randrange(0, capacities[-1] + 1) for _ in range(r.randrange(1, 40))]
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        used, size = [], []
        for k, i in enumerate(order):
            n = lengths[i]
            open_ = [b for b in range(len(used)) if size[b] - used[b] >= n]
            if open_:
                left = min(size[b] - used[b] for b in open_)
                used[[b for b in open_ if size[b] - used[b] == left][0]] += n
                continue

            def per_token(c):
                later = sorted(lengths[j] for j in order[k + 1 :])
                return packing.attention_cost(c) / max(1, n + min(c - n, sum(x for x in later if x <= c - n)))

            size.append(min((c for c in capacities if c >= n), key=lambda c: (per_token(c), c)))
            used.append(n)
        got = packing.pack(lengths, capacities)
        assert sorted(b.used for b in got) == sorted(used)
        assert sorted(b.capacity for b in got) == sorted(min(c for c in capacities if c >= u) for u in used)


def test_best_fit_is_best_fit():
    bins = packing.pack([60, 50, 40, 30, 20], (64, 100), cost=lambda c: c)
    assert sorted(sorted(b.items) for b in bins) == [[0, 2], [1, 3, 4]]
    assert [b.capacity for b in packing.pack([10], (64, 100))] == [64]


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    kept = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, texts()[20])], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, at, str(tmp_path))
        assert new.columns == kept.columns
        new.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        if name == "ngram_jaccard_join":
            assert at.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    want = at.select("doc_id").distinct().count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.select("doc_id").distinct().count() == want > 10
