"""Exact Jaccard self-join of documents on word shingles, by adaptive multi-match prefixes.

Sets are ordered by hash. With a(n) = n - ceil(t n) + 1, two sets that link share at least l tokens among the first
a(n) + l - 1 of each, for every l. A document picks its own l by what candidates would cost: tokens that stand in the
prefixes of many documents are dear, and a prefix lengthened by l - 1 may leave l - 1 of them out and still meet every
partner; of the others, l less those left out must be shared before a pair is verified on the whole texts.

Groups of near copies aren't paired out. Equal sets are one from the start. A first round links sets to one leader each
among those that share some of their least tokens, verified too; what is connected by then is a class. The second round, which is complete,
looks for pairs of different classes only.

A set of which more is dear than it may leave out is heavy; it is only looked for, and doesn't look. Pairs of two heavy sets are found
with all of their tokens, ordered by frequency among them: the prefix then is lengthened to the whole set, and all but a(n)
tokens left out. There a token counts only if enough is left behind it, in either set, for a link.

No task gets all of a frequent token: joins spread it, what is dear is left out before the shuffle, and a list too long for
a shard is cut, each cut meeting each other. If there are many more pairs than sets, each set first tries one partner at a
time, and what is one class by then is asked no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, discard, grams, hashed_words, heat_limit, join_side, materialize, mix, pack, release, row_name, spread_join, text_buffers
from .components import components

WORDS = 4
PERCENT = 85
#: Tokens by which a set's leader is looked for in the first round.
LEADERS = 8
#: A prefix may be lengthened by this share of the set and so many tokens.
LENGTHEN, LENGTHEN_BY = 0.05, 4
#: A token is dear if so many classes have it in their prefixes.
DEAR = 4
#: The dearest tokens are broadcast, 24 bytes each; with more of them, only dearer ones count as dear.
DEAR_TOKENS = BROADCAST_BYTES // 24
#: Of a token, so many classes are counted in a batch; for which more there are makes no difference.
MARKS = 64
#: Postings in a shard, about, and of one token in a cut; and pairs at a time in its memory.
SHARD = 300_000
PAIRS = 400_000
#: With more pairs than so many times their sets, each set tries one partner at a time.
DENSE = 4


def base_prefix(n, percent: int):
    """a(n)."""
    return n - -(-n * percent // 100) + 1


def stored_prefix(n, percent: int):
    """What any partner may ask for: a partner's set is at most 100 / percent times as large."""
    return np.minimum(n, base_prefix(n, percent) + (LENGTHEN * n * 100 / percent).astype(np.int64) + LENGTHEN_BY + 1)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than k the hash of them all; none without words."""
    for a, b, words, bounds in hashed_words(*text_buffers(column), lower=True):
        g = grams(words, k)
        for i in range(b - a):
            first, last = bounds[i], bounds[i + 1]
            if last - first >= k:
                yield np.unique(g[first : last - k + 1])
            elif last > first:
                yield mix(grams(words[first:last], int(last - first)) + np.uint64(last - first))
            else:
                yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> int:
    """A 64-bit hash of a whole set."""
    return int(mix(np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64) + np.uint64(len(s))).view(np.int64)[0])


def _sets(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig, prefix = [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
                prefix.append(pack(s[: int(stored_prefix(np.int64(len(s)), percent))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(prefix, pa.binary())], ["key", "n", "sig", "prefix"])

    return run


def _tokens(batch: pa.RecordBatch, k: int | None = None):
    """Of a batch of (sig, n, class, prefix, or with k the text): its distinct sets, and each posting's set and place."""
    sig, at = np.unique(batch.column(0).to_numpy(), return_index=True)
    n, group = batch.column(1).to_numpy()[at], batch.column(2).to_numpy()[at]
    if k:
        parts = list(shingle_sets(batch.column(3).take(pa.array(at)), k))
    else:
        raw, off = text_buffers(batch.column(3))
        parts = [raw[off[i] : off[i + 1]].view(np.uint64) for i in at]
    sizes = np.array([len(p) for p in parts], np.int64)
    tokens = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(at)), sizes)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return sig, n, group, tokens, owner, place


def _shard_of(tokens: np.ndarray, shards: int) -> np.ndarray:
    return (mix(tokens ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(shards)).astype(np.int64)


def _least():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, _, tokens, owner, _ = _tokens(batch)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(sig[owner]), pa.array(n[owner])], ["token", "sig", "n"])

    return run


def _small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _dear_postings(shards: int, k: int | None = None):
    """By shard: tokens, each once for a class in the batch (up to MARKS of them), with 16 bits of the class's hash and how many postings it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, group, tokens, owner, _ = _tokens(batch, k)
            mark = (mix(group.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)[owner]
            tokens, mark, many = _counted(tokens, mark, np.ones(len(tokens), np.int64))
            new = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            rank = np.arange(len(tokens)) - np.repeat(begin, np.diff(np.append(begin, len(tokens))))
            place = np.minimum(rank, MARKS - 1) - rank + np.arange(len(tokens))  # the rest is added to the last
            many = np.bincount(place, many, len(tokens)).astype(np.uint32)[rank < MARKS]
            tokens, mark = tokens[rank < MARKS], mark[rank < MARKS]
            shard = _shard_of(tokens, shards)
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            full = np.flatnonzero(np.diff(edge))
            rows = [(s, pack(tokens[o]), pack(mark[o]), pack(many[o])) for s in full for o in (order[edge[s] : edge[s + 1]],)]
            c = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])], ["shard", "tokens", "marks", "many"])

    return run


def _counted(tokens: np.ndarray, mark: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, mark), sorted, and the sum of many."""
    order = np.lexsort((mark, tokens))
    tokens, mark = tokens[order], mark[order]
    begin = np.flatnonzero(np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (mark[1:] != mark[:-1])))) if len(tokens) else np.zeros(0, np.int64)
    return tokens[begin], mark[begin], np.add.reduceat(many[order], begin) if len(begin) else np.zeros(0, np.int64)


def _dear(least: int, long: int):
    """Tokens of so many classes or of more postings than ``long``: the number of classes (0 if they are few), and in how many cuts the list comes."""

    def run(part: pa.Table) -> pa.Table:
        columns = [np.concatenate([np.frombuffer(x.as_py(), kind) for x in part[c]]) for c, kind in (("tokens", np.uint64), ("marks", np.uint16), ("many", np.uint32))]
        tokens, _, many = _counted(columns[0], columns[1], columns[2].astype(np.int64))
        begin = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        count, postings = np.diff(np.append(begin, len(tokens))), np.add.reduceat(many, begin)
        dear, cuts = count >= least, -(-postings // long)
        out = dear | (cuts > 1)
        return pa.table([tokens[begin][out].view(np.int64), np.where(dear, count, 0)[out], cuts[out]], ["token", "cost", "cuts"])

    return run


def choose(dear: np.ndarray, n: int, percent: int) -> tuple[int, np.ndarray]:
    """l of a set, the least that lets it leave out all that is dear in its prefix, and those places; 0 and none if it is heavy."""
    a, most = int(base_prefix(n, percent)), 1 + int(LENGTHEN * n) + LENGTHEN_BY
    upto = np.cumsum(dear[: a + most - 1])
    fits = np.flatnonzero(upto[a - 1 :] <= np.arange(len(upto) - a + 1))
    if not len(fits):
        return 0, fits
    level = int(fits[0]) + 1
    return level, np.flatnonzero(dear[: a + level - 1])


def _about(sig, n, group, level, out) -> bytes:
    """What is asked of sets, so that it compresses: most classes are the set itself, most l are 1."""
    return pack(group ^ sig) + pack(n.astype(np.uint32)) + pack(level.astype(np.uint32)) + pack(out.astype(np.uint32))


def _read_about(sig: np.ndarray, data) -> np.ndarray:
    k = len(sig)
    raw = np.frombuffer(data, np.uint8)
    ends = np.cumsum([8 * k, 4 * k, 4 * k, 4 * k])
    group, n, level, out = (raw[b:e].view(t) for b, e, t in zip([0, *ends], ends, (np.int64, np.uint32, np.uint32, np.uint32)))
    return np.stack([n.astype(np.int64), group ^ sig, level.astype(np.int64), out.astype(np.int64)])


def _weigh(tokens: np.ndarray, dear: tuple[np.ndarray, ...], column: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token is dear, and its cost (else 0); or of column 2, whether its list is cut, and in how many cuts (else 0)."""
    known, values = dear[0], dear[column]
    if not len(known):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    value = np.where(known[at] == tokens, values[at], 0)
    return value > column - 1, value


def _choices(batch: pa.RecordBatch, percent: int, dear: tuple[np.ndarray, np.ndarray]):
    """_tokens(batch), and by set l (0 if it is heavy) and how many tokens it leaves out; by posting whether it is left out."""
    sig, n, group, tokens, owner, place = _tokens(batch)
    hot, cost = _weigh(tokens, dear)
    level, out, left = np.ones(len(sig), np.int64), np.zeros(len(sig), np.int64), np.zeros(len(tokens), bool)
    bounds = np.searchsorted(owner, np.arange(len(sig) + 1))
    for i in np.unique(owner[hot]):
        span = slice(bounds[i], bounds[i + 1])
        level[i], places = choose(hot[span], int(n[i]), percent)
        out[i] = len(places)
        left[bounds[i] + places] = True
    return sig, n, group, tokens, owner, place, level, out, left


def _heavy(percent: int, dear):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, group, *_, level, _, _ = _choices(batch, percent, dear())
            yield pa.RecordBatch.from_arrays([pa.array(x[level == 0]) for x in (sig, n, group)], ["sig", "n", "c"])

    return run


def _postings(shards: int, percent: int, dear, k: int | None = None):
    """By shard: postings (token, set, place) and what is asked of their sets. With k, of heavy sets: their first a(n) tokens by cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if k:
                sig, n, group, tokens, owner, place = _tokens(batch, k)
                order = np.lexsort((tokens, _weigh(tokens, dear())[1], owner))
                tokens = tokens[order]
                first = place < base_prefix(n, percent)[owner]
                tokens, owner, place = tokens[first], owner[first], place[first]
                level, out = np.ones(len(sig), np.int64), np.zeros(len(sig), np.int64)
            else:
                sig, n, group, tokens, owner, place, level, out, _ = _choices(batch, percent, dear())
                # by what is dear nobody looks: all leave it out
                here = ~_weigh(tokens, dear())[0]
                tokens, owner, place = tokens[here], owner[here], place[here]
            long, cuts = _weigh(tokens, dear(), 2)
            shard = _shard_of(tokens, shards)
            if long.any():
                mine = (mix(sig.view(np.uint64)) >> np.uint64(33)).astype(np.int64)[owner[long]] % cuts[long]
                copies = cuts[long]
                at = np.repeat(np.flatnonzero(long), copies)
                other = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                one = np.repeat(mine, copies)
                meeting = np.minimum(one, other).astype(np.uint64) << np.uint64(32) | np.maximum(one, other).astype(np.uint64)
                moved = _shard_of(mix(tokens[at]) ^ meeting, shards)
                # a cut's list goes by a name of its own: cuts that meet elsewhere may come to the same shard
                named = mix(tokens[at] + mix(meeting + np.uint64(1)))
                tokens, owner, place, shard = (np.concatenate((x[~long], y)) for x, y in ((tokens, named), (owner, owner[at]), (place, place[at]), (shard, moved)))
            order = np.argsort(shard, kind="stable")
            edge = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(edge)):
                o = order[edge[s] : edge[s + 1]]
                own, mine = np.unique(owner[o], return_inverse=True)
                rows.append((s, pack(tokens[o]), pack(mine.astype(np.uint32)), pack(place[o].astype(np.uint32)), pack(sig[own]), _about(sig[own], n[own], group[own], level[own], out[own])))
            c = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])], ["shard", "tokens", "owner", "place", "sig", "about"])

    return run


def _pairs(percent: int, ranked: bool = False):
    def run(part: pa.Table) -> pa.Table:
        tokens, owner, place, sig, about, base = [], [], [], [], [], 0
        for i in range(part.num_rows):
            row = {c: part[c][i].as_buffer() for c in ("tokens", "owner", "place", "sig", "about")}
            s = np.frombuffer(row["sig"], np.int64)
            tokens.append(np.frombuffer(row["tokens"], np.uint64))
            owner.append(np.frombuffer(row["owner"], np.uint32).astype(np.int64) + base)
            place.append(np.frombuffer(row["place"], np.uint32))
            sig.append(s)
            about.append(_read_about(s, row["about"]))
            base += len(s)
        tokens, owner, place, sig, about = np.concatenate(tokens), np.concatenate(owner), np.concatenate(place), np.concatenate(sig), np.concatenate(about, axis=1)
        # a set that came in several batches counts once
        sig, first, same = np.unique(sig, return_index=True, return_inverse=True)
        n, group, level, out = about[:, first]
        owner = same[owner]
        order = np.lexsort((owner, group[owner], tokens))
        tokens, owner, place = tokens[order], owner[order], place[order]
        once = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])))
        tokens, owner, place = tokens[once], owner[once], place[once].astype(np.int64)
        if ranked:  # the first token shared by a pair counts: what links then lies behind it, in both
            new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            smallest = np.minimum.reduceat(n[owner], np.flatnonzero(new))[np.cumsum(new) - 1]
            fit = percent * (n[owner] + np.maximum(smallest, -(-percent * n[owner] // 100))) <= (100 + percent) * (n[owner] - place)
            tokens, owner, place = tokens[fit], owner[fit], place[fit]
        if not len(tokens):
            return pa.table([pa.array([], pa.int64())] * 4, ["a", "b", "shared", "asked"])
        # lists of a token, and in them the ranges of a class
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        inner = new | np.concatenate(([True], group[owner[1:]] != group[owner[:-1]]))
        begin, own_begin = np.flatnonzero(new), np.flatnonzero(inner)
        lst, own = np.cumsum(new) - 1, np.cumsum(inner) - 1
        size, own_size = np.diff(np.append(begin, len(tokens))), np.diff(np.append(own_begin, len(tokens)))
        others = (size[lst] - own_size[own]) * ((level[owner] > 0) & (place < base_prefix(n[owner], percent) + level[owner] - 1))
        probes = np.flatnonzero(others)
        done = []
        ends = np.cumsum(others[probes])
        at = 0
        while at < len(probes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            p = probes[at:to]
            x = np.repeat(p, others[p])
            r = np.arange(len(x)) - np.repeat(np.cumsum(others[p]) - others[p], others[p])
            skip = own_begin[own[x]] - begin[lst[x]]
            y = begin[lst[x]] + r + np.where(r >= skip, own_size[own[x]], 0)
            a, b = owner[x], owner[y]
            # no more can be shared than stands before these places, if equal, and after them
            shareable = np.minimum(n[a] - place[x], n[b] - place[y]) + (0 if ranked else np.minimum(place[x], place[y]))
            ok = ((a < b) | (level[b] == 0)) & (place[y] < base_prefix(n[b], percent) + level[a] - 1) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & ((100 + percent) * shareable >= percent * (n[a] + n[b]))
            code, count = np.unique(a[ok] * np.int64(len(sig)) + b[ok], return_counts=True)
            done.append((code, count))
            at = to
        if not done:
            return pa.table([pa.array([], pa.int64())] * 4, ["a", "b", "shared", "asked"])
        code, back = np.unique(np.concatenate([c for c, _ in done]), return_inverse=True)
        count = np.bincount(back, np.concatenate([c for _, c in done])).astype(np.int64) if len(code) else np.zeros(0, np.int64)
        a, b = code // len(sig), code % len(sig)
        return pa.table([sig[a], sig[b], count, np.maximum(1, level[a] - out[a])], ["a", "b", "shared", "asked"])

    return run


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def one_each(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """One row a signature. Repeated rows share their name and come all; only then a shuffle is needed, which takes one of each a task."""
    if texts.count() == asked.count():
        return texts
    once = materialize(texts.dropDuplicates(["sig"]), "texts", "zstd")
    discard(texts)
    return once


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, name: str) -> DataFrame:
    """Those of pairs (a, b: signatures) whose whole sets link, as a written table; the texts go. reps: sig and the key of one document that has it."""
    pairs = materialize(pairs, "pairs")
    asked = materialize(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct().join(reps, "sig"), "asked")
    few = asked.count() * 64 <= BROADCAST_BYTES
    texts = one_each(materialize(docs.join(F.broadcast(asked) if few else asked, docs["key"] == asked["rep"]).select("sig", "text"), "texts", "zstd"), asked)
    limit, both = heat_limit(docs, pairs.count()), pairs
    for side, other in (("a", "b"), ("b", "a")):  # a leader may have very many
        hot = pairs.groupBy(side).count().where(F.col("count") > limit).select(side)
        both = spread_join(both, texts.withColumnsRenamed({"sig": side, "text": f"_t{side}"}), [side], hot, other)
    found = materialize(both.select("a", "b", "_ta", "_tb").mapInArrow(_verify(k, percent), "a long, b long"), name)
    discard(asked, texts, pairs)
    release(docs.sparkSession)
    return found


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, percent: int = PERCENT, long: int = SHARD, dense: int = DENSE) -> DataFrame:
    """Per document: key, n_shingles and component_id, the least key reachable by links, itself included.

    Sets are of k-word shingles of the whole text, A-Z lower-cased; a text of fewer words is one shingle; null and empty
    texts have none and link with nothing. Two link if 100 |x & y| >= percent |x | y|. Keys are integers; a repeated row gives a
    repeated result, and rows of one key but different texts are taken one by one. Null keys stay alone (component null). Empty tables give no rows.
    Work in a token's list is by class, not by pair, so groups of copies or near copies cost their size, not its square. Lists of
    more than ``long`` postings are cut; over ``dense`` pairs a set, sets try one partner at a time.
    """
    found = document_classes(docs, text, key, k, percent, long, dense)
    least = found.where("root is not null").groupBy("root").agg(F.min("_key").alias("_least"))
    out = found.join(least, "root", "left")
    return out.select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("_key").isNotNull(), F.coalesce("_least", "_key")).alias("component_id"))


def document_classes(docs: DataFrame, text: str, key: str, k: int, percent: int, long: int = SHARD, dense: int = DENSE) -> DataFrame:
    """Per row: _key, key (its row_name), n (shingles) and root, the same in what links reach, null for rows without shingles."""
    spark = docs.sparkSession
    # a row's name is its key and text, so equal rows are one and others never are
    rows = docs.select(F.col(key).alias("_key"), row_name(key, text).alias("key"), F.col(text).alias("text"))
    base = rows.select(F.struct("_key", "key").alias("key"), "text").mapInArrow(_sets(k, percent), f"key struct<_key:{dict(docs.dtypes)[key]},key:long>, n long, sig long, prefix binary")
    sets = materialize(base.select("key._key", "key.key", "n", "sig", "prefix"), "sets")
    full = sets.where("n > 0")
    reps = materialize(full.groupBy("sig").agg(F.min("key").alias("rep")), "reps")
    named = rows.select("key", "text")

    # to a leader, the one whose least tokens are the most frequent; a set to which one more token is too many links with no other
    full = full.where(f"100 * n >= {percent} * (n + 1)").select("sig", "n", "prefix")
    heads = materialize(full.groupBy("sig").agg(F.first("n").alias("n"), F.lit(0).cast("long").alias("c"), F.first(F.substring("prefix", 1, 8 * LEADERS)).alias("prefix")), "heads")
    least = heads.mapInArrow(_least(), "token long, sig long, n long")
    again = materialize(least.groupBy("token").count().where("count > 1"), "again")
    hot = again.where(F.col("count") > heat_limit(docs, again.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])).select("token")
    known = spread_join(least, again, ["token"], hot, "sig")
    first = verified(_leaders(known.join(known.groupBy("sig").agg(F.sum("count").alias("score")), "sig"), percent, hot), named, reps, k, percent, "first")
    marked = _marked(full, first)
    discard(heads)
    release(spark)

    # what is dear, and who is heavy
    shards = max(1, -(-(marked.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // 8) // SHARD))
    dear = _shared(materialize(marked.mapInArrow(_dear_postings(shards), _MARKS).groupBy("shard").applyInArrow(_dear(DEAR, long), _COSTS), "dear"))
    release(spark)
    heavy = materialize(marked.mapInArrow(_heavy(percent, dear), "sig long, n long, c long").distinct().join(reps.select("sig", "rep"), "sig"), "heavy")
    texts = heavytexts = one_each(materialize(named.join(join_side(heavy, 64), named["key"] == F.col("rep")).select("sig", "n", "c", "text"), "heavytexts", "zstd"), heavy)
    cut = max(1, -(-(heavy.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // SHARD))
    costs = _shared(materialize(texts.mapInArrow(lambda b: _dear_postings(cut, k)(_small_batches(b)), _MARKS).groupBy("shard").applyInArrow(_dear(2, long), _COSTS), "costs"))
    release(spark)

    # heavy sets once more to a leader, the one with the fewest tokens of its own
    common = texts.mapInArrow(lambda b: _common(k, costs)(_small_batches(b)), "token long, sig long, n long, score long")
    again = materialize(common.groupBy("token").count(), "again")
    hot = again.where(F.col("count") > heat_limit(docs, again.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])).select("token")
    stars = verified(_leaders(common, percent, hot), named, reps, k, percent, "stars")
    links = first.unionByName(stars)
    if not stars.isEmpty():
        marked = _marked(full, links)
        texts = _marked(heavytexts.drop("c"), links)
    release(spark)

    # all pairs of different classes: of a set that isn't heavy and any other, then of two heavy sets
    pairs = marked.mapInArrow(_postings(shards, percent, dear), _POSTINGS).groupBy("shard").applyInArrow(_pairs(percent), _PAIRS)
    pairs = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("asked").alias("asked")).where("shared >= asked")
    pairs = materialize(pairs.select("a", "b"), "covered")
    release(spark)
    more = texts.mapInArrow(lambda b: _postings(cut, percent, costs, k)(_small_batches(b)), _POSTINGS).groupBy("shard").applyInArrow(_pairs(percent, True), _PAIRS)
    every = materialize(pairs.unionByName(more.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "every")
    discard(heavytexts, pairs)
    release(spark)
    while every.count() > dense * every.select(F.explode(F.array("a", "b"))).distinct().count():
        before = every
        tried, links, every = _one_each(every, links, named, reps, k, percent)
        release(spark)
        if before.count() - every.count() < 2 * tried:  # the pairs that are left don't link much
            break
    second = verified(every, named, reps, k, percent, "second")
    links = materialize(links.unionByName(second), "links")
    roots = reps.select("sig", F.col("sig").alias("root"))
    if not links.isEmpty():
        roots = reps.join(components(links).withColumnRenamed("node", "sig"), "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"))
    return materialize(sets.join(roots, "sig", "left").select("_key", "key", "n", "root"), "classes")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row left of what links reach: the least key's (a null key comes last). Rows without shingles all stay, and all columns as they are."""
    found = document_classes(docs, text, key, k, percent).where("root is not null")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("_key").isNull(), "_key", "key")).alias("_b"))
    marked = found.join(best, "root").select(F.col("key").alias("_name"), (F.col("key") == F.col("_b.key")).alias("_stays"))
    names = materialize(marked.groupBy("_name").agg(F.first("_stays").alias("_stays"), F.count(F.lit(1)).alias("_n")).where("not _stays or _n > 1"), "names")
    again = names.where("_stays").select("_name")
    named = row_name(key, text)
    left = docs.join(join_side(names.select("_name"), 16), named == F.col("_name"), "left_anti")
    once = docs.join(join_side(again, 16), named == F.col("_name")).dropDuplicates(["_name"]).drop("_name")
    return left.unionByName(once)


def _one_each(every: DataFrame, links: DataFrame, named: DataFrame, reps: DataFrame, k: int, percent: int) -> tuple[int, DataFrame, DataFrame]:
    """Each set tries one of its pairs. How many there were, all links with the new ones, and the pairs of different classes still untried."""
    both = every.unionByName(every.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tried = both.groupBy("a").agg(F.min_by("b", F.xxhash64(F.least("a", "b"), F.greatest("a", "b"))).alias("b"))
    tried = materialize(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    links = materialize(links.unionByName(verified(tried, named, reps, k, percent, "more")), "links")
    left = every.join(tried, ["a", "b"], "left_anti")
    if not links.isEmpty():
        root = components(links)
        for side in ("a", "b"):
            left = left.join(root.withColumnsRenamed({"node": side, "root": f"_{side}"}), side, "left")
        left = left.where("coalesce(_a, a) != coalesce(_b, b)").select("a", "b")
    return tried.count(), links, materialize(left, "every")


def _leaders(known: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """Pairs (a: leader, b) from token, sig, n, score: of those that share a token the best score leads; a set takes the leader that it shares most with."""
    lead = known.groupBy("token").agg(F.max(F.struct("score", "sig", "n")).alias("l")).select("token", F.col("l.sig").alias("a"), F.col("l.n").alias("_n"))
    near = spread_join(known, lead, ["token"], hot, "sig").where(f"a != sig and 100 * least(n, _n) >= {percent} * greatest(n, _n)")
    return near.groupBy(F.col("sig").alias("b"), "a").agg(F.count(F.lit(1)).alias("_c")).groupBy("b").agg(F.max_by("a", F.struct("_c", "a")).alias("a"))


def _marked(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets (sig, n, and one more column) with the class c, which is sig if it has no links."""
    if links.isEmpty():
        return sets.select("sig", "n", F.col("sig").alias("c"), sets.columns[-1])
    classes = join_side(components(links).withColumnRenamed("node", "sig"), 32)
    return sets.join(classes, "sig", "left").select("sig", "n", F.coalesce("root", "sig").alias("c"), sets.columns[-1])


def _common(k: int, costs):
    """The least LEADERS tokens of each heavy set that others have too; its score is less the more tokens are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, _, tokens, owner, _ = _tokens(batch, k)
            hot, _ = _weigh(tokens, costs())
            score = np.bincount(owner[hot], minlength=len(sig)) - n
            tokens, owner = tokens[hot], owner[hot]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            few = place < LEADERS
            own = owner[few]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[few].view(np.int64)), pa.array(sig[own]), pa.array(n[own]), pa.array(score[own])], ["token", "sig", "n", "score"])

    return run


_MARKS = "shard long, tokens binary, marks binary, many binary"
_COSTS = "token long, cost long, cuts long"
_POSTINGS = "shard long, tokens binary, owner binary, place binary, sig binary, about binary"
_PAIRS = "a long, b long, shared long, asked long"


def _shared(dear: DataFrame):
    """Broadcasts tokens, costs and cuts; over DEAR_TOKENS of them, the longest lists and the dearest: the others then count as not dear, which costs time alone."""
    n = dear.count()
    if n > DEAR_TOKENS:
        dear = dear.orderBy(F.desc("cuts"), F.desc("cost"), "token").limit(DEAR_TOKENS)
    table = dear.toArrow()
    tokens = table["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    sent = dear.sparkSession.sparkContext.broadcast((tokens[order], table["cost"].to_numpy()[order], table["cuts"].to_numpy()[order]))
    return lambda: sent.value
