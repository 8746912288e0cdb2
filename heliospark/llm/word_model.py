"""Perplexity a word under an interpolated modified Kneser-Ney model of word n-grams up to three, thresholded by language.

Words are between white space, A-Z lower-cased. Documents are taken in blocks; the trusted texts' words get numbers, frequent
ones small, and from then on blocks hold numbers. Trusted triples (a, b, c) are counted in the shard of their pair (b, c),
where the pair's different a are its continuation count. Sums over the contexts (a, b) go on to the shard of that pair, sums
over words to theirs. So a block asks each shard once, for its distinct pairs, what stood before them, and words;
it is answered with counts, and interpolates itself. What travels is sorted, as differences, and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_by, discard, discard_part, hash_share, hashed_words, join_side, materialize, materialize_by, mix, release, row_name, text_buffers

#: Trusted documents in this share aren't counted but set the thresholds, at this quantile of their language.
CALIBRATE = 0.2
QUANTILE = 0.995
#: Words in a block, about; a longer document is cut into several parts, each with the two words before it.
BLOCK = 2_000_000
#: Bytes of text that make a bucket of blocks, about.
BUCKET = 12 << 20
#: Blocks are scored in so many slices, one after the other.
SLICES = 4
#: Numbers of a document's start and of a word that no trusted text has; others are larger.
START, UNSEEN = 0, 1
_STEP = np.uint64(0xD1342543DE82EF95)


def key_of(*numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of rows of numbers."""
    out = np.full(len(numbers[0]), len(numbers), np.uint64)
    for x in numbers:
        out = mix(out * _STEP + x.astype(np.uint64))
    return out


def shard_of(shards: int, *numbers: np.ndarray) -> np.ndarray:
    return (key_of(*numbers) % np.uint64(shards)).astype(np.int64)


# --- columns of whole numbers as bytes


def squeeze(columns: list[np.ndarray], keys: int = 0, level: int = 3) -> bytes:
    """Columns as one compressed text, byte by byte of their numbers. The first ``keys`` of them are sorted, and stored as differences."""
    import zstandard

    new, out, head = None, [], []
    for i, x in enumerate(columns):
        x = np.asarray(x).astype(np.uint64)
        if i < keys and len(x):
            step = np.diff(x, prepend=np.uint64(0))
            again = step == 0
            if new is not None:
                step[new] = x[new]
                again &= ~new
            again[0] = False
            new, x = ~again, step
        size = 1 if not len(x) else next(s for s in (1, 2, 4, 8) if int(x.max()) >> (8 * s) == 0)
        head += [len(x), size]
        out.append(np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes())
    ldm = {"compression_params": zstandard.ZstdCompressionParameters.from_level(level, window_log=23, enable_ldm=True)} if level > 3 else {"level": level}
    return np.array([len(columns), *head], np.uint32).tobytes() + zstandard.ZstdCompressor(**ldm).compress(b"".join(out))


def expand(data: bytes, keys: int = 0) -> list[np.ndarray]:
    import zstandard

    n = int(np.frombuffer(data, np.uint32, 1)[0])
    head = np.frombuffer(data, np.uint32, 2 * n, 4).reshape(-1, 2)
    raw = zstandard.ZstdDecompressor().decompress(data[4 + 8 * n :])
    out, at, new = [], 0, None
    for i, (rows, size) in enumerate(head.tolist()):
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, rows * size, at).reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.uint64)
        at += rows * size
        if i < keys and rows:
            step, total = x, np.cumsum(x, dtype=np.uint64)
            if new is not None:  # absolute where an earlier column is new
                begin = np.flatnonzero(new)
                total -= np.repeat(total[begin] - step[begin], np.diff(np.append(begin, rows)))
            again = np.append(False, total[1:] == total[:-1])
            new = ~again if new is None else new | ~again
            x = total
        out.append(x.view(np.int64))
    return out


def _order(keys: list[np.ndarray]) -> np.ndarray:
    """The places of rows in the order of their keys (not negative), equal rows as they stand: the last keys first, as many at a time as fit beside a place into 64 bits."""
    place, left, order = len(keys[0]).bit_length(), list(keys), None
    while left:
        code, used = np.arange(len(keys[0]), dtype=np.uint64), place
        while left and used + (size := int(left[-1].max(initial=0)).bit_length()) <= 64:
            k = left.pop() if order is None else left.pop()[order]
            if size:
                code |= k.astype(np.uint64) << np.uint64(used)
            used += size
        if used == place and left:
            return np.lexsort(keys[::-1])
        code.sort()
        at = (code & np.uint64((1 << place) - 1)).view(np.int64)
        order = at if order is None else order[at]
    return order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (not negative), sorted, and each one's place among them."""
    if not len(keys):
        return keys, keys
    order = _order([keys])
    ranked = keys[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], back


def _sorted_sums(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of keys, sorted, and the sums of their values."""
    if not len(keys[0]):
        return keys, values
    order = _order(keys)
    keys = [k[order] for k in keys]
    new = np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
    begin = np.flatnonzero(new)
    return [k[begin] for k in keys], [np.add.reduceat(v[order], begin) for v in values]


def _rows(columns: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = {"data": pa.binary(), "kind": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(columns, names)], names)


def _by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has rows, and their places in order."""
    shard = shard.astype(np.uint16) if shards < 1 << 16 else shard  # sorted by radix
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edge)):
        yield int(s), order[edge[s] : edge[s + 1]]


def _dealt(shard: np.ndarray, shards: int, keys: list[np.ndarray], values: list[np.ndarray], kind: str) -> pa.RecordBatch:
    found = [(s, kind, squeeze([x[at] for x in (*keys, *values)], len(keys))) for s, at in _by_shard(shard, shards)]
    return _rows(list(zip(*found)) or [[], [], []], ["shard", "kind", "data"])


SUMS = "shard long, kind string, data binary"
#: By kind: how many of its columns are keys.
KEYS = {"triples": 3, "contexts": 2, "words": 1}


def _summed(part: pa.Table) -> pa.Table:
    """The rows of a shard and kind as one, with equal keys added up."""
    kind = part["kind"][0].as_py()
    k = KEYS[kind]
    pieces = [expand(x.as_py(), k) for x in part["data"]]
    columns = [np.concatenate(c) for c in zip(*pieces)]
    keys, values = _sorted_sums(columns[:k], columns[k:])
    return pa.table([pa.array([part["shard"][0].as_py()], pa.int64()), pa.array([kind]), pa.array([squeeze([*keys, *values], k)], pa.binary())], ["shard", "kind", "data"])


# --- blocks


def _blocks(size: int):
    """Rows (number, role, text) in blocks: parts (number, place, bytes, words, role), the distinct words, and the words' places among those.

    Each part's words stand behind the two before them; the hash of a document's start is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, words, held = [], [], 0

        def out() -> pa.RecordBatch:
            table = [np.array(c, np.int64) for c in zip(*parts)]
            found = pa.array(np.concatenate(words)).dictionary_encode()
            known, place = np.unique(found.dictionary.to_numpy(), return_inverse=True)
            place = place[found.indices.to_numpy()]
            name = int(mix(np.array([np.add.reduce(mix(table[0].view(np.uint64) + table[1].view(np.uint64))) + np.uint64(held)], np.uint64)).view(np.int64)[0])
            return _rows([[name], [squeeze([c.view(np.uint64) for c in table])], [squeeze([known], 1)], [squeeze([place], level=5)]], ["block", "data", "data", "data"]).rename_columns(["block", "parts", "words", "tokens"])

        for batch in batches:
            number, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, off = text_buffers(batch.column(2))
            for a, b, hashes, bounds in hashed_words(raw, off, lower=True):
                for i in range(a, b):
                    first, last = int(bounds[i - a]), int(bounds[i - a + 1])
                    for at in range(first, max(last, first + 1), size):
                        to = min(last, at + size)
                        before = np.zeros(2, np.uint64)
                        if at > first:
                            before[max(0, 2 - (at - first)) :] = hashes[max(first, at - 2) : at]
                        parts.append((number[i], (at - first) // size, int(off[i + 1] - off[i]), to - at, role[i]))
                        words += [before, hashes[at:to]]
                        held += to - at
                        if held >= size * 3 // 4 or len(parts) >= size // 4 + 1:
                            yield out()
                            parts, words, held = [], [], 0
        if parts:
            yield out()

    return run


class Block:
    """A block's parts, and its words' numbers as one sequence. ``scored``: the places that aren't the two before a part."""

    def __init__(self, parts: bytes, numbers: np.ndarray, tokens: bytes):
        self.number, self.place, self.n_bytes, self.n_words, self.role = expand(parts)
        self.local = numbers  # of the distinct words, sorted
        self.token = expand(tokens)[0]
        ends = np.cumsum(self.n_words + 2)
        self.scored = np.ones(len(self.token), bool)
        self.scored[ends - self.n_words - 2] = self.scored[ends - self.n_words - 1] = False
        self.owner = np.repeat(np.arange(len(ends)), self.n_words)

    def grams(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Local numbers a, b, c of the triples that end at these places."""
        at = np.flatnonzero(where)
        return self.token[at - 2], self.token[at - 1], self.token[at]


def _trusted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for parts, words, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            b = Block(parts, None, tokens)
            mine = b.scored.copy()
            mine[b.scored] = b.role[b.owner] == 1
            n = np.bincount(b.token[mine], minlength=1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(expand(words, 1)[0][at]), pa.array(n[at])], ["w", "n"])


def _asks_numbers(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(*(c.to_pylist() for c in batch.columns)):
                w = expand(words, 1)[0]
                found = [(s, block, squeeze([w.view(np.uint64)[at]], 1)) for s, at in _by_shard(shard_of(shards, w), shards)]
                yield _rows(list(zip(*found)) or [[], [], []], ["shard", "block", "data"])

    return run


def _numbers_dealt(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(shards, w)), *batch.columns], ["shard", "w", "number"])

    return run


def _give_numbers(key, asked: pa.Table, known: pa.Table) -> pa.Table:
    w, number = known["w"].to_numpy().view(np.uint64), known["number"].to_numpy()
    order = np.argsort(w)
    w, number, out = w[order], number[order], []
    for x in asked["data"]:
        q = expand(x.as_py(), 1)[0].view(np.uint64)
        out.append(squeeze([_found(w, number, q, UNSEEN)]))
    return pa.table([asked["block"], asked["shard"], pa.array(out, pa.binary())], ["block", "shard", "data"])


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, none: int = 0) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), none, np.int64)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], none)


def _coded(shards: int):
    """Blocks in numbers: parts, the distinct numbers (sorted) and the words' places among them."""

    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for block, parts, words, tokens in zip(*(blocks[c].to_pylist() for c in ("block", "parts", "words", "tokens"))):
            w = expand(words, 1)[0]
            number = np.full(len(w), UNSEEN, np.int64)
            places = dict(_by_shard(shard_of(shards, w), shards))
            for s, data in zip(answers["shard"].to_pylist(), answers["data"].to_pylist()):
                number[places[s]] = expand(data)[0]
            number[w == 0] = START
            local, back = np.unique(number, return_inverse=True)
            rows.append((block, parts, squeeze([local], 1), squeeze([back[expand(tokens)[0]]], level=5)))
        c = list(zip(*rows)) or [[]] * 4
        return pa.table([pa.array(c[0], pa.int64()), *(pa.array(x, pa.binary()) for x in c[1:])], ["block", "parts", "numbers", "tokens"])

    return run


def _read(parts, numbers, tokens) -> Block:
    return Block(parts, expand(numbers, 1)[0], tokens)


# --- counts


def _triples(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                block = _read(*row)
                mine = block.scored.copy()
                mine[block.scored] = block.role[block.owner] == 1
                a, b, c = block.grams(mine)
                if not len(a):
                    continue
                keys, (n,) = _sorted_sums([b, c, a], [np.ones(len(a), np.int64)])
                keys = [block.local[k] for k in keys]
                yield _dealt(shard_of(shards, keys[0], keys[1]), shards, keys, [n], "triples")

    return run


def _classes(n: np.ndarray) -> list[np.ndarray]:
    """A count, and by row whether it is 1, 2, or 3 and more."""
    return [n, *((n == i).astype(np.int64) for i in (1, 2)), (n >= 3).astype(np.int64)]


def _pairs_of(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where new pairs begin in sorted triples."""
    return np.flatnonzero(np.concatenate(([True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])))) if len(b) else np.zeros(0, np.int64)


def _contexts(shards: int):
    """Of each shard's triples: sums over the contexts (a, b), and by word of the pairs that it begins or ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                b, c, a, n = expand(data, 3)
                keys, sums = _sorted_sums([a, b], _classes(n))
                yield _dealt(shard_of(shards, *keys), shards, keys, sums, "contexts")
                begin = _pairs_of(b, c)
                before = np.diff(np.append(begin, len(b)))
                none, one = np.zeros(len(begin), np.int64), np.ones(len(begin), np.int64)
                first = [none, *_classes(before)]
                last = [one, none, none, none, none]
                keys, sums = _sorted_sums([np.concatenate((b[begin], c[begin]))], [np.concatenate(p) for p in zip(first, last)])
                yield _dealt(shard_of(shards, *keys), shards, keys, sums, "words")

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By order: how many n-grams have each count up to 4, how many there are, and the counts' sum."""
    for batch in batches:
        for kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            columns = expand(data, KEYS[kind])
            if kind == "triples":
                found = {3: columns[3], 2: np.diff(np.append(_pairs_of(columns[0], columns[1]), len(columns[0])))}
            else:
                found = {1: columns[1][columns[1] > 0]}
            for order, n in found.items():
                yield _rows([[order], *[[int((n == i).sum())] for i in (1, 2, 3, 4)], [len(n)], [int(n.sum())]], ["k", "n1", "n2", "n3", "n4", "m", "n"])


def discounts(n: dict[int, int]) -> np.ndarray:
    """By count 1, 2, and 3 or more (place 0 is 0): modified Kneser-Ney, held between 0.05 and the count less 0.05."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.array([0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] and n[i + 1] else 0.5 * i for i in (1, 2, 3)])


# --- what blocks ask, and how they are scored


class Questions:
    """A block's distinct pairs, triples and words, and where each shard's stand."""

    def __init__(self, block: Block, shards: int):
        token, size = block.token, len(block.local)
        # all pairs within a part: that of its two words before too
        ends = np.ones(len(token), bool)
        ends[np.cumsum(block.n_words + 2) - block.n_words - 2] = False
        at, pair = np.flatnonzero(ends), np.zeros(len(token), np.int64)
        self.pairs, pair[at] = _distinct(token[at - 1] * size + token[at])
        at = np.flatnonzero(block.scored)
        self.pair, self.context = pair[at], pair[at - 1]
        self.triples, self.triple = _distinct(self.pair * size + token[at - 2])
        self.first, self.last = np.divmod(self.pairs, size)
        self.x, self.y = block.local[self.first], block.local[self.last]
        self.of, before = np.divmod(self.triples, size)
        self.a = block.local[before]
        known = (self.x != UNSEEN) & (self.y != UNSEEN)
        shard = shard_of(shards, self.x, self.y)
        shard[~known] = shards
        mine = shard[self.of].copy()
        mine[self.a == UNSEEN] = shards
        word = shard_of(shards, block.local)
        word[block.local == UNSEEN] = shards
        self.parts = [dict(_by_shard(s, shards)) for s in (shard, mine, word)]


def _asks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                block = _read(*row)
                q, none, found = Questions(block, shards), np.zeros(0, np.int64), []
                before = np.bincount(q.of[q.a != UNSEEN], minlength=len(q.pairs))
                for s in range(shards):
                    pair, triple, word = (p.get(s, none) for p in q.parts)
                    if len(pair) or len(word):
                        found.append((s, name, squeeze([q.x[pair], q.y[pair]], 2), squeeze([before[pair], q.a[triple]]), squeeze([block.local[word]], 1)))
                c = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), *(pa.array(x, pa.binary()) for x in c[2:])], ["shard", "block", "pairs", "before", "words"])

    return run


class Prefixes:
    """Places of sorted rows of two numbers: a first number's among the distinct ones, and with it the row's.

    Rows that are asked in order stand near each other here too.
    """

    def __init__(self, first: np.ndarray, last: np.ndarray):
        self.first, self.last = _steps(first)
        self.rows = _joined(self.last, last)

    def places(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """By asked row its place, -1 without any."""
        at, there = _place(self.first, first)
        rows, found = _place(self.rows, _joined(at, last))
        return np.where(there & found, rows, -1)


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and each one's place among them."""
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    return x[new], np.cumsum(new) - 1


def _joined(place: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A place in a shard (28 bits: a shard has the pairs of about four blocks) and a number (36 bits: of distinct words) as one."""
    return (place.astype(np.uint64) << np.uint64(36)) | number.astype(np.uint64)


def _place(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where asked ones stand among sorted keys, or would, and whether they are there."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _answers(key, asked: pa.Table, known: pa.Table) -> pa.Table:
    """Counts: of pairs (continuations; as a context: sum and how many 1, 2, 3), of triples, of words (the same as of pairs)."""
    sums = {k: [np.zeros(0, np.int64)] * 7 for k in KEYS} | {k: expand(d.as_py(), KEYS[k]) for k, d in zip(known["kind"].to_pylist(), known["data"])}
    b, c, a, n = sums["triples"][:4]
    begin = _pairs_of(b, c)
    before = np.diff(np.append(begin, len(b)))
    pairs, contexts, words = Prefixes(b[begin], c[begin]), Prefixes(*sums["contexts"][:2]), sums["words"][0]
    triples = _joined(np.repeat(np.arange(len(begin)), before), a)
    look = lambda values, at: [np.where(at >= 0, v[at], 0) if len(v) else np.zeros(len(at), np.int64) for v in values]
    out = []
    for p, q, w in zip(*(asked[x].to_pylist() for x in ("pairs", "before", "words"))):
        x, y = expand(p, 2)
        mine, a = expand(q)
        pair = pairs.places(x, y)
        of = np.repeat(pair, mine)
        at, found = _place(triples, _joined(np.maximum(of, 0), a))
        triple = np.where(found & (of >= 0), at, -1)
        at, found = _place(words, expand(w, 1)[0])
        word = np.where(found, at, -1)
        out.append(squeeze([*look([before], pair), *look(sums["contexts"][2:6], contexts.places(x, y)), *look([n], triple), *look(sums["words"][1:6], word)]))
    return pa.table([asked["block"], asked["shard"], pa.array(out, pa.binary())], ["block", "shard", "data"])


def interpolate(q: Questions, pair: np.ndarray, triple: np.ndarray, word: np.ndarray, off: dict[int, np.ndarray], whole: tuple[int, int]) -> np.ndarray:
    """Log-probability of each word. pair and word: by row continuations and context sums; whole: the words' counts' sum and how many words."""

    def alpha(n, total, d):
        return np.where((n > 0) & (total > 0), np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1), 0.0)

    def gamma(sums, d):
        return np.where(sums[0] > 0, (d[1] * sums[1] + d[2] * sums[2] + d[3] * sums[3]) / np.maximum(sums[0], 1), 1.0)

    # what follows from a word or pair alone is found once for each
    total, below = whole
    p = alpha(word[0], np.int64(total), off[1]) + below
    p = alpha(pair[0], word[1][q.first], off[2]) + gamma(word[1:], off[2])[q.first] * p[q.last]
    p = alpha(triple[q.triple], pair[1][q.context], off[3]) + gamma(pair[1:], off[3])[q.context] * p[q.pair]
    return np.log(p)


SCORED = "number long, part long, n_bytes long, n_words long, logp double"


def _scores(shards: int, off: dict[int, np.ndarray], whole: tuple[int, float]):
    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in zip(*(blocks[c].to_pylist() for c in ("parts", "numbers", "tokens"))):
            block = _read(*row)
            q = Questions(block, shards)
            pair, triple, word = np.zeros((5, len(q.pairs)), np.int64), np.zeros(len(q.triples), np.int64), np.zeros((5, len(block.local)), np.int64)
            none = np.zeros(0, np.int64)
            for s, data in zip(answers["shard"].to_pylist(), answers["data"].to_pylist()):
                got = expand(data)
                pair[:, q.parts[0].get(s, none)] = got[:5]
                triple[q.parts[1].get(s, none)] = got[5]
                word[:, q.parts[2].get(s, none)] = got[6:]
            logs = interpolate(q, pair, triple, word, off, whole)
            out.append(pa.table([block.number, block.place, block.n_bytes, block.n_words, np.bincount(block.owner, logs, len(block.number)).astype(float)], ["number", "part", "n_bytes", "n_words", "logp"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.float64())], ["number", "part", "n_bytes", "n_words", "logp"])

    return run


# --- documents


def with_roles(docs: DataFrame, trusted: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """_key, _lang, number (of key and text), role (1: to learn from, 2: to calibrate with, 0: neither) and text, null as empty."""
    ids = trusted.select(F.col(trusted.columns[0]).alias("_id")).where("_id is not null").distinct()
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(text).alias("text")).join(join_side(ids, 64), F.col("_key") == F.col("_id"), "left")
    role = F.when(F.col("_id").isNull(), 0).when(hash_share(F.col("_key"), 31) < CALIBRATE, 2).otherwise(1)
    return rows.select("_key", "_lang", row_name("_key", "text").alias("number"), role.cast("long").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def judged(rows: DataFrame, scores: DataFrame, key: str, quantile: float) -> DataFrame:
    """Thresholds by language, and who is under them. scores: number, n_bytes, n_words and logp."""
    found = rows.drop("text").join(scores, "number").withColumn("perplexity", F.exp(-F.try_divide("logp", "n_words")))
    found = materialize(found, "perplexities")
    known_good = found.where("role = 2 and perplexity is not null")
    limits = known_good.groupBy("_lang").agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("_t"))
    whole = known_good.agg(F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias("_w"))
    out = found.join(join_side(limits.where("_lang is not null"), 128), "_lang", "left").join(F.broadcast(whole))
    limit = F.coalesce("_t", "_w")
    return out.select(F.col("_key").alias(key), "n_bytes", "n_words", "perplexity", (F.col("role") > 0).alias("trusted"), limit.alias("threshold"), F.coalesce(F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf"))), F.lit(False)).alias("kept"))


def numbered(words: DataFrame) -> DataFrame:
    """w and its number: frequent words have small ones. Sorted in ranges; only how many each range has is collected."""
    at = materialize(words.orderBy(F.desc("n"), "w").select("w", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_i")), "numbered")
    sizes, first, total = {r["_p"]: r["n"] for r in at.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}, [], UNSEEN + 1
    for p in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in first or [0]]), F.col("_p") + 1)
    return at.select("w", (base + F.col("_i")).alias("number"))


def word_perplexities(docs: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", quantile: float = QUANTILE, block: int = BLOCK) -> DataFrame:
    """Per document: key, n_bytes, n_words, perplexity (a word), trusted, threshold (of its language) and kept.

    trusted: keys of documents to learn from, all of them but a share of CALIBRATE, chosen by the key's hash, from whose perplexities
    come the thresholds; a language without such documents, null too, has the threshold of all. Whole texts count, long ones in parts.
    Null and empty texts have no perplexity and aren't kept; without trusted texts all words are as likely and texts with a word
    are kept. Rows of one key and text share a result. Empty tables give none. Tables and questions grow with the texts.
    """
    spark = docs.sparkSession
    rows = with_roles(docs, trusted, text, lang, key)
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    buckets = max(8, -(-n_bytes // BUCKET))
    blocks = rows.select("number", "role", "text").mapInArrow(_blocks(block), "block long, parts binary, words binary, tokens binary")
    blocks = materialize_by(blocks.withColumn("slice", F.pmod("block", F.lit(SLICES)).cast("int")), "blocks", "block", buckets, "uncompressed", "slice")
    shards = max(8, -(-blocks.count() // 4))
    names = numbered(blocks.select("parts", "words", "tokens").mapInArrow(_trusted_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    release(spark)

    # tables of a slice of the blocks go as soon as the next ones are written
    coded = []
    for i in range(SLICES):
        some = blocks.where(F.col("slice") == i).drop("slice")
        asked = some.select("block", "words").mapInArrow(_asks_numbers(shards), "shard long, block long, data binary")
        numbers = asked.groupBy("shard").cogroup(names.mapInArrow(_numbers_dealt(shards), "shard long, w long, number long").groupBy("shard")).applyInArrow(_give_numbers, "block long, shard long, data binary")
        numbers = materialize(numbers, "numbers", "uncompressed")
        release(spark)
        made = some.groupBy("block").cogroup(numbers.groupBy("block")).applyInArrow(_coded(shards), "block long, parts binary, numbers binary, tokens binary")
        coded.append(materialize_by(made, "coded", "block", buckets, "uncompressed"))
        discard(numbers)
        discard_part(blocks, "slice", i)
        release(spark)
    discard(blocks, names)
    every = coded[0]
    for c in coded[1:]:
        every = every.unionByName(c)

    # one table in buckets by shard, which no slice shuffles: triples, and then the sums that come of them
    known = materialize_by(every.select("parts", "numbers", "tokens").mapInArrow(_triples(shards), SUMS).groupBy("shard", "kind").applyInArrow(_summed, SUMS), "counts", "shard", shards, "uncompressed")
    release(spark)
    known = append_by(known, known.select("data").mapInArrow(_contexts(shards), SUMS).groupBy("shard", "kind").applyInArrow(_summed, SUMS))
    release(spark)
    sizes = known.where("kind != 'contexts'").select("kind", "data").mapInArrow(_sizes, "k long, n1 long, n2 long, n3 long, n4 long, m long, n long")
    sizes = {r["k"]: r for r in sizes.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "m", "n")]).collect()}  # three rows
    off = {k: discounts({i: sizes[k][f"n{i}"] if k in sizes else 0 for i in (1, 2, 3, 4)}) for k in (1, 2, 3)}
    total, below = 0, 1.0
    if sizes:
        one = sizes[1]
        total = one["n"]
        below = (off[1][1] * one["n1"] + off[1][2] * one["n2"] + off[1][3] * (one["m"] - one["n1"] - one["n2"])) / total / (one["m"] + 1)

    # questions are as large as the texts: of a slice only a share of them is on its way at a time
    scores = None
    for some in coded:
        asked = some.mapInArrow(_asks(shards), "shard long, block long, pairs binary, before binary, words binary")
        answers = materialize(asked.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_answers, "block long, shard long, data binary"), "answers", "uncompressed")
        release(spark)
        found = some.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scores(shards, off, (total, below)), SCORED)
        found = materialize(found, "scored")
        discard(answers, some)
        release(spark)
        scores = found if scores is None else scores.unionByName(found)
    discard(known)
    # a repeated row has its parts twice
    parts = scores.groupBy("number", "part").agg(*[F.max(c).alias(c) for c in ("n_bytes", "n_words", "logp")])
    scores = materialize(parts.groupBy("number").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n_words").alias("n_words"), F.sum("logp").alias("logp")), "scores")
    release(spark)
    return judged(rows, scores, key, quantile)
