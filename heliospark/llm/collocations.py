"""Phrase collocation mining: which words stand together far more often than apart, by language.

1. Words are counted exactly, added up in each task before the shuffle.
2. Sketches: each task counts hashes of n-grams in DEPTH rows of cells, up to the threshold, where they saturate; sums are merged block by block.
   A cell that stays below rules its n-grams out; an n-gram's upper bound is its least cell. First pairs of words, then longer ones of
   which all shorter parts may reach the threshold. Only bits go back to the tasks, of a bounded size.
3. What the bounds leave are candidates. They are dealt to shards by their first two words. So are the fragments of text that
   could hold one: runs of words in one piece, equal ones as one with their number.
4. A shard's candidates compile into automata over whole words (a space on both sides guards them), and its fragments are scanned for all
   overlapping matches. Fragments of a shard are dealt to slices by their words. Counts are added up; then thresholds hold, exactly.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _power, discard, grams, hash_piece, heat_limit, materialize, mix, release, spread_join, text_buffers

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one with its words has this many in a hundred of its occurrences.
CONTAINED = 80
#: Score of a phrase whose parts occur nowhere else: half of this.
SCALE = 2_000_000
DEPTH = 2
#: Cells of a sketch's row, at least and at most, and words to a cell between. Bits of all rows go to all tasks: 4 MB a row at most.
CELLS, WORDS_A_CELL = (1 << 20, 1 << 25), 32
BLOCK = 1 << 20
#: Parts of a block that are added up in one group.
FAN = 64
#: Patterns of one automaton, at most; words of the corpus to a slice of a shard; entries that a task adds up before it sends them on.
AUTOMATON, SLICE_WORDS, HELD = 200_000, 8_000_000, 200_000
#: Bytes of text that are hashed at once.
RUN_BYTES = 1 << 20
#: A to Z lower-cased; what ends a piece to a line feed; a tab to a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
_BREAKS = np.isin(np.arange(256), [10, 32])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text to lang, word, n."""
    held: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64())], ["lang", "word", "n"])
        held.clear()

    for batch in batches:
        raw, off = text_buffers(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            n = held[lang]
            before = len(n)
            n.update(raw[off[i] : off[i + 1]].tobytes().translate(_PLAIN).split())
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


@dataclass
class Run:
    """The words of some texts, or parts of texts. Windows begin only at words before ``limit``, which has the end of each part: the rest begins the next part."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    part: np.ndarray
    first: np.ndarray  # by part, its number of words before
    limit: np.ndarray
    lang: list[str]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """By word, the hash of k words from there with the language, and whether they are in one piece."""
        n = max(0, len(self.hashes) - k + 1)
        known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in set(self.lang)}
        seeds = np.array([known[x] for x in self.lang], np.uint64) + np.uint64(k)
        return mix(grams(self.hashes, k) ^ seeds[self.part[:n]]) if n else np.zeros(0, np.uint64), self.piece[k - 1 :][:n] == self.piece[:n]

    def begins(self, n: int) -> np.ndarray:
        return np.arange(n) < self.limit[self.part[:n]]

    def texts(self, first: np.ndarray, end: np.ndarray) -> list[bytes]:
        """Words from first up to end, joined by single spaces."""
        out = [self.data[a:b] for a, b in zip(self.starts[first].tolist(), self.ends[end - 1].tolist())]
        return [b" ".join(x.split()) if b"  " in x else x for x in out]

    def langs(self, word: np.ndarray) -> list[str]:
        return [self.lang[i] for i in self.part[word].tolist()]


def _parts(data: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """A text in parts of about RUN_BYTES, and of each part from which byte on it is repeated in the next. Cut between pieces, or else between words."""
    at, end, chunk = 0, len(data), RUN_BYTES
    while end - at > chunk:
        cut = data.rfind(b"\n", at, at + chunk)
        if cut >= at:
            if cut > at:
                yield data[at:cut], cut - at
            at = cut + 1
            continue
        # no piece ends: at a space with enough words before it, or where the piece does end
        close = data.find(b"\n", at + chunk)
        close = end if close < 0 else close
        cut = data.find(b" ", at + chunk, close)
        while cut >= 0 and len(data[at:cut].rsplit(None, longest)) <= longest:
            cut = data.find(b" ", cut + chunk, close)
        if cut < 0:
            yield data[at:close], close - at
            at = close + 1
            continue
        back = cut
        for _ in range(longest - 1):
            back = data.rfind(b" ", at, at + len(data[at:back].rstrip(b" "))) + 1
        yield data[at:cut], back - at
        at = back
    if at < end:
        yield data[at:end], end - at


def runs(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[Run]:
    """lang, text to runs of words."""
    held: list[tuple[str, bytes, int]] = []
    size = 0

    def made() -> Run:
        data = b"\n".join(d for _, d, _ in held)
        begin = np.cumsum([0, *(len(d) + 1 for _, d, _ in held[:-1])])
        raw = np.frombuffer(data, np.uint8)
        starts, ends, hashes = hash_piece(raw, False, _BREAKS)
        part = np.searchsorted(begin, starts, "right") - 1
        limit = np.searchsorted(starts, begin + np.array([x for _, _, x in held]))
        return Run(data, starts, ends, hashes, np.cumsum(raw == 10)[starts], part, np.searchsorted(starts, begin), limit, [x for x, _, _ in held])

    for batch in batches:
        raw, off = text_buffers(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            for d, back in _parts(raw[off[i] : off[i + 1]].tobytes().translate(_PLAIN), longest):
                held.append((lang, d, back))
                size += len(d)
                if size >= RUN_BYTES:
                    yield made()
                    held.clear()
                    size = 0
    if held:
        yield made()


class Sketch:
    """Which cells reach the threshold, by length of n-gram and row."""

    def __init__(self, bits: dict[tuple[int, int], np.ndarray], cells: int, shards: int = 1):
        self.bits, self.cells, self.shards = bits, cells, shards

    def cell(self, h: np.ndarray, row: int) -> np.ndarray:
        return ((h >> np.uint64(32 * row)) & np.uint64(self.cells - 1)).astype(np.int64)

    def heavy(self, h: np.ndarray, k: int) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row in range(DEPTH):
            c = self.cell(h, row)
            out &= (self.bits[k, row][c >> 3] >> (c & 7).astype(np.uint8)) & 1 > 0
        return out

    def live(self, run: Run, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By length from 2: hashes, and where n-grams may reach the threshold with all of their parts."""
        below = None
        for k in range(2, longest + 1):
            h, ok = run.grams(k)
            if below is not None:
                ok = ok & below[: len(h)] & below[1 : len(h) + 1]
            if (k, 0) in self.bits:
                at = np.flatnonzero(ok)
                ok[at] = self.heavy(h[at], k)
            yield k, h, ok
            below = ok

    def shard(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs) % np.uint64(self.shards)).astype(np.int64)


def _sketched(sketch: Sketch, lengths: list[int], least: int):
    """Counts of cells, saturated at the threshold, in blocks: k, row, block, part, cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {(k, row): np.zeros(sketch.cells, np.uint16) for k in lengths for row in range(DEPTH)}
        one, step = np.uint16(1), 65_535 - least
        for words in runs(batches, max(lengths)):
            for k, h, ok in sketch.live(words, max(lengths)):
                if k in lengths:
                    h = h[ok & words.begins(len(h))]
                    for row in range(DEPTH):
                        cells, to = sketch.cell(h, row), counts[k, row]
                        for i in range(0, len(cells), step):  # no cell overflows in a step
                            some = cells[i : i + step]
                            np.add.at(to, some, one)
                            to[some] = np.minimum(to[some], least)
        part = TaskContext.get().partitionId()
        wide = least > 255
        for (k, row), n in counts.items():
            for b in range(0, sketch.cells, BLOCK):
                block = n[b : b + BLOCK]
                if block.any():
                    yield _block(k, row, b // BLOCK, part, block if wide else block.astype(np.uint8))

    return run


_BLOCK_SCHEMA = "k int, row int, block int, part long, wide boolean, cells binary"


def _block(k: int, row: int, block: int, part: int, cells: np.ndarray) -> pa.RecordBatch:
    packed = pa.compress(cells.tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int64()), pa.array([cells.dtype == np.uint16]), pa.array([packed], pa.binary())], ["k", "row", "block", "part", "wide", "cells"])


def _added(cells: int, least: int, bits: bool = False):
    """Blocks added up; in the end as bits, whether the threshold is reached."""
    size = min(cells, BLOCK)

    def run(part: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint32)
        kind = np.uint16 if least > 255 else np.uint8
        for x in part["cells"]:
            raw = pa.decompress(x.as_py(), size * np.dtype(kind).itemsize, codec="zstd", asbytes=True)
            np.minimum(total + np.frombuffer(raw, kind), least, out=total)
        first = [part[c][0].as_py() for c in ("k", "row", "block", "part")]
        if bits:
            return pa.table([pa.array([x], pa.int32()) for x in first[:3]] + [pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["k", "row", "block", "bits"])
        return pa.Table.from_batches([_block(*first[:3], first[3] // FAN, total.astype(kind))])

    return run


def sketch_of(rows: DataFrame, known: Sketch, lengths: list[int], least: int) -> Sketch:
    """``known`` with n-grams of further lengths. The parts of a block are added up FAN at a time, so no group grows with the input."""
    cells = known.cells
    parts = rows.mapInArrow(_sketched(known, lengths, least), _BLOCK_SCHEMA)
    for _ in range(3):  # FAN**3 parts
        parts = parts.withColumn("_group", F.col("part").cast("long") - F.col("part") % FAN).groupBy("k", "row", "block", "_group").applyInArrow(_added(cells, least), _BLOCK_SCHEMA)
    parts = parts.groupBy("k", "row", "block").applyInArrow(_added(cells, least, True), "k int, row int, block int, bits binary")
    bits = {(k, row): np.zeros(cells // 8, np.uint8) for k in lengths for row in range(DEPTH)}
    for x in parts.toArrow().to_pylist():  # cells / 8 bytes a row
        at = x["block"] * BLOCK // 8
        bits[x["k"], x["row"]][at : at + len(x["bits"])] = np.frombuffer(x["bits"], np.uint8)
    return Sketch(known.bits | bits, cells)


_EMITTED = "lang string, shard long, slice int, phrase string, k int, texts binary, numbers binary"


def _emitted(sketch: Sketch, longest: int, slices: int = 1):
    """Candidates, once a task: lang, shard, phrase and k, its words. Fragments, many a row: lang, shard, slice, their texts and numbers, compressed."""
    names = ["lang", "shard", "slice", "phrase", "k", "texts", "numbers"]

    def candidates(lang: list[str], shard: np.ndarray, phrase: list[bytes], k: int) -> pa.RecordBatch:
        n = len(phrase)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(shard), pa.nulls(n, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(np.full(n, k, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)

    def fragments(held: _Held) -> Iterator[pa.RecordBatch]:
        to: dict[tuple[str, int, int], list[int]] = defaultdict(list)
        which = np.empty(len(held.phrase), np.int64)
        which[held.place] = (held.name % np.uint64(slices)).astype(np.int64)
        for i, key in enumerate(zip(held.lang, held.shard.tolist(), which.tolist())):
            to[key].append(i)
        for (lang, shard, part), rows in to.items():
            texts, n = b"\n".join([held.phrase[i] for i in rows]), held.n[rows]
            packed = [pa.compress(x, codec="zstd", asbytes=True) for x in (texts, n.tobytes())]
            columns = [pa.array([lang], pa.string()), pa.array([shard], pa.int64()), pa.array([part], pa.int32()), pa.nulls(1, pa.string()), pa.array([0], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(texts).to_bytes(8, "little") + packed[0]], pa.binary()), pa.array([len(n).to_bytes(8, "little") + packed[1]], pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: np.zeros(0, np.uint64) for k in range(2, longest + 1)}
        held = _Held()
        for words in runs(batches, longest):
            live = list(sketch.live(words, longest))
            _, pairs, ok = live[0]
            begins = words.begins(len(pairs))
            at = np.flatnonzero(ok & begins)
            shard = sketch.shard(pairs)
            reach = at + 2
            for k, h, good in live:
                if k > 2:
                    longer = np.zeros(len(pairs), bool)
                    longer[: len(good)] = good
                    reach = np.where(longer[at], at + k, reach)
                mine = np.flatnonzero(good & begins[: len(good)])
                found, where = np.unique(h[mine], return_index=True)
                place = np.searchsorted(seen[k], found)
                new = np.flatnonzero(seen[k][np.minimum(place, len(seen[k]) - 1)] != found) if len(seen[k]) else np.arange(len(found))
                if len(new):
                    first = mine[where[new]]
                    yield candidates(words.langs(first), shard[first], words.texts(first, first + k), k)
                    seen[k] = np.insert(seen[k], place[new], found[new])
            held.add(words, *_fragments(words, at, reach, shard[at]))
            if len(held.name) > HELD:
                yield from fragments(held)
                held = _Held()
        yield from fragments(held)

    return run


def _unpacked(texts: bytes, numbers: bytes) -> Iterator[tuple[str, int]]:
    n, size = (int.from_bytes(x[:8], "little") for x in (numbers, texts))
    counts = np.frombuffer(pa.decompress(numbers[8:], 8 * n, codec="zstd", asbytes=True), np.int64)
    return zip(pa.decompress(texts[8:], size, codec="zstd", asbytes=True).decode().split("\n"), counts.tolist())


class _Held:
    """Fragments of a task by the hash of their words, language and shard: a text is made of the first of equal ones alone."""

    def __init__(self):
        self.name, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted names, and where each stands in the rest
        self.n, self.shard = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lang: list[str] = []
        self.phrase: list[bytes] = []

    def add(self, words: Run, name: np.ndarray, first: np.ndarray, end: np.ndarray, shard: np.ndarray, n: np.ndarray) -> None:
        at = np.searchsorted(self.name, name)
        known = self.name[np.minimum(at, len(self.name) - 1)] == name if len(self.name) else np.zeros(len(name), bool)
        self.n[self.place[at[known]]] += n[known]
        new = np.flatnonzero(~known)
        places = len(self.phrase) + np.arange(len(new))
        self.phrase += words.texts(first[new], end[new])
        self.lang += words.langs(first[new])
        self.n, self.shard = np.concatenate((self.n, n[new])), np.concatenate((self.shard, shard[new]))
        self.name, self.place = np.insert(self.name, at[new], name[new]), np.insert(self.place, at[new], places)


def _fragments(words: Run, at: np.ndarray, reach: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (first word, end) of one shard that overlap, as one fragment each: its name, first word, end, shard and number; equal ones once, in the order of names.

    What a fragment has of the words that begin the next part is found there again: as a fragment of its own it is taken off.
    """
    if not len(at):
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
    order = np.lexsort((at, shard))
    first, end, of = at[order], reach[order], shard[order]
    # a running maximum over all, lifted by the rank of the shard, is one by shard
    lift = np.cumsum(np.concatenate(([0], of[1:] != of[:-1]))) * (len(words.starts) + 1)
    top = np.maximum.accumulate(end + lift)
    begin = np.flatnonzero(np.concatenate(([True], (first + lift)[1:] >= top[:-1])))
    stop = np.append(begin[1:], len(first)) - 1
    a, b, s, n = first[begin], top[stop] - lift[stop], of[begin], np.ones(len(begin), np.int64)
    back = words.limit[words.part[a]]
    over = np.flatnonzero(b - back >= 2)
    a, b, s, n = np.append(a, back[over]), np.append(b, b[over]), np.append(s, s[over]), np.append(n, -n[over])
    up, down = _power(len(words.hashes) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.hashes * up[: len(words.hashes)])))
    langs = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in set(words.lang)}
    seeds = np.array([langs[x] for x in words.lang], np.uint64)
    name = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    name = mix(name + mix(seeds[words.part[a]]) + mix(s.astype(np.uint64) + np.uint64(1 << 40)))
    name, where, which = np.unique(name, return_index=True, return_inverse=True)
    return name, a[where], b[where], s[where], np.bincount(which, n, len(name)).astype(np.int64)


def _scan(size: int):
    """Overlapping matches of a shard's candidates in a slice of its fragments."""

    def run(patterns: pa.Table, fragments: pa.Table) -> pa.Table:
        import ahocorasick

        phrases, lang = patterns["phrase"].to_pylist(), patterns["lang"].to_pylist()
        held: Counter = Counter()
        for texts, numbers in zip(fragments["texts"], fragments["numbers"]):
            for text, n in _unpacked(texts.as_py(), numbers.as_py()):
                held[text] += n
        counts = [0] * len(phrases)
        for begin in range(0, len(phrases), size):
            automaton = ahocorasick.Automaton()
            for i in range(begin, min(begin + size, len(phrases))):
                automaton.add_word(f" {phrases[i]} ", i)
            automaton.make_automaton()
            for text, n in held.items():
                for _, i in automaton.iter(f" {text} "):
                    counts[i] += n
        at = [i for i, c in enumerate(counts) if c]
        return pa.table([pa.array([lang[i] for i in at], pa.string()), pa.array([phrases[i] for i in at], pa.string()), pa.array([patterns["k"][i].as_py() for i in at], pa.int32()), pa.array([counts[i] for i in at], pa.int64())], ["lang", "phrase", "k", "a"])

    return run


def phrase_counts(rows: DataFrame, words: int, least: int, longest: int) -> DataFrame:
    """lang, phrase, k (its words) and a: phrases of 2 to ``longest`` words with at least ``least`` occurrences, counted exactly."""
    cells = CELLS[0]
    while cells < min(CELLS[1], words // WORDS_A_CELL):
        cells *= 2
    sketch = sketch_of(rows, Sketch({}, cells), [2], least)
    release(rows.sparkSession)
    if longest > 2:
        sketch = sketch_of(rows, sketch, list(range(3, longest + 1)), least)
        release(rows.sparkSession)
    bound = sum(min(int(np.bitwise_count(sketch.bits[k, row]).sum()) for row in range(DEPTH)) for k in range(2, longest + 1))
    sketch.shards = max(1, -(-bound // AUTOMATON))
    slices = max(1, -(-words // (sketch.shards * SLICE_WORDS)))
    out = materialize(rows.mapInArrow(_emitted(sketch, longest, slices), _EMITTED), "fragments", "zstd")
    # columns of its own, as both sides come of one table
    fragments = out.where("k = 0").select(*(F.col(c).alias(c) for c in ("lang", "shard", "slice", "texts", "numbers")))
    patterns = out.where("k > 0").select("lang", "shard", "phrase", "k").distinct().select("lang", "shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "phrase", "k")
    keys = ["lang", "shard", "slice"]
    found = patterns.groupBy(*keys).cogroup(fragments.groupBy(*keys)).applyInArrow(_scan(AUTOMATON), "lang string, phrase string, k int, a long")
    counts = materialize(found.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")
    discard(out)
    release(rows.sparkSession)
    return counts


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, contained: int = CONTAINED, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: by language (null: und) the phrases that hold together best, the first ``top`` or all (None).

    A to Z are lower-cased; pieces end at . , ; : ! ? and line ends, words at spaces and tabs. Candidates are phrases of 2 to ``longest`` words
    with a >= ``least`` occurrences inside pieces, overlaps included. A cut after k words leaves parts with l and r occurrences and
    scores floor(SCALE * a / (l + r)); the least counts, of equals that of the smallest k. Candidates inside a longer one with at least ``contained`` in a
    hundred of their occurrences go. Order: score and a descending, phrase ascending in UTF-8. n: all words of the language. All counts are exact.

    Null and empty texts have no words; repeated rows count each; keys and other columns are not read; an empty table gives no rows. Long texts
    are read in overlapping parts, and nothing of them is left out. Broadcast are bits of the sketches alone, at most 4 MB a row whatever
    the input; beyond that they rule out less, and shards become more.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    words = materialize(rows.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words", "zstd")
    release(docs.sparkSession)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = phrase_counts(rows, words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], least, longest)
    whole = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")))
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice(w, F.lit(1), F.col("cut")), " ").alias("part")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice(w, F.col("cut") + 1, F.size(w)), " ").alias("part")))
    asked = cuts.select("lang", "phrase", "a", "cut", F.explode(sides).alias("_s")).select("lang", "phrase", "a", "cut", "_s.side", "_s.part")
    by_part = materialize(asked.groupBy("lang", "part").count(), "parts")
    hot = by_part.where(F.col("count") > heat_limit(rows, by_part.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])).select("lang", "part")
    known = spread_join(asked, whole, ["lang", "part"], hot, "phrase")
    of = lambda c, side: F.max(F.when((F.col("cut") == c) & (F.col("side") == side), F.col("f")))
    held = known.groupBy("lang", "phrase", "a").agg(*(of(c, s).alias(f"{s}{c}") for c in range(1, longest) for s in "lr"))
    score = lambda c: F.expr(f"(cast({SCALE} as decimal(18,0)) * cast(a as decimal(20,0))) div cast(l{c} + r{c} as decimal(20,0))")
    best = F.array_min(F.filter(F.array(*(F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, longest))), lambda x: x["l"].isNotNull()))
    scored = held.select("lang", "phrase", "a", best.alias("_b")).select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
    spans = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = phrases.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(f"_longer is null or 100 * _longer < {contained} * a").drop("_longer")
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
