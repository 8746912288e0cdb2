"""Repeated passages: windows of words that occur twice or more anywhere, found in FM-indexes by shard.

Every window of WINDOW words has an anchor: of the hashes of its runs of GRAM words, the least one (the leftmost of
equals). Equal windows have equal anchors, so windows are dealt to shards by anchor and no shard needs another's.
Neighbouring windows with the same anchor are one segment of a document. Anchors that occur once are dropped; of equal
segments one is sent, with their number; each shard indexes its segments and streams them against the index.

An anchor with too many different segments for one shard (a passage that stands in very many texts) gets longer: its segments
are cut into runs of GROUPS windows by how far in the anchor stands, and what these windows have in common is their anchor;
in the end each window is its own. Then equal ones are one, and the others occur once and go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, _power, discard, grams, hashed_words, heat_limit, materialize, mix, pack, release, row_name, spread_join, text_buffers
from .fm_index import repeated_windows

WINDOW = 35
GRAM = 6
#: Words of all segments in a shard, about; and different segments of one anchor, at most.
SHARD_WORDS = 400_000
SEGMENTS = 6000
#: Windows in a run of a cut segment, in the first cut and the second.
GROUPS = (6, 1)
_SLICE = 1 << 22


def anchors(words: np.ndarray, last: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor hash and anchor's place of each segment. words: hashes; last: by word, its document's end."""
    out = []
    for base in range(0, max(1, len(words) - width + 1), _SLICE):
        part = words[base : base + _SLICE + width - 1]
        n = len(part) - width + 1
        if n <= 0:
            break
        g = grams(part, gram)
        key = (g & ~np.uint64((1 << 23) - 1)) | np.arange(len(g), dtype=np.uint64)
        span, low, reach = width - gram + 1, key, 1
        while 2 * reach <= span:
            low = np.minimum(low[: len(low) - reach], low[reach:])
            reach *= 2
        low = np.minimum(low[: n], low[span - reach : span - reach + n])
        at = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
        s = np.flatnonzero(np.arange(base, base + n) + width <= last[base : base + n])  # within one document
        if len(s):
            new = np.concatenate(([True], (at[s[1:]] != at[s[:-1]]) | (s[1:] != s[:-1] + 1)))
            begin = np.flatnonzero(new)
            out.append((s[begin] + base, np.diff(np.append(begin, len(s))), mix(g[at[s[begin]]]), at[s[begin]] + base))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def cut_anchors(words: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray, width: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of segments cut into runs of up to ``group`` windows; a run's anchor is all that its windows could have in common."""
    window = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    place = np.repeat(at, n)
    number = (place - window) // group
    new = np.flatnonzero(np.concatenate(([True], (np.diff(number) != 0) | (np.diff(place) != 0)))) if len(window) else np.zeros(0, np.int64)
    start = (place - number * group)[new]
    return window[new], np.diff(np.append(new, len(window))), mix(_span_hash(words, start, start + width - group + 1) + np.uint64(group)), place[new]


def _span_hash(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power(len(words) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])))
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def _last(bounds: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(bounds[1:], np.diff(bounds)) if n else np.zeros(0, np.int64)


def _segments(width: int, gram: int, hot: list[np.ndarray]):
    """Segments; with hot, those alone whose anchors are hot, and after each cut so again, but for the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for a, b, words, bounds in hashed_words(*text_buffers(batch.column(1))):
                first, n, key, at = anchors(words, _last(bounds, len(words)), width, gram)
                for keys, group in zip(hot, GROUPS):
                    mine = np.isin(key.view(np.int64), keys)
                    first, n, key, at = cut_anchors(words, first[mine], n[mine], at[mine], width, group)
                doc = np.searchsorted(bounds, first, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key.view(np.int64), _span_hash(words, first, first + n + width - 1).view(np.int64), rid[a:b][doc], (first - bounds[doc]).astype(np.int32), n.astype(np.int32))], ["anchor", "content", "rid", "first", "n"]
                )

    return run


def _payload(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1)
            for a, b, words, bounds in hashed_words(*text_buffers(batch.column(0))):
                rows = []
                for i in range(a, b):
                    for s in asked[i].as_py():
                        at = bounds[i - a] + s["first"]
                        rows.append((s["anchor"], s["content"], s["c"], pack(words[at : at + s["n"] + width - 1])))
                columns = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], ["anchor", "content", "c", "words"])

    return run


def _search(width: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        column = part["words"].combine_chunks() if part["words"].num_chunks != 1 else part["words"].chunk(0)
        raw, off = text_buffers(column)
        seg, first, n = repeated_windows(raw.view(np.uint64) if len(raw) % 8 == 0 else raw, off // 8, part["c"].to_numpy(), width)
        return pa.table([part["anchor"].to_numpy()[seg], part["content"].to_numpy()[seg], pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "content", "at", "run"])

    return run


def shared_segments(docs: DataFrame, width: int, gram: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Segments (anchor, content, rid, first, n) whose anchors occur twice or more; and of equal ones one place s and their number c."""
    hot, parts, ones = [], [], []
    while True:
        segments = docs.mapInArrow(_segments(width, gram, hot), "anchor long, content long, rid long, first int, n int")
        # counting before the shuffle makes one row of each anchor in a task
        again = materialize(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1"), "anchors")
        release(docs.sparkSession)
        limit = heat_limit(docs, again.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0])
        shared = materialize(spread_join(segments, again.select("anchor"), ["anchor"], again.where(F.col("_c") > limit), "rid", "left_semi"), "segments")
        discard(again)
        release(docs.sparkSession)
        one = materialize(shared.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "first", "n")).alias("s")), "one")
        parts.append(shared)
        ones.append(one)
        if len(hot) == len(GROUPS):
            break
        # the limit rises from 2**20 times as many segments on: so hot anchors are bounded, and sent to all
        crowded = one.groupBy("anchor").count().where(F.col("count") > F.greatest(F.lit(most), F.lit(one.count() >> 20))).select("anchor").toArrow()["anchor"].to_numpy()
        if not len(crowded):
            break
        hot.append(np.sort(crowded))
    for i, keys in enumerate(hot):  # what was cut is searched in its cuts
        gone = F.broadcast(docs.sparkSession.createDataFrame(pa.table({"anchor": keys})))
        parts[i], ones[i] = parts[i].join(gone, "anchor", "left_anti"), ones[i].join(gone, "anchor", "left_anti")
    shared, one = parts[0], ones[0]
    for p, o in zip(parts[1:], ones[1:]):
        shared, one = shared.unionByName(p), one.unionByName(o)
    return shared, one


def asked_texts(docs: DataFrame, side: DataFrame, names: int) -> DataFrame:
    """text and asked by name. Repeated rows share their name and all fit a place: one will do, however many they are. Only then texts are shuffled."""
    mine = docs.join(side, docs["rid"] == F.col("_rid"))
    if mine.select("rid").count() > names:
        mine = mine.dropDuplicates(["rid"])
    return mine.select("text", "asked")


def repeated_spans(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, most: int = SEGMENTS) -> DataFrame:
    """rid and spans: by distinct (key, text), the windows that occur elsewhere, as runs (first window, number).

    docs: rid long, text. Written tables carry the stages, so a lost executor costs its own tasks alone.
    """
    spark = docs.sparkSession
    shared, one = shared_segments(docs, width, gram, most)
    asked = materialize(one.groupBy(F.col("s.rid").alias("_rid")).agg(F.collect_list(F.struct("anchor", "content", "c", "s.first", "s.n")).alias("asked")), "asked")
    sent, total = asked.agg(F.coalesce(F.sum(F.size("asked")), F.lit(0)), F.coalesce(F.sum(F.expr(f"aggregate(asked, 0L, (a, s) -> a + s.n + {width - 1})")), F.lit(0))).first()
    side = F.broadcast(asked) if 128 * sent <= BROADCAST_BYTES else asked
    payload = asked_texts(docs, side, asked.count()).mapInArrow(_payload(width), "anchor long, content long, c long, words binary")
    shards = max(1, -(-int(total) // SHARD_WORDS))
    found = payload.withColumn("_shard", F.pmod("anchor", F.lit(shards))).groupBy("_shard").applyInArrow(_search(width), "anchor long, content long, at int, run int")
    found = materialize(found.groupBy("anchor", "content").agg(F.collect_set(F.struct("at", "run")).alias("runs")), "runs")
    discard(asked)
    release(spark)
    hot = one.where(F.col("c") > heat_limit(docs, one.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]))
    spans = spread_join(shared, found, ["anchor", "content"], hot, "rid").select("rid", F.explode(F.expr("transform(runs, r -> struct(first + r.at as first, r.run as n))")).alias("r"))
    return spans.groupBy("rid").agg(F.array_sort(F.collect_set("r")).alias("spans"))


def covered(n_words: int, spans: list[dict] | None, width: int) -> np.ndarray:
    """By word, whether a repeated window covers it."""
    edge = np.zeros(n_words + 1, np.int32)
    for s in spans or ():
        edge[s["first"]] += 1
        edge[s["first"] + s["n"] + width - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WINDOW, gram: int = GRAM, digest: bool = False, keep: list[str] | None = None, most: int = SEGMENTS) -> DataFrame:
    """Per document: key, the columns in ``keep``, n_words, n_removed, and the text without the words that repeated windows cover.

    A window is ``width`` consecutive words of one document; it is repeated if its words also start anywhere else, in the
    same document too. All windows are judged on the input. With ``digest``, kept_sha256 (of the kept words, joined by one space) takes
    the text's place. In the text, a removed word goes with the white space after it. Null texts have no words (the text
    stays null), shorter texts no window. Rows with equal texts repeat each other, be their keys equal or null. Empty tables
    give no rows. Texts are handled whole: a long one only makes more segments.
    """
    spark = docs.sparkSession
    keep = [c for c in dict.fromkeys(keep or []) if c not in (key, text, "n_words", "n_removed")]
    rid = row_name(key, text).alias("rid")
    spans = materialize(repeated_spans(docs.select(rid, F.col(text).alias("text")), width, gram, most), "spans")
    release(spark)
    sent = spans.agg(F.coalesce(F.sum(F.size("spans") * 40 + 100), F.lit(0))).first()[0]
    side = spans.withColumnRenamed("rid", "_rid")
    rows = docs.select(F.col(text).alias("_t"), F.struct(key, *keep).alias("_row"), rid)
    rows = rows.join(F.broadcast(side) if sent <= BROADCAST_BYTES else side, rows["rid"] == F.col("_rid"), "left").select("_t", "spans", "_row")
    new = "kept_sha256" if digest else "_out"
    schema = T.StructType([rows.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(new, T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, texts = [], [], []
            raw, off = text_buffers(batch.column(0))
            data = raw.tobytes()
            for i, s in enumerate(batch.column(1)):
                whole = data[off[i] : off[i + 1]]
                words = whole.split()
                n.append(len(words))
                s = s.as_py()
                cover = covered(len(words), s, width) if s else None
                gone.append(int(cover.sum()) if s else 0)
                if digest:
                    kept = [w for w, c in zip(words, cover) if not c] if s else words
                    texts.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                elif batch.column(0)[i].is_valid:
                    texts.append((_without(whole, words, cover) if s else whole).decode("utf-8", "replace"))
                else:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["_row", "n_words", "n_removed", new])

    return rows.mapInArrow(cut, schema).select("_row.*", "n_words", "n_removed", F.col(new).alias(new if digest else text))


def _without(whole: bytes, words: list[bytes], cover: np.ndarray) -> bytes:
    out, at, begin, removing = [], 0, 0, False
    for w, c in zip(words, cover):
        place = whole.index(w, at)
        if c and not removing:
            out.append(whole[begin:place])
        elif removing and not c:
            begin = place
        removing = bool(c)
        at = place + len(w)
    if not removing:
        out.append(whole[begin:])
    return b"".join(out)
