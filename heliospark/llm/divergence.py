"""Source divergence audit: how far sources of a language are apart in their words, and by which words.

1. Terms are counted by text, added up in each task by (lang, source), then shuffled by (lang, term): there a term's documents
   are added up over all sources, and rare terms go.
2. Terms are dealt by hash to blocks of about BLOCK_TERMS, sources to bands of about BAND. A tile is a block and two bands of one
   language: a dense int64 matrix of sources by terms, zeros included.
3. In a tile all pairs of its sources are broadcast against each other: partial sums by pair. Each source of it keeps its TOP terms.
4. Partial sums are added over blocks; the blocks' heaps of a source are merged by a window that is limited before its shuffle.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, text_buffers

LEAST_DOCS = 10
TOP = 10
#: Terms of a block and sources of a band, about; a tile has at most two bands.
BLOCK_TERMS = 8_000
BAND = 64
#: Numbers in a temporary matrix while pairs are broadcast.
CELLS = 1 << 20
#: Terms that a task adds up before it sends them on.
HELD = 400_000
UNIT = 1_000_000_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text to lang, source, term, n (occurrences) and docs (rows with it), of as many rows as memory allows at once."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        held.clear()

    for batch in batches:
        raw, off = text_buffers(batch.column(2))
        data = raw.tobytes()
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if off[i] == off[i + 1]:
                continue
            n, docs = held.setdefault(key, (Counter(), Counter()))
            before = len(n)
            found = Counter(data[off[i] : off[i + 1]].translate(_LETTERS).split())
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before
            if size > HELD:
                yield from flush()
                size = 0
    yield from flush()


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total) for 0 <= count <= total < 2**53, three digits of the quotient at a time: no product overflows."""
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def pair_sums(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The sum of distances over all terms, by pair: all pairs of a strip of rows are broadcast at once."""
    out = np.zeros((len(rows), len(others)), np.int64)
    terms = rows.shape[1]
    if not terms or not len(rows) or not len(others):
        return out
    width = max(1, min(terms, CELLS // max(1, len(others))))
    strip = max(1, CELLS // (len(others) * width))
    for t in range(0, terms, width):
        for i in range(0, len(rows), strip):
            out[i : i + strip] += distance(rows[i : i + strip, None, t : t + width], others[None, :, t : t + width]).sum(2)
    return out


def largest(values: np.ndarray, names: np.ndarray, most: int) -> list[tuple[int, bytes]]:
    """The heap of the ``most`` first by value descending, name ascending (bytes)."""
    if len(values) > most:
        at = np.flatnonzero(values >= np.partition(values, len(values) - most)[len(values) - most])
        values, names = values[at], names[at]
    return heapq.nsmallest(most, ((-int(v), n) for v, n in zip(values, names)))


def _tile(top: int):
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def run(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, block, a, b = (k.as_py() for k in key)
        groups = groups.sort_by("source")  # pairs are named alike in all blocks
        sources = groups["source"].to_pylist()
        out: list[tuple[str, str, str, int]] = []
        if not sources:
            return pa.table({n: pa.array([], t) for n, t in zip(schema.names, schema.types)})
        row = {s: i for i, s in enumerate(sources)}
        band = groups["band"].to_numpy()
        size, all_size, kept = groups["size"].to_numpy(), groups["lang_size"].to_numpy(), groups["kept"].to_numpy()
        codes = counts["term"].combine_chunks().dictionary_encode() if counts.num_rows else None
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        terms = len(codes.dictionary) if codes is not None else 0
        matrix, everywhere = np.zeros((len(sources), terms), np.int64), np.zeros(terms, np.int64)
        if terms:
            at = codes.indices.to_numpy()
            matrix[np.fromiter((row[s] for s in counts["source"].to_pylist()), np.int64, counts.num_rows), at] = counts["n"].to_numpy()
            everywhere[at] = counts["lang_n"].to_numpy()
        p = shares(matrix + 2, (size + 2 * kept)[:, None]) if terms else matrix
        first, second = np.flatnonzero(band == a), np.flatnonzero(band == b)
        sums = pair_sums(p[first], p[second])
        if kept[0]:  # kept terms that neither band has: counted for all terms in block 0, and taken off where a tile has the term
            bare = shares(np.full((len(sources), 1), 2), (size + 2 * kept)[:, None])
            sums += pair_sums(bare[first], bare[second]) * ((kept[0] if block == 0 else 0) - terms)
        for i, x in enumerate(first):
            for j, y in enumerate(second):
                if a != b or x < y:
                    out.append((sources[x], "pair", sources[y], int(sums[i, j])))
        if a == b and terms:
            q = shares(everywhere + 2, np.int64(all_size[0] + 2 * kept[0]))
            names = np.array([t.encode() for t in codes.dictionary.to_pylist()], object)
            for i, s in enumerate(sources):
                more = np.flatnonzero((matrix[i] > 0) & (p[i] > q))
                out += [(s, "term", n.decode(), -v) for v, n in largest(distance(p[i, more], q[more]), names[more], top)]
        s, part, item, value = zip(*out) if out else ((), (), (), ())
        return pa.table([pa.array([lang] * len(s), pa.string()), pa.array(s, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], schema=schema)

    return run


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block_terms: int = BLOCK_TERMS, band: int = BAND) -> DataFrame:
    """lang, source, part, item, value, rank (from 1 by value descending, then item ascending in UTF-8).

    Terms are runs of letters (a to z, after A to Z are lower-cased, and all beyond ASCII). A language keeps the terms in at least ``least_docs`` of
    its rows. With n of a group's N occurrences of kept terms and V kept terms, a term's share is p = 1 + floor(10**9 * (n + 2) / (N + 2 V)), and p and q
    are floor((p - q)**2 / (p + q)) apart. Part ``pair``: each other source of the language, value summed over kept terms, all ranks. Part ``term``:
    kept terms of the source with p over the language's q, the first ``top``. All in exact whole numbers.

    Null text, lang and source are read as ''; groups without terms, and languages without kept terms, have their pairs all the same, a lone source none.
    Repeated rows count each; keys and other columns are not read; an empty table gives no rows. A text is counted whole, one at a time. No task
    gets a source or a language: terms are added up before the shuffle and dealt by (lang, term); tiles have a bounded size.
    """
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    counted = rows.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    # one shuffle by (lang, term) serves both sums
    counted = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    every = Window.partitionBy("lang", "term")
    first = F.row_number().over(every.orderBy("source")) == 1
    kept = counted.select("lang", "term", "source", "n", F.sum("docs").over(every).alias("_docs"), F.sum("n").over(every).alias("lang_n"), first.alias("first")).where(F.col("_docs") >= least_docs).drop("_docs")
    kept = materialize(kept, "terms", "zstd")
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("kept"))
    zero = F.lit(0).cast("long")
    groups = rows.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = materialize(groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("size", "lang_size", "kept"))), "groups")
    terms, most = by_lang.agg(F.coalesce(F.sum("kept"), zero)).first()[0], groups.groupBy("lang").count().agg(F.coalesce(F.max("count"), zero)).first()[0]
    blocks, bands = max(1, -(-terms // block_terms)), max(1, -(-most // band))
    in_band = F.pmod(F.xxhash64("source"), F.lit(bands)).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda o: F.struct(F.least("band", o).alias("a"), F.greatest("band", o).alias("b")))
    spread = lambda df: df.withColumn("band", in_band).withColumn("_t", F.explode(others))
    left = spread(kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))).select("lang", "block", "_t.a", "_t.b", "term", "source", "n", "lang_n")
    right = spread(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))).select("lang", "block", "_t.a", "_t.b", "source", "band", "size", "lang_size", "kept")
    keys = ["lang", "block", "a", "b"]
    tiles = materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(top), "lang string, source string, part string, item string, value long"), "tiles")
    discard(kept, groups)
    half = tiles.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = half.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("_p"), "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "_p.source", F.lit("pair").alias("part"), "_p.item", "value").withColumn("rank", F.row_number().over(by))
    heaps = tiles.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.unionByName(heaps)
