"""What the operators share: scratch tables, let-bindings for columns, and vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides up to this many bytes may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Buckets of a written table, at most (Spark's own limit is 100,000).
MAX_BUCKETS = 50_000
#: Text is hashed in pieces of about this many bytes, so that memory does not follow the size of an Arrow batch.
CHUNK_BYTES = 4 << 20

_local_scratch: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir. Where that is unset, a local folder in local mode (tests); a cluster fails."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local_scratch:
            _local_scratch.append("file://" + tempfile.mkdtemp(prefix="heliospark-"))
        base = _local_scratch[0]
    return f"{base.rstrip('/')}/heliospark-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and survives the loss of any executor."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def materialize_by(df: DataFrame, name: str, key: str, buckets: int, codec: str = "lz4", part: str | None = None) -> DataFrame:
    """As materialize, in buckets by key: what is grouped by key later is read bucket by bucket, and not shuffled. By part, in folders that can be discarded alone."""
    spark, table = df.sparkSession, f"heliospark_{name}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{table}"
    buckets = min(buckets, MAX_BUCKETS)
    w = df.write.option("compression", codec).option("path", path).bucketBy(buckets, key)
    (w.partitionBy(part) if part else w).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out._scratch, out._table, out._by = path, table, (key, buckets, codec)
    return out


def append_by(table: DataFrame, df: DataFrame) -> DataFrame:
    """A table of materialize_by with more rows, in the same buckets. df may come of the table."""
    spark, (key, buckets, codec) = table.sparkSession, table._by
    df.write.option("compression", codec).mode("append").bucketBy(buckets, key).saveAsTable(table._table, format="parquet")
    spark.catalog.refreshTable(table._table)
    out = spark.table(table._table)
    out._scratch, out._table, out._by = table._scratch, table._table, table._by
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that no later stage reads: what was made of them is written itself."""
    for df in tables:
        if table := getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        if path := getattr(df, "_scratch", None):
            jvm = df.sparkSession.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def discard_part(table: DataFrame, part: str, value: int) -> None:
    """Deletes one folder of a table of materialize_by that no later stage reads."""
    spark = table.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table._scratch}/{part}={value}")
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished stages now, not whenever the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, at row_bytes a row, surely stays under the broadcast limit. Counts one row beyond the limit at most."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def join_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its size is proven to be small; else as it is, for a shuffled join."""
    return F.broadcast(df) if bounded(df, row_bytes) else df


def heat_limit(df: DataFrame, rows: int) -> int:
    """Rows of one key from which it is hot among so many: half of what a task gets. So at most two keys a task are hot."""
    return max(1, rows // (2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key. Rows of the keys in hot (of heat_limit) are spread over all tasks by a hash of ``by``."""
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot.isEmpty():
        return left.join(right, keys, how)
    marked = F.broadcast(hot.select(*keys).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(tasks)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
    left = left.join(marked, keys, "left").withColumn("_salt", salt).drop("_hot")
    right = right.join(marked, keys, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def row_name(key: str, text: str) -> Column:
    """A 64-bit hash of a row's key and text, null keys included: equal rows share it, rows of one key and other texts don't."""
    return F.xxhash64(F.col(key).isNull(), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text).isNull(), F.col(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_column(text: Column, separator: str = r"[\x20\x09-\x0D]+") -> Column:
    """The array of words between separators; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separator), lambda w: w != "")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n + 1 offsets; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(column) else raw[:0], off - off[0]


_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(n, base)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


#: By byte: whether it is white space.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def hash_piece(piece: np.ndarray, lower: bool, breaks: np.ndarray = SPACE, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a piece; breaks: by byte, whether it is outside of words.

    With heads, hashes has a row for the words and one for each length in heads: the hash of the first bytes of longer
    words, else 0.
    """
    space = breaks[piece]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if lower:
        piece = piece + np.where((piece >= 65) & (piece <= 90), np.uint8(32), np.uint8(0))
    up, down = _power(len(piece) + 1)
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_TABLE[piece] * up[: len(piece)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M)
    if heads:
        rows = [np.where(starts + k < ends, mix((total[np.minimum(starts + k, ends)] - total[starts]) * down[starts] + np.uint64(k << 20)), np.uint64(0)) for k in heads]
        hashes = np.stack([hashes, *rows])
    return starts, ends, hashes


def hashed_words(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of whole documents: first and last document (exclusive), the hashes of all their words, and each document's bounds in them.

    Equal words have equal hashes in every batch and on every machine.
    """
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1)
        # a separator between documents: their bytes may touch in the buffer
        lengths = np.diff(off[at : to + 1])
        if to - at == 1:
            hashes = list(_long_text(raw[off[at] : off[to]], lower))
            out = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            yield at, to, out, np.array([0, len(out)])
        else:
            shift = np.arange(to - at)
            piece = np.full(int(lengths.sum()) + to - at, 32, np.uint8)
            place = np.repeat(shift, lengths) + np.arange(int(lengths.sum()))
            piece[place] = raw[off[at] : off[to]]
            starts, _, hashes = hash_piece(piece, lower)
            yield at, to, hashes, np.searchsorted(starts, np.append(off[at:to] - off[at] + shift, len(piece)))
        at = to


def _long_text(raw: np.ndarray, lower: bool) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        to = at + CHUNK_BYTES
        while to < len(raw):  # on to the next white space
            part = raw[to : to + CHUNK_BYTES]
            found = np.flatnonzero(SPACE[part])
            if len(found):
                to += int(found[0])
                break
            to += len(part)
        yield hash_piece(raw[at:to], lower)[2]
        at = to


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at each of the first len - k + 1 positions; they may run over documents' ends."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    return mix(out)


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return (F.xxhash64(key.cast("string"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).cast("double")
