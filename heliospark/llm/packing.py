"""Best-fit packing into several permitted sequence lengths."""

from __future__ import annotations

import bisect
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces that are packed together. Groups are dealt by the key's hash and have about this size; of equal pieces, so many go to one group at a time.
GROUP, COPIES = 20_000, 500


def attention_cost(capacity: int) -> float:
    """What a sequence costs: its length, its square's part for attention, and a fixed part for each sequence."""
    return capacity + capacity * capacity / 16384 + 32.0


@dataclass
class Bin:
    capacity: int
    used: int = 0
    items: list[int] = field(default_factory=list)


def pack(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float] = attention_cost) -> list[Bin]:
    """Best-fit decreasing over bins of any of the capacities; lengths of at most the largest; zeros are packed as well.

    Each item goes to the open bin that it leaves fullest. If none has room, a bin opens: of the capacities that hold
    the item, the one whose cost for each token it can hope to hold is least, the tokens still to come of items that
    could join it being that hope; of equals, the smaller. In the end each bin shrinks to the least capacity that holds its contents.
    """
    capacities = tuple(sorted(set(capacities)))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    ascending = [lengths[i] for i in reversed(order)]
    before = np.concatenate(([0], np.cumsum(ascending)))  # tokens of the n shortest
    bins: list[Bin] = []
    room: dict[int, list[int]] = {}  # bins by the room they have left
    rooms: list[int] = []  # sorted

    def put(b: int, left: int) -> None:
        if left not in room:
            bisect.insort(rooms, left)
            room[left] = []
        room[left].append(b)

    for done, i in enumerate(order):
        n = lengths[i]
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
        else:
            to_come = len(order) - done - 1

            def per_token(c: int) -> float:
                joins = min(to_come, bisect.bisect_right(ascending, c - n))
                return cost(c) / max(1, n + min(c - n, int(before[joins])))

            left = min((c for c in capacities if c >= n), key=lambda c: (per_token(c), c))
            b = len(bins)
            bins.append(Bin(left))
        bins[b].items.append(i)
        bins[b].used += n
        put(b, left - n)
    for b in bins:
        b.capacity = capacities[bisect.bisect_left(capacities, b.used)]
    return bins


def pack_documents(docs: DataFrame, length: str = "n_tokens", key: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP, cost: Callable[[int], float] = attention_cost) -> DataFrame:
    """One row per piece of a document: key, piece, first (its first token), length, bin, place (first token in the bin), capacity, used.

    A document longer than the largest capacity is cut in pieces of that length and a rest. All rows are packed,
    repeated ones each for itself; null or negative lengths count as 0 and such documents get one empty piece; an empty
    table gives no rows. Only keys, lengths and numbers of equal pieces are shuffled, to groups of about ``group`` pieces dealt by hash; of equal
    pieces each COPIES go to the next group. So no task's share grows with the input, be all keys null and all lengths equal. Bins do not span
    groups, which costs under one part-filled bin of each size a group. Same rows, same bins.
    """
    most = max(capacities)
    n = F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long")
    pieces = docs.select(F.col(key).alias("_key"), n.alias("_n"))
    total = pieces.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("_n") / most)))).first()[0] or 0
    groups = max(1, -(-int(total) // group))
    # by piece, not by document: the pieces of one endless text, or equal keys, do not all meet in one group
    pieces = pieces.select("_key", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / most).cast("int") - 1))).alias("piece"))
    pieces = pieces.select("_key", F.col("piece").cast("long").alias("piece"), F.least(F.lit(most), F.col("_n") - F.col("piece") * most).alias("length"))
    pieces = pieces.groupBy("_key", "piece", "length").agg(F.count(F.lit(1)).alias("_c"))
    pieces = pieces.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / COPIES))))
    pieces = pieces.select("_key", "piece", "length", F.least(F.lit(COPIES), F.col("_c") - F.col("_nth") * COPIES).alias("copies"), F.pmod(F.xxhash64(F.col("_key").cast("string"), "piece", "length") + F.col("_nth"), F.lit(groups)).alias("_group"))
    kind = dict(docs.dtypes)[key]

    def packed(part: pa.Table) -> pa.Table:
        part = part.take(np.repeat(np.arange(part.num_rows), part["copies"].to_numpy()))
        part = part.sort_by([("_key", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        lengths = part["length"].to_pylist()
        number = part["_group"][0].as_py()
        out: dict[str, list[int]] = {c: [0] * len(lengths) for c in ("bin", "place", "capacity", "used")}
        for j, b in enumerate(pack(lengths, capacities, cost)):
            at = 0
            for i in b.items:
                out["bin"][i], out["place"][i], out["capacity"][i], out["used"][i] = (number << 32) + j, at, b.capacity, b.used
                at += lengths[i]
        first = pa.array([p * most for p in part["piece"].to_pylist()], pa.int64())
        return pa.table([part["_key"], part["piece"], first, part["length"], *(pa.array(out[c], pa.int64()) for c in out)], ["key", "piece", "first", "length", *out])

    out = pieces.groupBy("_group").applyInArrow(packed, f"key {kind}, piece long, first long, length long, bin long, place long, capacity long, used long")
    return out.withColumnRenamed("key", key)
