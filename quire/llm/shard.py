"""Sharding by histogram sort.

Rows have a key in two parts: a hash of the text, then a hash of the id, so that equal texts
are neighbours and even one large group of them can be cut. Splitters are found by counting:
a round counts, over all partitions, the exact bytes below candidate keys, narrows each
splitter's interval to the two candidates around its target, and spaces new candidates in it,
until every splitter is within its tolerance or its interval holds one key. Then the rows are
exchanged once, by the ranges between splitters; shards are runs of ranges, and slots follow
from the counts of the ranges before.

A splitter takes the border of a group of equal texts where one is within tolerance.

Law: sizes of shards (bytes of text plus 1) differ from the mean by no more than the tolerance,
or than one row where a row is larger. A group of equal texts lies in one shard unless it is
above tolerance and stands where a border must be: then ``group_cut`` is true for its rows, of
which two neighbouring shards have parts. Defined results: null and empty texts have size 1, and
long texts that of all their bytes; rows equal in id and text, among them those with null ids,
have one key and stay together in one task; an empty table has no rows; columns of df with an
output's name are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import settled

LEAST, MOST = -(1 << 63), 1 << 63
#: Candidate keys counted a round.
PROBES = 2048

Key = tuple[int, int]


class Cuts:
    """Sorted keys, to which rows are assigned."""

    def __init__(self, keys: list[Key]) -> None:
        self.keys = len(keys)
        self.first = np.array([k[0] for k in keys], np.int64)
        inner: dict[int, list[int]] = {}
        for a, b in keys:
            inner.setdefault(a, []).append(b)
        self.inner = {a: np.array(own, np.int64) for a, own in inner.items() if own[-1] > LEAST}

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each row key (a, b): how many of the keys are at or below it."""
        out = np.searchsorted(self.first, a, "right")
        for value, own in self.inner.items():
            rows = np.flatnonzero(a == value)
            if len(rows):
                out[rows] = int(np.searchsorted(self.first, value, "left")) + np.searchsorted(own, b[rows], "right")
        return out


def below(keyed: DataFrame, probes: list[Key]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows below each probe, and in all (last)."""
    shared = keyed.sparkSession.sparkContext.broadcast(Cuts(probes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, shared.value.keys + 1), np.int64)
        for batch in batches:
            a, b, size = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = shared.value.places(a, b)
            np.add.at(total[0], at, size)
            total[1] += np.bincount(at, minlength=total.shape[1])
        has = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[0][has]), pa.array(total[1][has])], names=["at", "bytes", "rows"])

    parts = keyed.mapInArrow(count, "at long, bytes long, rows long")
    out = np.zeros((2, len(probes) + 1), np.int64)
    for r in parts.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():
        out[0, r["at"]], out[1, r["at"]] = r["bytes"], r["rows"]
    return np.cumsum(out[0]), np.cumsum(out[1])


def spaced(lo: int, hi: int, n: int) -> list[int]:
    """Up to n whole numbers between lo and hi, both excluded."""
    n = min(n, hi - lo - 1)
    return [lo + (hi - lo) * (k + 1) // (n + 1) for k in range(n)]


def splitters(keyed: DataFrame, total: int, parts: int, shards: int, tolerance: float) -> tuple[list[Key], int]:
    """The parts-1 keys that cut the total bytes evenly, and the number of rounds. Every
    (parts/shards)-th one bounds a shard and meets the tolerance; the others, which just keep
    tasks even, a quarter of a part."""
    step = parts // shards
    open_: dict[int, list] = {}  # target: interval of keys, bytes below its ends
    done: dict[int, Key] = {}
    for j in range(1, parts):
        open_[j] = [(LEAST, LEAST), (MOST, LEAST), 0, total]
    rounds = 0
    while open_:
        rounds += 1
        each = max(2, PROBES // len(open_))
        asked: set[Key] = set()
        for lo, hi, _, _ in {(x[0], x[1]): x for x in open_.values()}.values():
            if hi[0] - lo[0] > 1 and hi[1] == LEAST and lo[1] == LEAST:
                asked.update((k, LEAST) for k in spaced(lo[0], hi[0], PROBES if rounds == 1 else each))
            else:  # one text hash is left: go on by the second part
                top = hi[1] if hi[0] == lo[0] else MOST
                asked.update((lo[0], k) for k in spaced(lo[1], top, each))
        probes = sorted(asked)
        if not probes:
            for j, (lo, hi, at_lo, at_hi) in open_.items():
                want = total * j / parts
                done[j] = lo if want - at_lo <= at_hi - want or hi[0] >= MOST else hi
            break
        sizes, _ = below(keyed, probes)
        for j in list(open_):
            lo, hi, at_lo, at_hi = open_[j]
            want = total * j / parts
            allowed = tolerance * total / shards if j % step == 0 else 0.25 * total / parts
            left, right = bisect_right(probes, lo), bisect_left(probes, hi)  # the probes inside
            if left < right:
                k = int(np.searchsorted(sizes[left:right], want, "right")) + left
                if k > left:
                    lo, at_lo = probes[k - 1], int(sizes[k - 1])
                if k < right:
                    hi, at_hi = probes[k], int(sizes[k])
                open_[j] = [lo, hi, at_lo, at_hi]
            near = min(((abs(want - at_lo), lo), (abs(at_hi - want), hi)), key=lambda x: x[0])
            single = hi[0] == lo[0] and hi[1] - lo[1] <= 1
            if (near[0] <= allowed or single) and LEAST < near[1][0] < MOST:
                done[j] = near[1]
                del open_[j]
            elif single or left >= right and (hi[0] - lo[0] <= 1 and lo[1] > LEAST):
                done[j] = lo
                del open_[j]
    return [done[j] for j in sorted(done)], rounds


def shard_documents(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", tolerance: float = 0.001) -> DataFrame:
    """df with size, shard (0 to shards-1), slot (gapless from 0 in each shard, in key order),
    and group_cut (the row's text stands in more than one shard). Only keys and sizes are kept for counting; whole rows move in the one exchange."""
    spark = df.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"size": F.octet_length(value).cast("long") + 1, "__quire_a": F.xxhash64(value), "__quire_b": F.xxhash64(F.lit(1), F.col(key))})
    keyed = settled(df.select("__quire_a", "__quire_b", "size"))
    total = keyed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = shards * max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    cuts, _ = splitters(keyed, total, parts, shards, tolerance) if total else ([], 0)
    cuts = sorted(cuts)
    step = parts // shards
    borders = [cuts[k - 1] for k in range(step, len(cuts) + 1, step)]
    # Each range's first row, and of texts at borders the rows before, of and after them.
    inside = [a for a, b in borders if b > LEAST]
    probes = sorted({*cuts, *((a, LEAST) for a in inside), *((a + 1, LEAST) for a in inside if a + 1 < MOST)})
    _, counted = below(keyed, probes) if probes else (None, np.zeros(1, np.int64))
    rows = dict(zip(probes, counted.tolist()))
    end = int(counted[-1])
    split = sorted({a for a, b in borders if b > LEAST and rows[a, LEAST] < rows[a, b] < rows.get((a + 1, LEAST), end)})
    start = [0, *(rows[c] for c in cuts)]
    base = [start[k] - start[k - k % step] if k < len(start) else 0 for k in range(parts)]
    shared = spark.sparkContext.broadcast(Cuts(cuts))

    @F.arrow_udf("int")
    def part(a: pa.Array, b: pa.Array) -> pa.Array:
        at = shared.value.places(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False))
        return pa.array(at.astype(np.int32))

    offsets = spark.createDataFrame([(k, b) for k, b in enumerate(base)], "__quire_part int, __quire_base long")
    # A row a range: as many as the session has shuffle partitions, times four.
    placed = df.withColumn("__quire_part", part("__quire_a", "__quire_b")).join(F.broadcast(offsets), "__quire_part")
    order = Window.partitionBy("__quire_part").orderBy("__quire_a", "__quire_b", key)
    placed = placed.withColumn("slot", F.col("__quire_base") + F.row_number().over(order) - 1)
    placed = placed.withColumn("group_cut", F.col("__quire_a").isin(split))  # at most one a shard
    return placed.withColumn("shard", F.floor(F.col("__quire_part") / step).cast("int")).drop("__quire_a", "__quire_b", "__quire_part", "__quire_base")
