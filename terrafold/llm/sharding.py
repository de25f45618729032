"""Operator 10: contiguous shards with the smallest possible largest one.

Groups that may not be cut (here: the rows of a document) stand in order of their key. The smallest shard capacity
with which at most `shards` shards suffice is found by binary search; a capacity is checked greedily: each shard takes
groups while they fit. The running sums over the whole table are computed in range partitions with offsets.

The driver knows some of the sums only, and of each gap between two of them whether others hide in it. With the sums
known, a capacity suffices for sure, or fails for sure, or it is open; in the gaps where open ones would cut, the least and
greatest sums of `FINER` equal parts are fetched, until the capacity and its cuts are settled. So the driver holds
at most some `FINER` sums more for each round, however many groups there are and whatever the largest.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.base import cut

SHARDS = 64
FINER = 1 << 14


class Sums:
    """Sums known, in order, the first 0 and the last the total; hidden[i]: others may lie between known[i] and known[i + 1]."""

    def __init__(self, total: int):
        self.known, self.hidden = np.array([0, total], np.int64), np.array([True])

    def gap(self, x: int) -> int:
        """The gap that x is in, a known sum being in the one that it begins."""
        return min(int(np.searchsorted(self.known, x, "right")) - 1, len(self.hidden) - 1)

    def below(self, x: int) -> int:
        return int(self.known[int(np.searchsorted(self.known, x, "right")) - 1])

    def above(self, x: int) -> int:
        """At least the greatest sum up to x."""
        i = int(np.searchsorted(self.known, x, "right")) - 1
        return x if i < len(self.hidden) and self.hidden[i] else int(self.known[i])

    def cuts(self, capacity: int, shards: int, at_most: bool) -> list[int] | None:
        """Where the greedy check would cut at the earliest, or at most, or None if that doesn't reach the end."""
        cuts, at, total = [], 0, int(self.known[-1])
        while at < total:
            to = (self.above if at_most else self.below)(at + capacity)
            if len(cuts) == shards or to <= at:
                return None
            at = min(to, total)
            cuts.append(at)
        return cuts

    def open_gaps(self, low: int, high: int, shards: int) -> np.ndarray:
        """Gaps with hidden sums in which capacities from low to high may cut."""
        wanted, early, late, total = np.zeros(len(self.hidden), bool), 0, 0, int(self.known[-1])
        for _ in range(shards):
            a, z = self.gap(early + low), self.gap(min(late + high, total))
            wanted[a : z + 1] = True
            early, late = self.below(early + low), min(self.above(late + high), total)
            if early >= total:
                break
        return np.flatnonzero(wanted & self.hidden)

    def learn(self, lows: np.ndarray, highs: np.ndarray, gaps: np.ndarray) -> None:
        """Adds least and greatest sums of parts of the gaps, which are then known but between the two."""
        self.hidden[gaps] = False
        known = np.unique(np.concatenate([self.known, lows, highs]))
        hidden = np.zeros(len(known) - 1, bool)
        hidden[np.searchsorted(known, self.known[:-1][self.hidden])] = True
        hidden[np.searchsorted(known, lows[lows < highs])] = True
        self.known, self.hidden = known, hidden


def smallest(low: int, high: int, total: int, shards: int, finer) -> tuple[int, list[int]]:
    """The smallest capacity from low to high, the last of which suffices, and its cuts; finer(first, end, parts) gives least and greatest sums."""
    sums = Sums(total)
    while True:
        a, z = low, high
        while a < z:  # the smallest that may suffice
            mid = (a + z) // 2
            a, z = (a, mid) if sums.cuts(mid, shards, True) is not None else (mid + 1, z)
        low, z = a, high
        while a < z:  # the smallest that does for sure
            mid = (a + z) // 2
            a, z = (a, mid) if sums.cuts(mid, shards, False) is not None else (mid + 1, z)
        high = a
        if low == high and (cuts := sums.cuts(low, shards, False)) is not None and cuts == sums.cuts(low, shards, True):
            return low, cuts
        gaps = sums.open_gaps(low, high, shards)
        parts = max(2, FINER // max(len(gaps), 1))
        sums.learn(*finer(sums.known[gaps], sums.known[gaps + 1], parts), gaps)


def _running(batches):
    pid, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        run = before + np.cumsum(sizes)
        before = int(run[-1]) if len(run) else before
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(run), pid, np.int32)), pa.array(run)], ["key", "size", "pid", "run"])


def _extremes(batches, first: np.ndarray, end: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Least and greatest sum of each part of the gaps, which are cut into equal ones."""
    width = np.maximum(-(-(end - first) // parts), 1)
    for batch in batches:
        p = batch.column(0).to_numpy()
        g = np.searchsorted(first, p) - 1
        inside = g >= 0
        inside[inside] = p[inside] < end[g[inside]]
        p, g = p[inside], g[inside]
        part = g * parts + (p - first[g] - 1) // width[g]
        order = np.lexsort((p, part))
        p, part = p[order], part[order]
        new = np.append(True, part[1:] != part[:-1])[: len(part)]
        yield pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(p[new]), pa.array(p[np.append(new[1:], True)[: len(part)]])], ["part", "low", "high"])


def shard(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(key, size, shard) for groups (key bigint, size bigint), keys in ascending order, null first.

    The largest shard is as small as any contiguous partition into at most `shards` allows; shards count from 0.
    Rows of one key are one group, with the sum of their sizes; a null or negative size counts as 0. Groups of no size stand with
    what precedes them; if there's nothing else, all are in shard 0. A group larger than all others sets the capacity.
    Further columns are left out. An empty table gives no rows.
    """
    spark = groups.sparkSession
    own = groups.groupBy(F.col("key").cast("bigint").alias("key")).agg(F.sum(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0))).cast("bigint").alias("size"))
    ranged = own.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())
    run = cut(ranged.mapInArrow(_running, "key bigint, size bigint, pid int, run bigint"))
    parts = sorted((r["pid"], r["s"], r["m"]) for r in run.groupBy("pid").agg(F.sum("size").alias("s"), F.max("size").alias("m")).collect())
    total, largest = sum(p[1] for p in parts), max((p[2] for p in parts), default=0)
    before, offsets = 0, []
    for pid, s, _ in parts:
        offsets.append((pid, before))
        before += s
    sums = run.join(F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "pid int, before bigint")), "pid").select("key", "size", (F.col("run") + F.col("before")).alias("prefix"))
    cuts: list[int] = []
    if total:
        even = -(-total // shards)

        def finer(first: np.ndarray, end: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
            found = sums.select("prefix").mapInArrow(lambda it: _extremes(it, first, end, parts), "part bigint, low bigint, high bigint").groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
            return found.column("low").to_numpy(), found.column("high").to_numpy()

        cuts = smallest(max(largest, even), even + largest, total, shards, finer)[1]
    before = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[:-1]]), lambda c: c < F.col("prefix"))) if len(cuts) > 1 else F.lit(0)
    return sums.select("key", "size", before.alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, n_bytes, shard): documents in order of doc_id, with the bytes of their texts as sizes; a null text has 0."""
    out = shard(docs.select(F.col("doc_id").alias("key"), F.octet_length("text").cast("bigint").alias("size")), shards)
    return out.select(F.col("key").alias("doc_id"), F.col("size").alias("n_bytes"), "shard")


ORACLE = f"""
WITH RECURSIVE g AS (SELECT doc_id, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS size FROM documents GROUP BY doc_id),
p AS (SELECT doc_id, size, (sum(size) OVER (ORDER BY doc_id NULLS FIRST))::BIGINT AS prefix FROM g),
t AS (SELECT max(size)::BIGINT AS largest, sum(size)::BIGINT AS total FROM g),
s(lo, hi, reached, n) AS (
  SELECT greatest(largest, -(-total // {SHARDS})), -(-total // {SHARDS}) + largest, 0::BIGINT, 0::BIGINT FROM t
  UNION ALL
  SELECT CASE WHEN next < total AND n + 1 >= {SHARDS} THEN mid + 1 ELSE lo END, CASE WHEN next >= total THEN mid ELSE hi END,
         CASE WHEN next >= total OR n + 1 >= {SHARDS} THEN 0 ELSE next END, CASE WHEN next >= total OR n + 1 >= {SHARDS} THEN 0 ELSE n + 1 END
  FROM (SELECT lo, hi, n, (lo + hi) // 2 AS mid, max(prefix) AS next, max(total) AS total FROM s, t, p WHERE lo < hi AND prefix <= reached + (lo + hi) // 2 GROUP BY lo, hi, reached, n)),
c AS (SELECT min(lo) AS capacity FROM s WHERE lo = hi),
cuts(k, reached) AS (
  SELECT 0::BIGINT, 0::BIGINT UNION ALL SELECT k + 1, next FROM (SELECT k, reached, max(prefix) AS next, max(total) AS total FROM cuts, c, t, p WHERE reached < total AND prefix <= reached + capacity GROUP BY k, reached))
SELECT doc_id, size AS n_bytes, (SELECT count(*) FROM cuts WHERE cuts.k > 0 AND cuts.reached < p.prefix AND cuts.reached < (SELECT total FROM t))::INTEGER AS shard FROM p
"""
