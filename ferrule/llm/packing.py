"""Filling containers of fixed capacity with whole texts (problem 8).

Sizes are whole numbers up to the capacity, so all that packing needs is how many texts there are of
each size: a histogram of at most ``capacity`` numbers, however many texts. The histogram is reduced by
Martello and Toth's dominance criteria, the rest is filled best fit, and the plan, runs of equal
containers, is then dealt out to the texts by their rank within their size.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
TOKENIZERS = os.environ.get("FERRULE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary parts texts before merging bytes (a fixed value of the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class Run(NamedTuple):
    """``n`` texts of ``size``, in order of rank from ``rank``, ``each`` to a container from ``container`` on."""

    size: int
    rank: int
    n: int
    each: int
    container: int


class _Plan:
    def __init__(self, counts: dict[int, int]) -> None:
        self.left = dict(counts)
        self.sizes = sorted(counts)
        self.rank = dict.fromkeys(counts, 0)
        self.runs: list[Run] = []
        self.containers = 0

    def take(self, size: int, n: int, each: int, container: int) -> None:
        self.runs.append(Run(size, self.rank[size], n, each, container))
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def fix(self, members: list[int], times: int) -> None:
        """``times`` containers that hold ``members`` each."""
        for size in sorted(set(members)):
            k = members.count(size)
            self.take(size, times * k, k, self.containers)
        self.containers += times

    def fits(self, room: int, without: dict[int, int]) -> int | None:
        """The largest size up to ``room`` of which a text is left besides ``without``."""
        i = bisect.bisect_right(self.sizes, room)
        while i:
            i -= 1
            if self.left[self.sizes[i]] > without.get(self.sizes[i], 0):
                return self.sizes[i]
        return None

    def smallest(self, n: int, without: dict[int, int]) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), max(0, self.left[s] - without.get(s, 0)))
            if len(out) >= n:
                break
        return out


def _times(plan: _Plan, members: list[int]) -> int:
    return min(plan.left[s] // members.count(s) for s in set(members))


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs and number of containers for ``counts`` texts of each size (1 to ``capacity``).

    Reduction, from the largest text on: if nothing fits beside it, it stands alone; a text that fills
    the container exactly dominates all other partners, and so does the largest that fits where no two
    others would fit; where at most two others fit, a pair that fills it exactly, or the largest single
    partner if it is at least as large as the best pair, dominates. Equal containers are fixed at once.
    What no criterion fixes is filled best fit in falling size.
    """
    p = _Plan({s: n for s, n in counts.items() if n})
    if p.sizes and (p.sizes[0] < 1 or p.sizes[-1] > capacity):
        raise ValueError("sizes must be from 1 to capacity")
    for s in reversed(p.sizes[:]):
        while s in p.left:
            members = _dominant(p, s, capacity)
            if members is None:
                break
            p.fix(members, _times(p, members))
    _best_fit(p, capacity)
    return p.runs, p.containers


def _dominant(p: _Plan, s: int, capacity: int) -> list[int] | None:
    """A set with a text of size ``s`` that dominates all other sets with it, if a criterion tells one."""
    room, without = capacity - s, {s: 1}
    best = p.fits(room, without)
    if best is None:
        return [s]
    two, three = p.smallest(2, without), p.smallest(3, without)
    if best == room or len(two) < 2 or sum(two) > room:
        return [s, best]
    if len(three) < 3 or sum(three) > room:
        pair = _best_pair(p, room, without)
        if pair is None or best >= sum(pair):
            return [s, best]
        if sum(pair) == room:
            return [s, *pair]
    return None


def _best_pair(p: _Plan, room: int, without: dict[int, int]) -> tuple[int, int] | None:
    """The pair of the greatest sum up to ``room``, by two ends of the sorted sizes."""
    sizes = [s for s in p.sizes if p.left[s] > without.get(s, 0)]
    i, j, best = 0, len(sizes) - 1, None
    while i <= j:
        a, b = sizes[i], sizes[j]
        if a + b > room or (i == j and p.left[a] - without.get(a, 0) < 2):
            j -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        i += 1
    return best


def _best_fit(p: _Plan, capacity: int) -> None:
    open_: dict[int, list[tuple[int, int]]] = {}  # free room: runs of containers (first, number)
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((first, n))

    for s in list(reversed(p.sizes)):
        while s in p.left:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(i)
                each = room // s  # equal texts go on filling the same containers
                full = min(n, p.left[s] // each)
                if full:
                    p.take(s, full * each, each, first)
                    add(room - each * s, first, full)
                    add(room, first + full, n - full)
                else:
                    k = p.left[s]
                    p.take(s, k, k, first)
                    add(room - k * s, first, 1)
                    add(room, first + 1, n - 1)
            else:
                each = capacity // s
                full, odd = divmod(p.left[s], each)
                if full:
                    p.take(s, full * each, each, p.containers)
                    add(capacity - each * s, p.containers, full)
                    p.containers += full
                if odd:
                    p.take(s, odd, odd, p.containers)
                    add(capacity - odd * s, p.containers, 1)
                    p.containers += 1


def _tokens(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``doc_id, n_tokens``; null and empty texts have none. The vocabulary file is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    return documents.select("doc_id", "text").mapInArrow(_tokens(os.path.basename(vocabulary)), "doc_id long, n_tokens long")


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, part, n_tokens, container`` for ``doc_id, n_tokens``.

    A text of more than ``capacity`` tokens is cut into full containers of its own and a rest, which is
    packed like a text; all others stay whole. Texts without tokens come out with container null. Rows
    of equal size are ranked by (doc_id, part): they are range partitioned, ranked within a partition,
    and moved on by the counts of the partitions before, so that one size may hold most rows.
    """
    from ferrule.session import cut

    spark = sizes.sparkSession
    sizes = cut(sizes.select("doc_id", "n_tokens"))  # counted once; read by the sampling, the placing and the result
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    known = sizes.where(F.col("n_tokens") > 0)
    last = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    parts = known.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("part")).select(
        "doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("size")
    )
    # the counts below must be those of the very partitions that are ranked, so these are written first
    placed = cut(parts.repartitionByRange(n, "size", "doc_id", "part").sortWithinPartitions("size", "doc_id", "part").select(F.spark_partition_id().alias("pid"), "size", "doc_id", "part"))
    counts = placed.groupBy("pid", "size").agg(F.count("*").alias("n"))
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(histogram, capacity)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("pid", "size", "before")
    own = F.row_number().over(Window.partitionBy("pid", "size").orderBy("doc_id", "part")) - 1
    ranked = placed.join(offsets, ["pid", "size"]).select("doc_id", "part", "size", (own + F.col("before")).alias("rank"))
    table_ = pa.table({k: pa.array([getattr(r, k) for r in runs], pa.int64()) for k in Run._fields})
    slots = spark.createDataFrame(table_.to_pandas(), "size long, rank long, n long, each long, container long")
    by_size = slots.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("rank", "n", "each", "container"))).alias("runs"))
    dealt = ranked.join(F.broadcast(by_size), "size")  # bounded by the capacity, not by the texts
    slot = F.element_at(F.filter("runs", lambda r: (r["rank"] <= F.col("rank")) & (F.col("rank") < r["rank"] + r["n"])), 1)
    out = dealt.withColumn("slot", slot).select(
        "doc_id", "part", F.col("size").cast("long").alias("n_tokens"), (F.col("slot.container") + F.floor((F.col("rank") - F.col("slot.rank")) / F.col("slot.each"))).cast("long").alias("container")
    )
    none = sizes.where(F.coalesce("n_tokens", F.lit(0)) <= 0).select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("container"))
    return out.unionByName(none)
