"""Most similar vectors for every vector (problem 2): a forest of hash-prefix trees.

Every tree hashes a vector to a long string of bits, the signs of its projections on a random rotation
of the centred space, and keeps the vectors as an array sorted by these strings; the vectors below a node
of the tree are those with the node's prefix, a range of the array. A search descends in every tree to the
longest prefix, then ascends in all trees by one bit at a time until the nodes it has reached hold enough
candidates together. How many a node holds is told by the counts of a fixed number of cells of each array,
so the ascent's end is known before anything is moved. The candidates are scored where they lie, and the
trees' best are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM = 64
K = 10
TREES = 7
#: An ascent ends where the nodes hold this many times the square root of the collection.
CANDIDATES = 40.0
#: The longest prefix that an ascent begins at.
DEEPEST = 48
#: Queries, and scores, that are worked on at a time.
BLOCK = 512
SCORES = 1 << 23
#: Cells of each array, and places that a part of it holds, at most.
CELLS = 2048
PART = 1 << 17
#: Vectors read to find the centre and the cells; the bound keeps the fit the same at every size of the collection.
CENTRE_SAMPLE = 10_000
SEED = 20_240_601
_SCALE = 2047.0  # 12 bits a component
#: What rounding to 12 bits can change a cosine by, at most: half a step for each component of both vectors.
ROUNDING = 2 * DIM**0.5 / (2 * _SCALE)


def pack(v: np.ndarray) -> np.ndarray:
    """Unit vectors to 12 bits a component, 96 bytes for 64 components; errors of a cosine are about 1e-4, and below ``ROUNDING``."""
    q = np.rint(np.clip(v, -1, 1) * _SCALE).astype(np.int16) + 2048
    a, b = q[:, 0::2].astype(np.uint16), q[:, 1::2].astype(np.uint16)
    out = np.empty((len(v), DIM // 2 * 3), np.uint8)
    out[:, 0::3], out[:, 1::3], out[:, 2::3] = a >> 4, ((a & 15) << 4) | (b >> 8), b & 255
    return out


def unpack(p: np.ndarray) -> np.ndarray:
    x, y, z = (p[:, k::3].astype(np.int16) for k in range(3))
    v = np.empty((len(p), DIM), np.float32)
    v[:, 0::2], v[:, 1::2] = (x << 4) | (y >> 4), ((y & 15) << 8) | z
    v -= 2048
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the vectors of ``DIM`` finite numbers, not all zero, and these as unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == DIM)
    if not len(at):
        return at, np.empty((0, DIM), np.float32)
    values = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, DIM)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(values, axis=1)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1) & np.isfinite(norm) & (norm > 0)
    return at[good], (values[good] / norm[good, None]).astype(np.float32)


def rotations(trees: int = TREES) -> np.ndarray:
    out = []
    for t in range(trees):
        q, _ = np.linalg.qr(np.random.default_rng(SEED + t).normal(size=(DIM, DIM)))
        out.append(q)
    return np.stack(out).astype(np.float32)


def _packed(fields: list[str]):
    """``id, version..., field bytes`` of the rows, so that rows with two vectors travel once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(k) for k in range(3)]
            for k in range(len(fields)):
                at, v = usable(b.column(3 + k))
                data: list[bytes | None] = [None] * b.num_rows
                for i, x in zip(at, pack(v)):
                    data[i] = x.tobytes()
                cols.append(pa.array(data, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["element_id", "row_id", "indexed_at", *fields])

    return run


def packed_vectors(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``element_id, row_id, indexed_at`` and the packed vectors of each field, null where not usable."""
    schema = rows.select("element_id", "row_id", "indexed_at").schema.simpleString()[7:-1].replace(":", " ")
    return rows.select("element_id", "row_id", "indexed_at", *fields).mapInArrow(_packed(fields), schema + "".join(f", {f} binary" for f in fields))


def codes(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The signs of the projections, first bit highest."""
    return ((x @ turn > 0) * (np.uint64(1) << np.arange(DIM - 1, -1, -1, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def keys(code: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """What an array is sorted by: the bit string, then the vector's bytes, so that copies stand together."""
    both = np.concatenate([code.astype(">u8").view(np.uint8).reshape(-1, 8), raw], axis=1)
    return np.ascontiguousarray(both).view(f"S{both.shape[1]}").ravel()


class Forest(NamedTuple):
    """What tasks know of the trees: each one's array is cut into cells at ``bounds``."""

    centres: np.ndarray
    bounds: list[np.ndarray]


class Plan(NamedTuple):
    """Of each cell: its part; of each tree: its first part, the cells' bounds as codes, and the places before these."""

    part: np.ndarray
    codes: list[np.ndarray]
    places: list[np.ndarray]
    n_parts: int


_DEPTHS = np.arange(65)
#: The bits of a prefix of each length.
PREFIX = np.array([0] + [(~0 << (64 - int(d))) & (2**64 - 1) for d in _DEPTHS[1:]], np.uint64)


def fit(vectors: DataFrame, n_fields: int, trees: int, sample: int = CENTRE_SAMPLE) -> Forest:
    """From about ``sample`` vectors of each field: its mean and the cells' bounds. Both only balance the trees and the work."""
    n = {r["field"]: r["count"] for r in vectors.groupBy("field").count().collect()}
    centres, bounds = np.zeros((n_fields, DIM), np.float32), []
    for f in range(n_fields):
        some = F.pmod(F.xxhash64("id"), F.lit(-(-n.get(f, 1) // sample))) == 0
        rows = vectors.where((F.col("field") == f) & some).select("id", "vec").toPandas().sort_values("id")["vec"]
        raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), DIM // 2 * 3)
        x = unpack(raw)
        if len(x):
            centres[f] = x.mean(axis=0)
        for turn in rotations(trees):
            k = np.unique(keys(codes(x - centres[f], turn), raw))
            bounds.append(k[np.unique(np.linspace(0, len(k), CELLS, endpoint=False).astype(int))[1:]] if len(k) else k)
    return Forest(centres, bounds)


def _in_cells(b: pa.RecordBatch, forest: Forest, trees: int):
    """For each field: its rows of the batch, and for each of its trees, these rows' cells and codes."""
    turn = rotations(trees)
    field = b.column(0).to_numpy()
    raw = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
    x = unpack(raw) - forest.centres[field]
    for f in np.unique(field).tolist():
        rows = np.flatnonzero(field == f)
        code = [codes(x[rows], turn[t]) for t in range(trees)]
        cell = [(f * trees + t) * CELLS + np.searchsorted(forest.bounds[f * trees + t], keys(code[t], raw[rows]), side="right") for t in range(trees)]
        yield f, rows, cell, code


def _counted(trees: int, forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(forest.bounds) * CELLS, np.int64)
        for b in batches:
            if b.num_rows:
                for _, _, cells, _ in _in_cells(b, forest, trees):
                    for cell in cells:
                        n += np.bincount(cell, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "n"])

    return run


def planned(counts: np.ndarray, bounds: list[np.ndarray], parts: int) -> Plan:
    """Cuts every tree at cells into parts of about the same number of places, at least ``parts`` in all."""
    n_trees = len(bounds)
    part, n_parts = np.zeros(n_trees * CELLS, np.int64), 0
    code, places = [], []
    for t in range(n_trees):
        here = slice(t * CELLS, (t + 1) * CELLS)
        hi = np.cumsum(counts[here])
        lo, total = hi - counts[here], int(hi[-1])
        first = np.array([int.from_bytes(bytes(x).ljust(8, b"\0")[:8], "big") for x in bounds[t]], np.uint64)
        code.append(first)
        places.append(np.concatenate([[0.0], hi[: len(first)].astype(np.float64), [float(total)]]))
        if not total:
            continue
        m = max(1, -(-parts // n_trees), -(-total // PART))
        own = np.minimum(lo * m // total, m - 1)
        _, own = np.unique(own, return_inverse=True)
        part[here] = own + n_parts
        n_parts += int(own.max()) + 1
    return Plan(part, code, places, n_parts)


def _held(plan: Plan, tree: int, code: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """About how many vectors have the first ``depth`` bits of ``code``: exact at the cells' bounds, linear between."""
    x = np.concatenate([[0.0], plan.codes[tree].astype(np.float64), [2.0**64]])
    low = code & PREFIX[depth]
    high = low | ~PREFIX[depth]
    y = plan.places[tree]
    return np.interp(high.astype(np.float64) + 4096.0, x, y) - np.interp(low.astype(np.float64) - 4096.0, x, y)


def ascent(plan: Plan, first_tree: int, code: list[np.ndarray], wanted: float) -> np.ndarray:
    """For each query the longest prefix length at which its nodes of all trees hold ``wanted`` vectors together, else 0."""
    n = len(code[0])
    low, high = np.zeros(n, np.int64), np.full(n, DEEPEST + 1)
    while (high - low > 1).any():
        mid = (low + high) // 2
        enough = sum(_held(plan, first_tree + t, c, mid) for t, c in enumerate(code)) >= wanted
        low, high = np.where(enough, mid, low), np.where(enough, high, mid)
    return low


def _placed(trees: int, forest: Forest, plan: Plan, candidates: Callable[[int], float]):
    """Every vector to the part that holds its place, and as a query to all other parts that its node reaches into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ask = b.column(3).to_numpy(zero_copy_only=False)
            for f, rows, cells, code in _in_cells(b, forest, trees):
                wanted = candidates(int(plan.places[f * trees][-1]))
                depth = ascent(plan, f * trees, code, wanted)
                for t in range(trees):
                    tree, own = f * trees + t, plan.part[cells[t]]
                    low = code[t] & PREFIX[depth]
                    first = plan.part[tree * CELLS + np.searchsorted(plan.codes[tree], low, side="left")]
                    last = plan.part[tree * CELLS + np.searchsorted(plan.codes[tree], low | ~PREFIX[depth], side="right")]
                    n = np.where(ask[rows], last - first + 1, 0)
                    at = np.repeat(np.arange(len(rows)), n)
                    to = np.repeat(first, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    away = to != own[at]
                    at, to = np.concatenate([np.arange(len(rows)), at[away]]), np.concatenate([own, to[away]])
                    guest = np.arange(len(at)) >= len(rows)
                    signed = (code[t][at] ^ (np.uint64(1) << np.uint64(63))).view(np.int64)  # signed order is that of the bit strings
                    take = pa.array(rows[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to, pa.int32()), pa.array(guest), pa.array(depth[at], pa.int8()), pa.array(signed), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(np.full(len(at), f), pa.int8())],
                        names=["part", "guest", "depth", "code", "id", "vec", "ask", "field"],
                    )

    return run


def _searched(k: int, least: float):
    """Scores the queries of each part against the part's vectors below their nodes, node by node."""

    def search(guest: np.ndarray, depth: np.ndarray, code: np.ndarray, ids: np.ndarray, raw: np.ndarray, ask: np.ndarray, field: np.ndarray):
        same = np.zeros(len(ids), bool)
        same[1:] = (raw[1:] == raw[:-1]).all(axis=1) & (guest[1:] == guest[:-1]) & (code[1:] == code[:-1])
        heads = np.flatnonzero(~same)  # copies stand together; one of each takes part
        sizes = np.diff(np.append(heads, len(ids)))
        n = int((~guest[heads]).sum())  # guests come last
        v = unpack(raw[heads[:n]])
        bits = code.view(np.uint64) ^ (np.uint64(1) << np.uint64(63))
        at_bits = bits[heads[:n]]
        a, b, s = [], [], []
        for h in np.flatnonzero(sizes[:n] > 1):  # each copy with the first k others of its run
            members = ids[heads[h] : heads[h] + sizes[h]]
            x, y = np.nonzero(~np.eye(len(members), dtype=bool))
            a.append(members[x])
            b.append(members[y])
            s.append(np.ones(len(x), np.float32))
        asked = np.flatnonzero(np.logical_or.reduceat(ask, heads))
        node = np.stack([guest[heads[asked]].astype(np.uint64), depth[heads[asked]].astype(np.uint64), bits[heads[asked]] & PREFIX[depth[heads[asked]]]])
        order = np.lexsort((node[2], node[1], node[0]))
        asked, node = asked[order], node[:, order]
        cuts = np.flatnonzero(np.append(True, (node[:, 1:] != node[:, :-1]).any(axis=0))).tolist() if len(asked) else []
        for p, q in zip(cuts, [*cuts[1:], len(asked)]):
            home, top = not node[0, p], node[2, p] | ~PREFIX[int(node[1, p])]
            c, d = int(np.searchsorted(at_bits, node[2, p], side="left")), int(np.searchsorted(at_bits, top, side="right"))
            if d <= c:
                continue
            step = max(1, min(BLOCK, SCORES // (d - c)))
            for r in range(p, q, step):
                rows = asked[r : min(r + step, q)]
                sims = (v[rows] if home else unpack(raw[heads[rows]])) @ v[c:d].T
                if home:
                    sims[np.arange(len(rows)), rows - c] = -2.0
                if least <= 0:
                    kk = min(k, d - c - home)
                    if kk <= 0:
                        continue
                    best = np.argpartition(-sims, kk - 1, axis=1)[:, :kk]
                    i, j = np.repeat(np.arange(len(rows)), kk), best.ravel()
                else:
                    i, j = np.divmod(np.flatnonzero(sims >= np.float32(least - ROUNDING)), d - c)
                if not len(i):
                    continue
                score = sims[i, j]
                order = np.lexsort((-score, i))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, score = rows[i[place < k]], c + j[place < k], score[place < k]
                few = sizes[i] <= k  # the copies of a longer run are their k most similar
                i, j, score = i[few], j[few], score[few]
                many = sizes[i] * np.minimum(sizes[j], k)
                x = np.repeat(np.arange(len(i)), many)
                nth = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
                width = np.minimum(sizes[j], k)[x]
                a.append(ids[heads[i[x]] + nth // width])
                b.append(ids[heads[j[x]] + nth % width])
                s.append(score[x])
                if sum(map(len, a[-64:])) > 100_000 or len(a) > 4096:
                    yield a, b, s, int(field[0])
                    a, b, s = [], [], []
        if a:
            yield a, b, s, int(field[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            if not held:
                return
            whole = [np.concatenate(x) for x in zip(*held)][1:]
            held.clear()
            for a, b, s, f in search(*whole):
                ours, theirs, score = np.concatenate(a), np.concatenate(b), np.concatenate(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ours), f), pa.int32()), pa.array(ours), pa.array(theirs), pa.array(score, pa.float32())], names=["field", "a", "b", "sim"])

        for b in batches:
            if not b.num_rows:
                continue
            part, guest, depth, code, ids, ask, field = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4, 6, 7))
            raw = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bounds = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(part)]
            for lo, hi in zip(bounds, bounds[1:]):
                if held and held[-1][0][0] != part[lo]:
                    yield from flush()
                held.append(tuple(x[lo:hi] for x in (part, guest, depth, code, ids, raw, ask, field)))
        yield from flush()

    return run


def _in_long_runs(vectors: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """Of vectors with more than ``k`` copies, of which ``kept`` has the first ``k + 1``: every copy with the first ``k`` others."""
    long_ = kept.where(F.col("copy") == k + 1).select("field", "vec")
    first = kept.where(F.col("copy") <= k).join(long_, ["field", "vec"]).select("field", "vec", F.col("id").alias("b"))
    return vectors.join(first, ["field", "vec"]).where(F.col("id") != F.col("b")).select("field", F.col("id").alias("a"), "b", F.lit(1.0).cast("float").alias("sim"))


def enough(n: int) -> float:
    """Candidates at which an ascent in a collection of ``n`` vectors ends."""
    return CANDIDATES * n**0.5


def nearest(rows: DataFrame, fields: list[str], k: int = K, least: float = 0.0, trees: int = TREES, candidates: Callable[[int], float] = enough, ask=None) -> DataFrame:
    """``field, a, b, sim, place``: for every vector ``a`` of a field its ``k`` most similar ``b``.

    ``rows``: ``element_id, row_id, indexed_at`` and array columns ``fields``; of rows with one
    element_id the latest counts, and ids here are ``row_id``. With ``least`` only pairs of at least that
    cosine, less what rounding may hide, are searched for. ``ask`` (from a column to a condition on a row_id)
    restricts the queries, never the collection. Vectors that are null, of another length, not finite or zero
    take no part. Of equal vectors each finds the first ``k`` others of its run. Rows without
    row_id are left out; an empty table gives no rows.

    ``candidates``: from the number of vectors of a field, how many must stand below the nodes of all trees
    together where an ascent ends; an ascent that doesn't find as many ends at the roots. With infinitely many, and
    one tree, the search is exact. Nodes are ranges of whole arrays, and a query goes to every part that its node
    reaches into, so the number of partitions changes no result.
    """
    from ferrule.session import cut
    from ferrule.sources.tables import latest_per_key

    spark = rows.sparkSession
    rows = rows.where(F.col("row_id").isNotNull())
    now = latest_per_key(packed_vectors(rows, fields), ["element_id"], ["indexed_at", "row_id"])
    vectors = now.select(F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col("row_id").alias("id"), F.col(f).alias("vec")) for i, f in enumerate(fields)])).alias("x")).select("x.*").where(F.col("vec").isNotNull())
    copies = vectors.withColumn("copy", F.row_number().over(Window.partitionBy("field", "vec").orderBy("id")))
    kept = cut(copies.where(F.col("copy") <= k + 1))
    one = kept.where(F.col("copy") == 1).select("field", "id", "vec")
    forest = fit(one, len(fields), trees)
    found = one.mapInArrow(_counted(trees, forest), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows a tree
    counts = np.zeros(len(forest.bounds) * CELLS, np.int64)
    counts[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    plan = planned(counts, forest.bounds, n)
    wanted = (ask(F.col("id")) if ask else F.lit(True)).alias("ask")
    placed = kept.select("field", "id", "vec", wanted).mapInArrow(_placed(trees, forest, plan, candidates), "part int, guest boolean, depth byte, code long, id long, vec binary, ask boolean, field byte")
    parts = placed.repartitionById(max(1, plan.n_parts), F.col("part")).sortWithinPartitions("part", "guest", "code", "vec", "id")
    pairs = parts.mapInArrow(_searched(k, least), "field int, a long, b long, sim float")
    if not kept.where(F.col("copy") > k).isEmpty():
        pairs = pairs.unionByName(_in_long_runs(vectors, kept, k))
    if ask:
        pairs = pairs.where(ask(F.col("a")))
    best = pairs.groupBy("field", "a", "b").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("field", "a").orderBy(F.col("sim").desc(), "b")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: Pairs in doubt whose ids, 16 bytes a pair, may be broadcast.
FEW_PAIRS = 100_000


def _dot(x: F.Column, y: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, p: t + p)


def settled(near: DataFrame, rows: DataFrame, fields: list[str], least: float) -> DataFrame:
    """``field, a, b`` of the rows of :func:`nearest` whose cosine is at least ``least`` by the vectors themselves.

    Only pairs so close to ``least`` that rounding leaves them in doubt are computed again.
    """
    from ferrule.session import cut

    near = cut(near.select("field", "a", "b", "sim"))
    sure = near.where(F.col("sim") >= least + ROUNDING).select("field", "a", "b")
    doubt = near.where((F.col("sim") >= least - ROUNDING) & (F.col("sim") < least + ROUNDING)).select("field", "a", "b")
    ids = doubt.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    ids = F.broadcast(ids) if doubt.count() <= FEW_PAIRS else ids.hint("merge")
    vectors = rows.select("row_id", F.array(*fields).alias("v")).join(ids, "row_id", "left_semi")

    def side(c: str) -> DataFrame:
        return vectors.select(F.col("row_id").alias(c), F.col("v").alias("v" + c)).hint("merge")

    both = doubt.join(side("a"), "a").join(side("b"), "b")
    x, y = (F.element_at(c, F.col("field") + 1) for c in ("va", "vb"))
    again = both.where(_dot(x, y) >= least * F.sqrt(_dot(x, x)) * F.sqrt(_dot(y, y)))
    return sure.unionByName(again.select("field", "a", "b"))
