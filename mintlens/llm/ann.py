"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions and ordered along a Hilbert curve, several times with other
directions and shifts.  Spark range-partitions each ordering; within it a query is compared with the rows of its own
key window and the two beside it, and the windows' results merge.  The merged k-th score then bounds the rest: blocks
of the first ordering whose centre and angular radius leave no better score are skipped, the others are searched in
full.  So results are exact; what the windows find decides how much is left to search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Orderings, directions of each, bits a direction, rows in a key window, rows in a range partition and in a block of it, queries in a block.
CURVES, DIRECTIONS, BITS, WINDOW, RANGE_ROWS, BLOCK_ROWS, QUERY_ROWS = 4, 6, 8, 256, 16_384, 4096, 1024
SEED = 42
#: Products in another order may differ by this much, so what is near the k-th score is computed again term by term.
SLACK = 1e-9

FOUND = "query_id bigint, vec_id bigint, score double"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The index along the Hilbert curve of rows of non-negative integers below 2^bits (after J. Skilling, 2004)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve: its own directions, orthonormal where there are enough, and its own shift."""
    dim = vectors.shape[1]
    rng = np.random.default_rng([SEED, curve, dim])
    axes = np.linalg.qr(rng.standard_normal((dim, min(DIRECTIONS, dim))))[0]
    spread = 3.0 / np.sqrt(dim) if dim > 3 else 1.0
    at = (vectors @ axes / spread + 1) / 2 + rng.uniform(-0.25, 0.25, axes.shape[1])
    return hilbert(np.clip(at / 1.5 + 1 / 6, 0, 1 - 1e-9) * (1 << BITS) // 1, BITS)


def stacked(column: pa.Array) -> np.ndarray:
    """A matrix from a column of double arrays of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def scaled(m: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no cosine and keeps squares of very small or large components finite."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=-1, keepdims=True))[1])


def units(m: np.ndarray) -> np.ndarray:
    m = scaled(m)
    return m / np.linalg.norm(m, axis=1)[:, None]


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, in double precision and the same for equal rows wherever they stand."""
    query, rows = scaled(query), scaled(rows)
    total = lambda x: np.cumsum(x, axis=-1)[..., -1]  # noqa: E731  term after term, as a plain loop adds
    return total(rows * query) / np.sqrt(total(rows * rows) * total(query * query))


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score): of ``rows`` each query's k nearest other than its own row, at ``floor`` or above.

    Equal scores go to the smaller id.  A row that repeats an id counts once.
    """
    out: list[tuple[np.ndarray, ...]] = []
    near = units(queries) @ units(rows).T
    by_id = np.argsort(ids, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])[: len(ids)]
    for n in range(len(queries)):
        s = near[n]
        c = np.flatnonzero((s >= floor[n] - SLACK) & (ids != query_ids[n]))
        if len(c) > k:
            # the k-th score is that of ids, each by its best row
            most = s[c] if len(firsts) == len(ids) else np.maximum.reduceat(np.where(ids == query_ids[n], -3.0, s)[by_id], firsts)
            if len(most) > k:
                c = c[s[c] >= np.partition(most, len(most) - k)[len(most) - k] - SLACK]
        exact = cosines(queries[n], rows[c])
        order = np.lexsort((ids[c], -exact))
        order = order[np.sort(np.unique(ids[c][order], return_index=True)[1])][:k]
        out.append((np.full(len(order), query_ids[n]), ids[c][order], exact[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) and dim of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("bigint").alias("vec_id"), v.alias("v")).where(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with keys, their place on each curve."""
    kind = T._parse_datatype_string("vec_id bigint, v array<double>, dim int, keys array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            keys = np.zeros((b.num_rows, CURVES), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = units(stacked(b.column("v").take(pa.array(at))))
                keys[at] = np.stack([curve_keys(m, c) for c in range(CURVES)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys.tolist(), pa.list_(pa.int64()))], [*b.schema.names, "keys"])

    return rows.mapInArrow(run, kind)


def _windows(k: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come along the curve: a window's queries meet the rows of it and of its neighbours; three windows are held."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def search(own: int) -> Iterator[pa.RecordBatch]:
            ids, m = held[own]
            q = ids % every == 0
            if q.any():
                around = held[max(0, own - 1) : own + 2]
                a, b, s = best(ids[q], m[q], np.concatenate([x for x, _ in around]), np.concatenate([y for _, y in around]), k, np.full(int(q.sum()), -2.0))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

        for ids, m in chunks(batches, WINDOW):
            if held and held[-1][1].shape[1] != m.shape[1]:  # another dimension begins
                yield from search(len(held) - 1)
                held = []
            held.append((ids, m))
            if len(held) > 1:
                yield from search(len(held) - 2)
                held = held[-2:]
        if held:
            yield from search(len(held) - 1)

    return run


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of ``rows`` rows each, all of one dimension, in the order in which they come."""
    ids, m = np.empty(0, np.int64), np.empty((0, 0))
    for b in batches:
        dims = b.column("dim").to_numpy()
        cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1), len(dims)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi == lo:
                continue
            part = b.slice(lo, hi - lo)
            new = stacked(part.column("v"))
            if len(ids) and new.shape[1] != m.shape[1]:
                yield ids, m
                ids, m = np.empty(0, np.int64), np.empty((0, 0))
            m = np.concatenate([m, new]) if len(ids) else new
            ids = np.concatenate([ids, part.column("vec_id").to_numpy()])
            while len(ids) >= rows:
                yield ids[:rows], m[:rows]
                ids, m = ids[rows:], m[rows:]
    if len(ids):
        yield ids, m


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their block; the block's first row also tells its centre and the cosine of its angular radius."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for n, (ids, m) in enumerate(chunks(batches, BLOCK_ROWS)):
        unit = units(m)
        c = unit.sum(axis=0)
        c = c / norm if (norm := np.linalg.norm(c)) > 1e-12 else np.eye(m.shape[1])[0]
        rest = [None] * (len(ids) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(list(m), pa.list_(pa.float64())), pa.array(np.full(len(ids), m.shape[1], np.int32)), pa.array(np.full(len(ids), part << 24 | n, np.int64)), pa.array([c.tolist(), *rest], pa.list_(pa.float64())), pa.array([float((unit @ c).min()), *rest], pa.float64())],
            ["vec_id", "v", "dim", "block", "centre", "radius"],
        )


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by ``every`` the k rows of largest cosine.

    A row's own id is no candidate of its own; an id that repeats counts once, by its best row, and its queries merge.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part; nor
    do vectors of another length than the query's.  Equal scores go to the smaller id.  An empty table gives an empty
    result; other columns are ignored.  With ``exact`` false the blocks beyond the windows are left out.
    """
    spark = vectors.sparkSession
    rows = cut(keyed(usable(vectors, key, vector)))
    parts = max(1, -(-rows.count() // RANGE_ROWS))
    found = None
    for c in range(CURVES):
        # ids part the rows of one key, so copies of one vector spread over ranges
        along = rows.select("vec_id", "v", "dim", F.col("keys")[c].alias("at")).repartitionByRange(parts, "dim", "at", "vec_id").sortWithinPartitions("dim", "at", "vec_id").drop("at")
        hits = along.mapInArrow(_windows(k, every), FOUND)
        found = hits if found is None else found.union(hits)
    top = cut(tops(found, k))
    if not exact:
        return ranked(top)

    block = "vec_id bigint, v array<double>, dim int, block bigint, centre array<double>, radius double"
    along = rows.select("vec_id", "v", "dim", F.col("keys")[0].alias("at")).repartitionByRange(parts, "dim", "at", "vec_id").sortWithinPartitions("dim", "at", "vec_id").drop("at")
    dealt = cut(along.mapInArrow(_blocks, block))
    # the k-th score so far; queries that have fewer than k may need any block
    floor = top.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(-2.0).alias("floor"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "dim", F.col("keys")[0].alias("at"))
    queries = cut(query_blocks(queries).join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))))

    def summary(q: pd.DataFrame) -> pd.DataFrame:
        m = units(np.stack(q["v"]))
        c = m.sum(axis=0)
        c = c / norm if (norm := np.linalg.norm(c)) > 1e-12 else np.eye(m.shape[1])[0]
        return pd.DataFrame({"q_block": [q["q_block"].iloc[0]], "q_dim": [q["dim"].iloc[0]], "q_centre": [c.tolist()], "q_radius": [float((m @ c).min())], "floor": [q["floor"].min()]})

    q_blocks = queries.groupBy("q_block").applyInPandas(summary, "q_block bigint, q_dim int, q_centre array<double>, q_radius double, floor double")
    pairs = cut(_open_pairs(dealt.where(F.col("centre").isNotNull()).select("block", "dim", "centre", "radius"), q_blocks))
    data = dealt.select(F.col("vec_id").alias("d_id"), F.col("v").alias("d_v"), "block").join(pairs, "block").select(F.col("q_block").alias("d_q"), F.col("block").alias("d_b"), "d_id", "d_v")
    asked = queries.select("query_id", F.col("v").alias("q_v"), "floor", "q_block").join(pairs, "q_block")

    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b, s = best(q["query_id"].to_numpy(), np.stack(q["q_v"]), d["d_id"].to_numpy(), np.stack(d["d_v"]), k, q["floor"].to_numpy())
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    more = asked.groupBy("q_block", "block").cogroup(data.groupBy("d_q", "d_b")).applyInPandas(search, FOUND)
    return ranked(tops(top.union(more), k))


def query_blocks(queries: DataFrame) -> DataFrame:
    """``queries`` with q_block: neighbours along the curve, QUERY_ROWS of them in the mean, by the leading bits of their keys.

    Cells that hold more, say copies of one vector, are cut further by the hash of the id.
    """
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    bits = (blocks - 1).bit_length()
    q = queries.withColumn("cell", F.shiftright("at", BITS * DIRECTIONS - bits))
    sizes = q.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).alias("cuts"))
    q = q.join(sizes, ["dim", "cell"])
    return q.select("query_id", "v", "dim", F.xxhash64("dim", "cell", F.pmod(F.xxhash64("query_id"), "cuts")).alias("q_block"))


def _open_pairs(blocks: DataFrame, q_blocks: DataFrame) -> DataFrame:
    """(q_block, block): blocks of queries and of rows between which some angle may be small enough.

    Summaries only, a row for BLOCK_ROWS vectors: the stated queries in blocks against all rows in blocks.
    """
    n = blocks.sparkSession.sparkContext.defaultParallelism
    left = q_blocks.withColumn("cell", F.pmod(F.xxhash64("q_block"), F.lit(n)))
    right = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")))
    both = left.join(right, (left["cell"] == right["cell"]) & (left["q_dim"] == right["dim"]))
    dot = F.aggregate(F.zip_with("q_centre", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    angle = lambda c: F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    gap = angle(dot) - angle(F.col("q_radius")) - angle(F.col("radius"))
    return both.where((gap <= 0) | (F.cos(gap) >= F.col("floor") - 1e-6)).select("q_block", "block")


def tops(found: DataFrame, k: int) -> DataFrame:
    """The k best distinct rows of each query: largest score, then smallest id."""
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("t")).select("query_id", F.explode("t").alias("t")).select("query_id", F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))


def ranked(top: DataFrame) -> DataFrame:
    one = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("t")).select("query_id", F.posexplode("t").alias("n", "t"))
    return one.select("query_id", (F.col("n") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))
