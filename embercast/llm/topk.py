"""Exact top-k inner products by multi-resolution segment statistics.

Every vector is cut into 1, 4 and 16 segments. A segment's mean and deviation
bound the part of an inner product that falls in it: with L components the part
is at most L * mean * mean + L * deviation * deviation (the same numbers that
bound a distance from below). For a block of queries against a block of
candidates the bounds are taken from coarse to fine; pairs whose bound is below
the query's k-th best score so far are out, and only the survivors' inner
products are computed, exactly. Blocks of queries meet blocks of candidates in
many tasks; each gives its best k of a query, and the best k of those remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embercast.llm.arrays import tidy, written

LEVELS = (1, 4, 16)
BLOCK, QUERY_BLOCK, GROUP_BLOCKS = 1024, 256, 8
#: Scores up to this size are exact in doubles.
EXACT = float(1 << 53)


def integers(vectors: list[list[float]], scale: float) -> np.ndarray:
    return np.floor(scale * np.array(vectors, np.float64))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(L) * mean and sqrt(L) * deviation of each segment, so that a bound is a plain inner product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        mean = part.mean(axis=1)
        out += [np.sqrt(b - a) * mean, np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0))


def best_of_block(queries: np.ndarray, q_stats: list[np.ndarray], x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, best: list[list[tuple[int, int]]]) -> None:
    """Bring ``best`` (for each query its k best as (-score, id)) up to date with the candidates x.

    own: for each query the place of its own row among the candidates, or -1."""
    stats = [statistics(x, s) for s in LEVELS]
    coarse = q_stats[0] @ stats[0].T
    slack = 1e-9 * (np.abs(q_stats[0]) @ np.abs(stats[0]).T) + 1e-6
    for i, row in enumerate(queries):
        bound = coarse[i] + slack[i]
        if own[i] >= 0:
            bound[own[i]] = -np.inf
        if len(best[i]) < k:  # exact scores of the most promising candidates give a first threshold
            first = np.argpartition(-bound, min(4 * k, len(bound) - 1))[:4 * k]
            first = first[bound[first] > -np.inf]
            best[i] = sorted(best[i] + [(-int(s), int(ids[j])) for s, j in zip(exact(x[first], row), first, strict=True)])[:k]
            bound[first] = -np.inf
        least = -best[i][-1][0] if len(best[i]) >= k else -np.inf
        left = np.flatnonzero(bound >= least) if least > -np.inf else np.flatnonzero(bound > -np.inf)
        for own_stats, theirs in zip(q_stats[1:], stats[1:], strict=True):
            fine = theirs[left] @ own_stats[i]
            left = left[fine + 1e-9 * (np.abs(theirs[left]) @ np.abs(own_stats[i])) + 1e-6 >= least]
        if len(left):
            found = [(-int(s), int(ids[j])) for s, j in zip(exact(x[left], row), left, strict=True) if s >= least]
            best[i] = sorted(best[i] + found)[:k]


def exact(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    if len(x) and np.abs(x).max() * np.abs(row).max() * len(row) >= EXACT:
        return np.array([sum(int(a) * int(b) for a, b in zip(v, row, strict=True)) for v in x], object)
    return x @ row


def blocks(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """Rows packed BLOCK at a time: block, dim, n, ids and values (binary). Vectors that are null, empty,
    or hold a null, NaN or infinite component, and rows with a null id, are left out."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, vectors = batch.column("id").to_numpy(), batch.column("v").to_pylist()
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for at in range(0, len(mine), BLOCK):
                    some = mine[at:at + BLOCK]
                    x = integers([vectors[j] for j in some], scale)
                    yield pa.RecordBatch.from_pydict({"block": [(part << 32) + number], "dim": [int(dim)], "n": [len(some)], "ids": [ids[some].astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()]})
                    number += 1

    return rows.mapInArrow(run, "block long, dim long, n long, ids binary, x binary")


def query_blocks(stored: DataFrame, step: int) -> DataFrame:
    """The rows whose id is divisible by ``step``, packed QUERY_BLOCK at a time with their places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, {}

        def made(dim: int) -> pa.RecordBatch:
            nonlocal number
            rows = held.pop(dim)
            number += 1
            columns = [np.array(c) for c in zip(*(r[:3] for r in rows), strict=True)]
            return pa.RecordBatch.from_pydict({"q": [(part << 32) + number], "q_dim": [dim], "q_ids": [columns[0].astype("<i8").tobytes()], "q_block": [columns[1].astype("<i8").tobytes()], "q_place": [columns[2].astype("<i8").tobytes()], "q_x": [b"".join(r[3] for r in rows)]})

        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<i8")
                x = np.frombuffer(r["x"], "<f8").reshape(r["n"], r["dim"])
                for j in np.flatnonzero(ids % step == 0):
                    held.setdefault(r["dim"], []).append((ids[j], r["block"], j, x[j].tobytes()))
                    if len(held[r["dim"]]) == QUERY_BLOCK:
                        yield made(r["dim"])
        for dim in list(held):
            yield made(dim)

    return stored.mapInArrow(run, "q long, q_dim long, q_ids binary, q_block binary, q_place binary, q_x binary")


def meet(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """One block of queries against the candidates of one group."""
        out = {"q_block": [], "q_place": [], "query_id": [], "vec_id": [], "score": []}
        for q in left.to_pylist():
            dim, ids = q["q_dim"], np.frombuffer(q["q_ids"], "<i8")
            at, place = np.frombuffer(q["q_block"], "<i8"), np.frombuffer(q["q_place"], "<i8")
            x = np.frombuffer(q["q_x"], "<f8").reshape(len(ids), dim)
            q_stats, best = [statistics(x, s) for s in LEVELS], [[] for _ in ids]
            for j in range(right.num_rows):
                c = {name: right.column(name)[j].as_py() for name in ("block", "dim", "n", "ids", "x")}
                if c["dim"] == dim:
                    own = np.where(at == c["block"], place, -1)
                    best_of_block(x, q_stats, np.frombuffer(c["x"], "<f8").reshape(c["n"], dim), np.frombuffer(c["ids"], "<i8"), own, k, best)
            for i, found in enumerate(best):
                out["q_block"] += [int(at[i])] * len(found)
                out["q_place"] += [int(place[i])] * len(found)
                out["query_id"] += [int(ids[i])] * len(found)
                out["vec_id"] += [v for _, v in found]
                out["score"] += [-s for s, _ in found]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in out.items()})

    return run


def top_k(df: DataFrame, k: int = 5, step: int = 50, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``step`` its k largest integer inner products with other rows.

    Components x count as floor(scale * x). Ties go to the smaller id; a row
    never meets itself, but a repeated row is another candidate. Rows that
    can't be compared (see ``blocks``) take no part, and vectors of different
    lengths don't meet; a query with fewer than k candidates returns them all.
    Columns: query_id, rank (from 1), vec_id, score. Other columns are ignored.
    A score that a long can't hold is an error.
    """
    stored = written(blocks(df, vec_id, vector, scale), "vector-blocks")
    queries = written(query_blocks(stored, step), "query-blocks")
    groups, sets = max(1, -(-stored.count() // GROUP_BLOCKS)), max(1, queries.count())
    # a stated query set against all rows, in blocks: a set of query blocks meets a group of candidate blocks in one task
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("s", F.pmod(F.xxhash64("q"), F.lit(sets))).withColumn("g", numbers(groups))
    right = stored.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups))).withColumn("s", numbers(sets))
    partial = left.groupBy("s", "g").cogroup(right.groupBy("s", "g")).applyInArrow(tidy(meet(k)), "q_block long, q_place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_place").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
