"""Centroid clustering of integer vectors by bit planes and popcounts.

A vector of 64 components is kept as one 64-bit word per bit plane: bit i of
plane j is bit j of component i, the last plane being the sign's. The inner
product of two vectors is the sum over their planes of 2**(i + j) times the
popcount of plane i AND plane j, minus where exactly one of them is a sign
plane, so distances are exact integers without unpacking a vector. Planes are
written once and read in each round; a task sums up its vectors' components for
each cluster, and only these sums are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embercast.llm.arrays import give_back, written

DIMS = 64
BLOCK, ROWS = 8192, 512
#: With components below this, 64 squared differences fit in a long.
LARGEST = 1 << 27


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes (plane, vector) of integer vectors in two's complement, as few as hold all components."""
    most = max(int(x.max()), ~int(x.min())) if x.size else 0
    return np.stack([np.packbits((x >> j & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0] for j in range(most.bit_length() + 1)])


def vectors(p: np.ndarray) -> np.ndarray:
    """The integer vectors of bit planes."""
    x = np.zeros((p.shape[1], DIMS), np.int64)
    for j, plane in enumerate(p):
        bits = np.unpackbits(np.ascontiguousarray(plane, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        x += bits << j if j + 1 < len(p) else -(bits << j)
    return x


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all vectors of planes ``a`` with all of planes ``b``."""
    out = np.zeros((a.shape[1], b.shape[1]), np.int64)
    for i, left in enumerate(a):
        for j, right in enumerate(b):
            count = np.bitwise_count(left[:, None] & right).astype(np.int64) << (i + j)
            if (i + 1 == len(a)) != (j + 1 == len(b)):
                out -= count
            else:
                out += count
    return out


def nearest(p: np.ndarray, squares: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of planes ``p`` its nearest centroid (ties: the smaller number) and the squared distance."""
    theirs, own = planes(centroids), (centroids * centroids).sum(axis=1)
    numbers, distances = [], []
    for at in range(0, p.shape[1], ROWS):
        d = own - 2 * products(p[:, at:at + ROWS], theirs)
        numbers.append(d.argmin(axis=1))
        distances.append(d.min(axis=1) + squares[at:at + ROWS])
    return np.concatenate(numbers), np.concatenate(distances)


def kept_vectors(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """id and x (scaled integers as doubles) of the rows that can be clustered."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") == DIMS) & finite)
    return rows.select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("x"))


def plane_blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``kept_vectors`` packed: ids (list), n, planes and squared lengths (binary)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = pc.list_flatten(part.column("x")).to_numpy(zero_copy_only=False).reshape(-1, DIMS)
                if np.abs(x).max() >= LARGEST:
                    raise ValueError("a component is too large for distances that a long can hold")
                x = x.astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([len(x)], pa.int64()), "ids": pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                    "planes": [planes(x).astype("<u8").tobytes()], "squares": [(x * x).sum(axis=1).astype("<i8").tobytes()],
                })
        give_back()

    return rows.mapInArrow(run, "n long, ids array<long>, planes binary, squares binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    for batch in batches:
        for row in batch.to_pylist():
            yield np.frombuffer(row["planes"], "<u8").reshape(-1, row["n"]), np.frombuffer(row["squares"], "<i8"), row["ids"]


def moved(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of their vectors' exact component means; empty ones stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((len(centroids), DIMS), object), np.zeros(len(centroids), np.int64)
        for p, squares, _ in _blocks(batches):
            number, _ = nearest(p, squares, centroids)
            x, order = vectors(p), np.argsort(number, kind="stable")
            there, first = np.unique(number[order], return_index=True)
            sums[there] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(number, minlength=len(centroids))
        there = np.flatnonzero(counts)
        if len(there):
            columns = [pa.array(there), pa.array(counts[there]), *(pa.array(sums[there, i].astype(np.int64)) for i in range(DIMS))]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *(f"x{i}" for i in range(DIMS))])

    partial = stored.mapInArrow(run, "cluster long, n long, " + ", ".join(f"x{i} long" for i in range(DIMS)))
    whole = [F.sum(F.col(f"x{i}").cast("decimal(28,0)")).alias(f"x{i}") for i in range(DIMS)]
    out = centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # a row for each centroid at most
        out[row["cluster"]] = [int(row[f"x{i}"]) // row["n"] for i in range(DIMS)]
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, scale: float = 256.0, seed: str = "2", vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256, and the final centroids.

    Components x count as floor(scale * x). Vectors that are null, have other
    than 64 components, or hold a null, NaN or infinite one take no part. The
    first centroids are the k vectors whose sha256 of "seed:id" is smallest (of
    equal ids, the smaller vector first); rows with a null id come last there
    but are clustered as any other, and so are repeated rows. With fewer than k
    vectors there are fewer centroids; without any the result is empty. A
    component of 2**27 or more is an error, as a long could not hold distances.
    Other columns are ignored. Bounded by k: centroids and their sums, which
    are all that reaches the driver.
    """
    rows = kept_vectors(df, vec_id, vector, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    stored = written(plane_blocks(rows), "plane-blocks")
    centroids = np.array([r["x"] for r in first], np.float64).astype(np.int64).reshape(-1, DIMS)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(stored, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, squares, ids in _blocks(batches):
            number, distance = nearest(p, squares, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = written(stored.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    table = [(c, sums[c], sum(sums.values()), shas[c]) for c in sorted(sums)]
    of = df.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
