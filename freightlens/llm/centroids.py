"""Centroid clustering of whole-number vectors, exact in every step.

Vectors are scaled to whole numbers and written once as blocks: a few thousand rows a block, in the narrowest integer
type that holds them. A block's distances to all centroids are one matrix product, |x|^2 - 2 x.c + |c|^2 in float64.
As long as no term can reach 2^53 every product and sum is a whole number that float64 holds, so the result is
exact in any order; rows beyond that bound are computed in integers, of 64 bits or, further up, of any size.
Sums by centroid are combined by ``treeAggregate``; the driver holds the centroids and one set of sums.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, table

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
#: Rows of a block.
BLOCK_ROWS = 4096
_LONG = 1 << 63
_EXACT = 1 << 53


class Centroids(NamedTuple):
    """The centroids as whole numbers (rows of Python integers) and as float64."""

    rows: tuple[tuple[int, ...], ...]

    @property
    def most(self) -> int:
        return max((abs(v) for row in self.rows for v in row), default=0)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) of doubles, in int64, or in Python integers if one is too large for it."""
    if not len(values) or np.abs(values).max() * float(scale) < 2.0**62:
        return np.floor(values * scale).astype(np.int64)
    return np.vectorize(lambda v: math.floor(v * scale) if abs(v) < 2.0**40 else math.floor(v) * scale + math.floor(v % 1 * scale), otypes=[object])(values)


def packed(rows: np.ndarray) -> bytes:
    """A block's numbers in the narrowest type that holds them."""
    if rows.dtype == object:
        return b"o" + pickle.dumps(rows.tolist())
    most = int(np.abs(rows).max()) if rows.size else 0
    kind = next(k for k, top in (("i1", 1 << 7), ("i2", 1 << 15), ("i4", 1 << 31), ("i8", _LONG)) if most < top)
    return kind[1].encode() + rows.astype(f"<{kind}").tobytes()


def unpacked(data: bytes, dimensions: int) -> np.ndarray:
    """The rows of a block."""
    if data[:1] == b"o":
        return np.array(pickle.loads(data[1:]), dtype=object).reshape(-1, dimensions)
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).reshape(-1, dimensions)


def nearest(rows: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of every row; ties: the smaller number."""
    if rows.dtype != object:
        size = np.abs(rows.astype(np.int64)).max(axis=1, initial=0)
        near = size <= max(0, math.isqrt((_EXACT - 1) // rows.shape[1]) - centroids.most - 1)  # dimensions * (|x| + |c|)^2 < 2^53
        if near.all():
            return _by_product(rows, centroids)
        middle = ~near & (size <= max(0, math.isqrt((_LONG - 1) // rows.shape[1]) - centroids.most - 1))
    else:
        near = middle = np.zeros(len(rows), bool)
    cluster, distance = np.zeros(len(rows), np.int64), np.zeros(len(rows), object)
    for part, way in ((near, _by_product), (middle, _by_long), (~near & ~middle, _by_integer)):
        if part.any():
            cluster[part], found = way(rows[part], centroids)
            distance[part] = [int(v) for v in found]
    return cluster, distance


def _by_product(rows: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    x, c = rows.astype(np.float64), np.array(centroids.rows, np.float64)
    apart = np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)
    cluster = apart.argmin(axis=1)
    return cluster, apart[np.arange(len(x)), cluster].astype(np.int64)


def _by_long(rows: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    x = rows.astype(np.int64)
    apart = np.stack([((x - np.array(c, np.int64)) ** 2).sum(axis=1) for c in centroids.rows], axis=1)
    cluster = apart.argmin(axis=1)
    return cluster, apart[np.arange(len(x)), cluster]


def _by_integer(rows: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    apart = [[sum((int(a) - b) ** 2 for a, b in zip(row, c)) for c in centroids.rows] for row in rows]
    cluster = [min(range(len(a)), key=a.__getitem__) for a in apart]
    return np.array(cluster, np.int64), np.array([a[k] for a, k in zip(apart, cluster)], object)


class Sums(NamedTuple):
    """Of every centroid's vectors: how many, the sum of components and of distances, in integers of any size."""

    counts: list[int]
    totals: list[list[int]]
    inertia: list[int]

    @classmethod
    def none(cls, clusters: int, dimensions: int) -> Sums:
        return cls([0] * clusters, [[0] * dimensions for _ in range(clusters)], [0] * clusters)

    def add(self, rows: np.ndarray, centroids: Centroids) -> Sums:
        """With a block's vectors; a block's sums of 64-bit numbers can't overflow below 2^50."""
        cluster, distance = nearest(rows, centroids)
        small = rows.dtype != object and (not rows.size or int(np.abs(rows.astype(np.int64)).max()) < 1 << 50)
        for k in np.unique(cluster):
            mine = cluster == k
            block = rows[mine].astype(np.int64 if small else object).sum(axis=0)
            self.counts[k] += int(mine.sum())
            self.totals[k] = [a + int(b) for a, b in zip(self.totals[k], block)]
            self.inertia[k] += sum(distance[mine].tolist())
        return self

    def merge(self, other: Sums) -> Sums:
        return Sums(
            [a + b for a, b in zip(self.counts, other.counts)], [[a + b for a, b in zip(x, y)] for x, y in zip(self.totals, other.totals)],
            [a + b for a, b in zip(self.inertia, other.inertia)],
        )


def usable(vector: str, dimensions: int) -> Column:
    """Whether a vector has so many components, none of them null, infinite or not a number."""
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def as_blocks(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``ids, numbers`` (binary) of all rows of ``vec_id, embedding``, some thousand rows each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part.column(0).to_pylist())]), pa.array([packed(whole(values, scale))])], names=["ids", "numbers"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(each, "ids binary, numbers binary")


def start_rows(vectors: DataFrame, clusters: int = CLUSTERS, scale: int = SCALE, seed: int = SEED) -> Centroids:
    """The vectors whose ids have the smallest hashes; a repeated id counts as often as it comes, a null id last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    best = vectors.withColumn("key", key).orderBy(F.col("key").asc_nulls_last(), F.col("embedding")).limit(clusters).select("embedding").collect()  # ``clusters`` rows
    return Centroids(tuple(tuple(int(v) for v in whole(np.array(r["embedding"], np.float64), scale)) for r in best))


def assigned(blocks: RDD, centroids: Centroids, dimensions: int) -> Sums:
    """Sums of all blocks by nearest centroid, combined in a tree."""

    def add(sums: Sums, block: Row) -> Sums:
        return sums.add(unpacked(bytes(block["numbers"]), dimensions), centroids)

    return blocks.treeAggregate(Sums.none(len(centroids.rows), dimensions), add, lambda a, b: a.merge(b))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable row of ``vec_id, embedding``.

    Rows with another number of components or with one that is null, infinite or not a number are left out, and so
    are null vectors. Repeated rows and null ids are kept; other columns are ignored. With fewer rows than
    ``clusters`` there are so many centroids; without any there are no rows. A distance or inertia
    beyond 64 bits is null (assignments stay exact).
    """
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable("embedding", dimensions))
    blocks = cut_lineage(as_blocks(kept, dimensions, scale))
    centroids = start_rows(kept, clusters, scale, seed)
    layout = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids.rows:
        return vectors.sparkSession.createDataFrame([], layout)
    for _ in range(rounds):
        sums = assigned(blocks.rdd, centroids, dimensions)
        moved = tuple(tuple(t // n for t in total) if n else old for n, total, old in zip(sums.counts, sums.totals, centroids.rows))
        if moved == centroids.rows:
            break  # further rounds change nothing
        centroids = Centroids(moved)
    sums = assigned(blocks.rdd, centroids, dimensions)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.rows]

    def long(value: int) -> int | None:
        return value if value < _LONG else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = long(reduce(int.__add__, sums.inertia))
        for batch in batches:
            for ids, numbers in zip(batch.column(0), batch.column(1)):
                ids = pickle.loads(ids.as_py())
                number, distance = nearest(unpacked(numbers.as_py(), dimensions), centroids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array([long(d) for d in distance.tolist()], pa.int64()),
                    pa.array([long(sums.inertia[k]) for k in number], pa.int64()), pa.array([total] * len(ids), pa.int64()), pa.array([digests[k] for k in number]),
                ], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.mapInArrow(each, layout)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: clusters of all embeddings."""
    return cluster(table(spark, sf_dir, "embeddings"))


def rounds_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same for DuckDB, a step for each round, in whole numbers."""
    apart = "list_sum(list_transform(range(1, {d}+1), lambda i: (v.x[i]-c.x[i])*(v.x[i]-c.x[i])))".format(d=dimensions)
    near = "select vec_id, x, (least_of)[2]::int k, ((least_of)[1])::bigint d from (select v.vec_id, v.n, any_value(v.x) x, min([{a}, c.k::hugeint]) least_of from v, {c} c group by v.vec_id, v.n)"
    floor = "((s - ((s % n) + n) % n) // n)::hugeint"
    steps = [
        f"v as materialized (select vec_id, row_number() over () n, list_transform(embedding, lambda e: floor({scale}*e::double)::hugeint) x from embeddings where len(embedding)={dimensions} and len(list_filter(embedding, lambda e: e is null or not isfinite(e)))=0)",
        f"c0 as materialized (select row_number() over (order by sha256('{seed}:'||vec_id))-1 k, x from v order by sha256('{seed}:'||vec_id) limit {clusters})",
    ]
    for r in range(1, rounds + 1):
        steps.append(f"a{r} as materialized ({near.format(a=apart, c=f'c{r - 1}')})")
        steps.append(f"m{r} as (select k, list({floor} order by i) x from (select k, i, sum(e) s, count(*) n from (select k, unnest(x) e, unnest(range({dimensions})) i from a{r}) group by k, i) group by k)")
        steps.append(f"c{r} as materialized (select o.k, coalesce(m.x, o.x) x from c{r - 1} o left join m{r} m on o.k=m.k)")
    steps.append(f"z as materialized ({near.format(a=apart, c=f'c{rounds}')})")
    return (
        "with " + ", ".join(steps) + " select vec_id, z.k \"cluster\", d distance, sum(d) over (partition by z.k)::bigint cluster_inertia, sum(d) over ()::bigint inertia, "
        f"sha256(array_to_string(c.x, ',')) centroid_sha256 from z join c{rounds} c on c.k=z.k"
    )
