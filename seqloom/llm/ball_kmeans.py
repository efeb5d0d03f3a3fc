"""Ball k-means: exact clusters of vectors, where balls rule most comparisons out.

A cluster is a ball: its centroid, and a radius that holds all of its members.  A centroid is a neighbour of a
ball if it is at most two radii away; no member can be as near to any other.  The members nearer to their
centroid than half the way to the nearest neighbour are the stable core: they stay.  The others lie in annuli,
bounded by half the ways to the first, second, ... neighbour, and a member of the n-th is compared
with the first n neighbours only.  Components are integers, so every comparison is exact, and so are ties.

A round is one pass: each task reassigns its vectors, writes them with their clusters, and adds a tally for each
ball (sums, count, radius).  Only tallies, a row for each task and ball, are gathered for the next centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm._shared import discard, new_path

#: Vectors, clusters and rounds of the registered query.
SIZE, CLUSTERS, ROUNDS = 64, 40, 5
#: Steps of a component; what a component may be after that, so that squared distances fit 64 bits.
SCALE, MOST = 256, 1 << 27

_STATE = "vec_id long, vec array<int>, cluster int, distance long, sums array<long>, count long, radius long, inertia decimal(38,0)"


def whole_vectors(table: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, vec``: the rows whose ``embedding`` has ``size`` finite components, each as ``floor(scale * x)``."""
    x = F.col("embedding")
    fine = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    step = lambda c: F.floor(F.lit(float(scale)) * F.when(F.abs(c.cast("double")) < MOST / scale, c.cast("double")).otherwise(F.raise_error(F.lit("a component is too large for squared distances of 64 bits")).cast("double")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(x.isNotNull()).where(fine).select("vec_id", F.transform(x, lambda c: step(c).cast("int")).alias("vec"))


def first_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``2:<vec_id>``, in that order; fewer if there are fewer."""
    rank = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    found = vectors.select("vec", rank.alias("rank")).orderBy(F.col("rank").asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r["vec"] for r in found], np.int64)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances: by floats where all sums are integers below 2^53."""
    if not len(vectors):
        return np.zeros(0, np.int64)
    step = vectors - centroid
    if vectors.shape[1] * float(np.abs(step).max()) ** 2 < 1 << 52:
        step = step.astype(float)
        return np.einsum("ij,ij->i", step, step).astype(np.int64)
    return (step * step).sum(axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) by comparison with all centroids; the smaller number wins a tie."""
    cluster, best = np.zeros(len(vectors), np.int64), squared(vectors, centroids[0])
    for j in range(1, len(centroids)):
        away = squared(vectors, centroids[j])
        nearer = away < best
        cluster[nearer], best[nearer] = j, away[nearer]
    return cluster, best


@dataclass
class Balls:
    """Centroids with the neighbours of each ball, nearest first, and four times which squared distance reaches them."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    gaps: list[np.ndarray]  # squared distances to the neighbours
    still: np.ndarray  # balls that have the centroid they had, and so have all of their neighbours

    @staticmethod
    def of(centroids: np.ndarray, before: np.ndarray, radius: np.ndarray) -> Balls:
        """``radius``: squared, of each ball around ``before`` (below 0: no members)."""
        gap = np.stack([squared(centroids, c) for c in centroids])
        shift = ((centroids - before).astype(float) ** 2).sum(axis=1)
        # Members are within the old radius of the old centroid: a bound around the new one, rounded up.
        reach = np.where(radius < 0, -1.0, (np.sqrt(np.maximum(radius, 0).astype(float)) + np.sqrt(shift)) * (1 + 1e-9) + 1e-6)
        neighbours, gaps = [], []
        for i in range(len(centroids)):
            near = np.flatnonzero(gap[i].astype(float) <= (2 * reach[i]) ** 2) if reach[i] >= 0 else np.zeros(0, np.int64)
            near = near[near != i]
            near = near[np.argsort(gap[i, near], kind="stable")]
            neighbours.append(near)
            gaps.append(gap[i, near])
        moved = shift > 0
        still = np.array([not moved[i] and not moved[near].any() for i, near in enumerate(neighbours)], bool)
        return Balls(centroids, neighbours, gaps, still)

    def reassign(self, vectors: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New (cluster, squared distance) of vectors that had a cluster, and a distance from its former centroid."""
        out, best = cluster.copy(), distance.copy()
        order = np.argsort(cluster, kind="stable")
        edges = np.searchsorted(cluster[order], np.arange(len(self.centroids) + 1))
        for i in range(len(self.centroids)):
            members = order[edges[i] : edges[i + 1]]
            if self.still[i] or not len(members):
                continue
            own = squared(vectors[members], self.centroids[i])
            best[members] = own
            outside = np.arange(len(members))
            for j, gap in zip(self.neighbours[i], self.gaps[i], strict=True):
                outside = outside[4 * own[outside] >= gap]  # what is nearer than half the way is in an inner annulus or the core
                if not len(outside):
                    break
                at = members[outside]
                away = squared(vectors[at], self.centroids[j])
                nearer = (away < best[at]) | ((away == best[at]) & (j < out[at]))
                out[at[nearer]], best[at[nearer]] = j, away[nearer]
        return out, best


def _assigned(rows: DataFrame, centroids: np.ndarray, balls: Balls | None) -> DataFrame:
    """``rows(vec_id, vec, cluster, distance)`` reassigned, and after those of a task a tally for each of its balls."""
    k, size = centroids.shape
    schema = pa.schema([("vec_id", pa.int64()), ("vec", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("sums", pa.list_(pa.int64())), ("count", pa.int64()), ("radius", pa.int64()), ("inertia", pa.decimal128(38, 0))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, radius, inertia = np.zeros((k, size), np.int64), np.zeros(k, np.int64), np.full(k, -1, np.int64), [0] * k
        nulls = lambda n: [pa.nulls(n, schema.field(x).type) for x in ("sums", "count", "radius", "inertia")]
        for batch in batches:
            if not len(batch):
                continue
            vec = batch.column("vec")
            vectors = vec.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
            if balls is None:
                cluster, distance = nearest(vectors, centroids)
            else:
                cluster, distance = balls.reassign(vectors, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("distance").to_numpy(zero_copy_only=False))
            for i in np.unique(cluster):
                own = cluster == i
                sums[i] += vectors[own].sum(axis=0)
                count[i] += own.sum()
                radius[i] = max(radius[i], distance[own].max())
                inertia[i] += sum(distance[own].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec, pa.array(cluster, pa.int32()), pa.array(distance), *nulls(len(batch))], schema=schema)
        full = np.flatnonzero(count)
        if len(full):
            tally = [pa.array(sums[full].tolist(), pa.list_(pa.int64())), pa.array(count[full]), pa.array(radius[full]), pa.array([inertia[i] for i in full], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.list_(pa.int32())), pa.array(full, pa.int32()), pa.nulls(len(full), pa.int64()), *tally], schema=schema)

    return rows.mapInArrow(assign, _STATE)


def _tallies(state: DataFrame, k: int, size: int) -> tuple[list[list[int]], np.ndarray, np.ndarray, list[int]]:
    """(sums, count, squared radius, inertia) of each ball; the radius is -1 without members."""
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    found = state.where(F.col("count").isNotNull()).groupBy("cluster").agg(F.sum("count").alias("n"), F.max("radius").alias("r"), F.sum("inertia").alias("t"), *sums).collect()
    total, count, radius, inertia = [[0] * size for _ in range(k)], np.zeros(k, np.int64), np.full(k, -1, np.int64), [0] * k
    for row in found:
        i = row["cluster"]
        total[i], count[i], radius[i], inertia[i] = [int(row[f"s{j}"]) for j in range(size)], row["n"], row["r"], int(row["t"])
    return total, count, radius, inertia


def cluster(table: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each vector kept.

    The first centroids are the ``k`` vectors with the least sha256 of ``2:<vec_id>`` (equal ids: by their
    components; a null vec_id comes last).  Each round assigns all vectors to the nearest centroid by squared distance,
    the smaller number if tied, and replaces each centroid that has members by the floor of their mean; then vectors are
    assigned once more.  Rows with a null vector, another length, or a null or non-finite component are left
    out; rows that share a vec_id, or are equal in all columns, are vectors of their own; a centroid that others equal keeps
    no members unless its number is the smallest.  With fewer than ``k`` vectors there are as many clusters; an empty
    table has no rows.  Components of 2^27 steps or more, whose squared distance is beyond 64 bits, are an error.  Other
    columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, size, scale)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]).where("false")
    rows, balls, path = vectors.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), None, None
    for left in range(rounds, -1, -1):
        last, path = path, new_path(spark, "balls")
        _assigned(rows, centroids, balls).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if last:
            discard(spark, [last])
        rows = state.where(F.col("vec").isNotNull()).select("vec_id", "vec", "cluster", "distance")
        sums, count, radius, inertia = _tallies(state, len(centroids), size)
        if left:
            moved = np.array([[x // int(count[i]) for x in sums[i]] if count[i] else centroids[i].tolist() for i in range(len(centroids))], np.int64)
            balls, centroids = Balls.of(moved, centroids, radius), moved
    named = [(i, inertia[i], sum(inertia), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    ends = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(n: int) -> str:
    """Assignment to the centroids ``c<n>`` and the next centroids, in DuckDB SQL."""
    return f"""
, a{n} AS (
  SELECT r, vec_id, v, (arg_min(c, d * {CLUSTERS} + c))::INTEGER AS c, min(d) AS d FROM (
    SELECT r, vec_id, v, c, list_dot_product(v, v) - 2 * list_dot_product(v, m) + list_dot_product(m, m) AS d FROM v, c{n}) GROUP BY r, vec_id, v
), m{n} AS (
  SELECT c, list(x ORDER BY i) AS m FROM (
    SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(v) AS x, unnest(range({SIZE})) AS i FROM a{n}) GROUP BY c, i) GROUP BY c
), c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN m{n} USING (c))"""


#: In DuckDB SQL, every vector compared with every centroid.
CLUSTER_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}
), c0 AS (
  SELECT c::INTEGER AS c, v AS m FROM (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c FROM v) WHERE c < {CLUSTERS}
){"".join(_round_sql(n) for n in range(ROUNDS + 1))}
SELECT vec_id, c AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (c)
"""
