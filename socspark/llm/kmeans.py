"""k-means over whole-number vectors, with bounds loosened by planar geometry.

Every vector keeps a lower bound on its distance to all centroids but its own.
When centroids move, the distance to a moved centroid can shrink by its drift at
most. For the vectors of one cluster it shrinks by less: they lie in a sphere
around the cluster's old centroid, and by symmetry the largest change of
distance between the old and the new place a and b of another centroid is found
in the plane through a, b and the sphere's centre. There the points whose
distance shrinks by p * sin(t), p being the drift, lie on a hyperbola inside the
asymptotes of angle t from the middle of a and b; so the steepest angle under
which the sphere is seen bounds the change. A vector whose exact distance to its
own centroid stays below its bound keeps its cluster; the others are compared
with every centroid.

Each round is one pass over a table in the shared folder, which holds the
vectors with their cluster and bound. Tasks add up their clusters, so at most
k rows of sums leave a task, whatever a cluster's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, stored

#: Sums of squares of smaller components are exact in doubles.
EXACT_BELOW = 1 << 22
#: Bounds are kept this much on the safe side of the rounding of doubles.
SLACK = 1e-9
#: What a stored row is: a vector, or a task's sums of one cluster.
VECTOR, SUMS = 0, 1


def whole_vectors(table: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, v): the kept vectors in whole numbers, floor(scale * x)."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(1 << 62))
    given = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("given"))
    kept = given.where((F.size("given") == size) & F.forall("given", fits))
    return kept.select("id", F.transform("given", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of their ids, in this order; rows with a null id are none of them."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.where(F.col("id").isNotNull()).orderBy(key, "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def most_loosening(centre: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """How much nearer, at most, ``new`` is than ``old`` to any point of the sphere."""
    way = new - old
    drift = float(np.sqrt(way @ way))
    if drift == 0.0:
        return 0.0
    from_middle = centre - (old + new) / 2
    up = float(from_middle @ way) / drift
    reach = float(from_middle @ from_middle)
    aside = float(np.sqrt(max(reach - up * up, 0.0)))
    if reach <= radius * radius:
        return drift
    tangent = float(np.sqrt(reach - radius * radius))
    # Beyond the right angle the sphere meets the axis, where the whole drift is lost.
    if up > 0 and aside * tangent <= up * radius:
        return drift
    return drift * min(max((up * tangent + aside * radius) / reach, 0.0), 1.0)


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each cluster, by how much the bound of its vectors must fall."""
    a, b = old.astype(float), new.astype(float)
    out = np.zeros(len(a))
    for i in range(len(a)):
        out[i] = max((most_loosening(a[i], float(radii[i]), a[j], b[j]) for j in range(len(a)) if j != i), default=0.0)
    return out * (1 + SLACK) + SLACK


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid, as doubles where these hold them, else as Python's whole numbers."""
    if max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT_BELOW:
        x, c = v.astype(float), centroids.astype(float)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    x, c = v.astype(object), centroids.astype(object)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def assign(v: np.ndarray, centroids: np.ndarray, cluster: np.ndarray | None, bound: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, exact squared distance to its centroid, lower bound to all others, vectors compared with every centroid).

    ``bound`` holds for the present centroids already.
    """
    n = len(v)
    if cluster is None:
        doubtful, distance = np.arange(n), np.zeros(n, dtype=object)
        cluster, bound = np.zeros(n, dtype=np.int64), np.zeros(n)
    else:
        own, cluster, bound = centroids[cluster], cluster.copy(), bound.copy()
        if max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT_BELOW:
            gap = (v - own).astype(float)
            distance = (gap * gap).sum(1)
        else:
            distance = ((v.astype(object) - own.astype(object)) ** 2).sum(1)
        near = np.sqrt(distance.astype(float))
        doubtful = np.flatnonzero(~(near * (1 + SLACK) < bound - SLACK))
        distance = distance.astype(object)
    if len(doubtful):
        all_of = squared(v[doubtful], centroids)
        best = all_of.argmin(1)
        rows = np.arange(len(doubtful))
        cluster[doubtful], distance[doubtful] = best, all_of[rows, best]
        rest = np.sqrt(all_of.astype(float))
        rest[rows, best] = np.inf
        bound[doubtful] = rest.min(1) * (1 - SLACK)
    return cluster, distance, bound, len(doubtful)


class Sums:
    """One task's sums of each cluster: members, components, distances, and the farthest member."""

    def __init__(self, k: int, size: int):
        self.count, self.inertia, self.farthest, self.scanned = [0] * k, [0] * k, [0] * k, 0
        self.total = np.zeros((k, size), dtype=object)

    def add(self, v: np.ndarray, cluster: np.ndarray, distance: np.ndarray, scanned: int) -> None:
        self.scanned += scanned
        small = int(np.abs(v).max(initial=0)) < EXACT_BELOW
        for i in np.unique(cluster).tolist():
            mine = cluster == i
            far = distance[mine]
            self.count[i] += int(mine.sum())
            self.inertia[i] += sum(map(int, far))
            self.farthest[i] = max(self.farthest[i], int(max(far)))
            self.total[i] += (v[mine] if small else v[mine].astype(object)).sum(0).astype(object)

    def rows(self) -> list[tuple]:
        first = next((i for i, n in enumerate(self.count) if n), None)
        return [(i, n, list(map(str, self.total[i])), str(self.inertia[i]), str(self.farthest[i]), self.scanned if i == first else 0) for i, n in enumerate(self.count) if n]


def assign_all(vectors: DataFrame, centroids: np.ndarray, fall: np.ndarray | None) -> DataFrame:
    """One round: the stored rows of vectors with their new cluster, distance and bound, and the tasks' sums.

    ``fall`` is how much each cluster's bounds fall; without it every vector is compared with every centroid.
    """
    id_type = vectors.schema["id"].dataType
    names = ["kind", "id", "v", "cluster", "distance", "bound", "count", "total", "inertia", "farthest", "scanned"]
    kinds = [T.IntegerType(), id_type, T.ArrayType(T.LongType(), False), T.IntegerType(), T.LongType(), T.DoubleType(), T.LongType(), T.ArrayType(T.StringType(), False), T.StringType(), T.StringType(), T.LongType()]
    schema, (k, size) = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]), centroids.shape
    arrow = [pa.int32(), None, pa.list_(pa.field("element", pa.int64(), False)), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.field("element", pa.string(), False)), pa.string(), pa.string(), pa.int64()]

    def batch_of(columns: dict[str, pa.Array], n: int, id_arrow: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[name] if name in columns else pa.nulls(n, t or id_arrow) for name, t in zip(names, arrow, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, id_arrow = Sums(k, size), None
        for batch in batches:
            id_arrow, given = batch.column("id").type, batch.column("v")
            if not len(batch):
                continue
            flat = given.flatten()
            v = flat.to_numpy(zero_copy_only=False).reshape(-1, size)
            cluster, bound = (None, None) if fall is None else (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cluster", "bound"))
            cluster, distance, bound, scanned = assign(v, centroids, cluster, None if fall is None else bound - fall[cluster])
            sums.add(v, cluster, distance, scanned)
            far = pa.array([d if d < 1 << 63 else None for d in map(int, distance)], pa.int64())
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * size)
            columns = {"kind": pa.array(np.full(len(v), VECTOR, dtype=np.int32)), "id": batch.column("id"), "v": pa.ListArray.from_arrays(offsets, flat, type=arrow[2]), "cluster": pa.array(cluster.astype(np.int32)), "distance": far, "bound": pa.array(bound.astype(float))}
            yield batch_of(columns, len(v), id_arrow)
        if rows := sums.rows():
            parts = dict(zip(("cluster", "count", "total", "inertia", "farthest", "scanned"), zip(*rows, strict=True), strict=True))
            columns = {"kind": pa.array(np.full(len(rows), SUMS, dtype=np.int32))} | {n: pa.array(list(x), arrow[names.index(n)]) for n, x in parts.items()}
            yield batch_of(columns, len(rows), id_arrow)

    wanted = ("id", "v") if fall is None else ("id", "v", "cluster", "bound")
    return vectors.select(*wanted).mapInArrow(run, schema)


def totals(done: DataFrame, k: int, size: int) -> tuple[list[int], list[list[int]], list[int], list[int], int]:
    """(members, sums, inertia, squared radius) of each cluster and the vectors scanned: the tasks' rows added up, k rows for the driver."""
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums = done.where(F.col("kind") == SUMS)
    each = [exact(F.col("total")[i]).alias(f"s{i}") for i in range(size)]
    found = sums.groupBy("cluster").agg(F.sum("count").alias("n"), exact(F.col("inertia")).alias("inertia"), F.max(F.col("farthest").cast("decimal(38,0)")).alias("farthest"), F.sum("scanned").alias("scanned"), *each).collect()
    count, total, inertia, farthest = [0] * k, [[0] * size for _ in range(k)], [0] * k, [0] * k
    for r in found:
        i = r["cluster"]
        count[i], inertia[i], farthest[i] = r["n"], int(r["inertia"]), int(r["farthest"])
        total[i] = [int(r[f"s{j}"]) for j in range(size)]
    return count, total, inertia, farthest, sum(r["scanned"] for r in found)


def cluster_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``) of every kept vector after ``rounds`` of k-means.

    A vector is left out where it is null, has not ``size`` components, one of
    them is null or not finite, or one times ``scale`` does not fit a long. The
    first centroids are the kept vectors with the smallest hashes of their ids
    (of equal ids the smallest vector first); fewer than ``k`` vectors give fewer
    centroids. Equal distances go to the smaller number, a cluster without vectors
    keeps its centroid, repeated rows count each for itself, and a vector with a
    null id is clustered but is no first centroid. Without a vector with an id
    there are no rows. A distance or inertia that does not fit a long is null. Other
    columns are left out, whatever their names.
    """
    vectors = whole_vectors(table, id_col, vector_col, size, scale)
    vectors = stored(vectors, "kmeans-vectors")
    centroids, fall = first_centroids(vectors, k, seed), None
    fields = [T.StructField(id_col, table.schema[id_col].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())]
    if not len(centroids):
        return table.sparkSession.createDataFrame([], T.StructType(fields))
    n = len(centroids)
    for r in range(rounds + 1):
        vectors = stored(assign_all(vectors, centroids, fall), f"kmeans-{r}")
        count, total, inertia, farthest, _ = totals(vectors, n, size)
        if r < rounds:
            moved = np.array([[s // count[i] for s in total[i]] if count[i] else centroids[i] for i in range(n)], dtype=np.int64)
            fall, centroids = loosening(centroids, moved, np.sqrt(np.array(farthest, dtype=float)) * (1 + SLACK)), moved
            vectors = vectors.where(F.col("kind") == VECTOR)
    fits = lambda x: x if x < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    names = fresh(vectors, "c")
    of = table.sparkSession.createDataFrame([(i, fits(inertia[i]), fits(sum(inertia)), digest[i]) for i in range(n)], f"{names[0]} int, cluster_inertia long, whole long, centroid_sha256 string")
    found = vectors.where(F.col("kind") == VECTOR).join(F.broadcast(of), F.col("cluster") == F.col(names[0]))
    return found.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.col("whole").alias("inertia"), "centroid_sha256")
