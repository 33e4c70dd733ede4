"""Centroid clustering of integer vectors by sort-means.

Each round the other centroids are ordered by their distance from each centroid; a vector scans them from its previous
centroid outwards and stops strictly beyond twice its distance from that one (squared: four times), since by the
triangle inequality none further on can be as near. All of it is in exact integers, so ties fall to the smaller number
and every run gives the same clusters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborql.llm.common import release
from arborql.tables import Tables

#: Centroids looked at in one product while rows are scanned.
STEP = 8
#: Integers up to this size have exact products of a thousand components in doubles; larger ones are Python's integers.
EXACT = 1 << 20


def quantised(df: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double> of integers): the vectors with exactly ``dims`` components, none null or non-finite,
    neither before nor after they are scaled, each component x as floor(scale * x)."""
    v = F.transform(vector_col, lambda x: F.lit(float(scale)) * x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = df.select(F.col(id_col).alias("vec_id"), v.alias("v")).where((F.size("v") == dims) & ~bad)
    # floor() of a double is a long; beyond its range a double is an integer already
    return kept.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < F.lit(2.0 ** 62), F.floor(x).cast("double")).otherwise(x)))


def first_centroids(vectors: DataFrame, k: int, seed: int = 2) -> list[list[int]]:
    """The ``k`` vectors with the least sha256 of ``seed:vec_id``, fewer if there are fewer; of one id's rows the least
    vector comes first, rows with a null id last. Each partition sends ``k`` rows."""
    rows = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k)
    return [[int(x) for x in r["v"]] for r in rows.collect()]


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles that hold integers as Python's integers, without bound."""
    return np.array([[int(c) for c in row] for row in x], object).reshape(x.shape)


class Scan:
    """Nearest centroids of blocks of vectors, by each centroid's list of the others in order of distance."""

    def __init__(self, centroids: list[list[int]]):
        self.exact = max((abs(x) for c in centroids for x in c), default=0) <= EXACT and len(centroids[0]) <= 1024
        self.small = np.array(centroids, float) if self.exact else None
        self.large = np.array(centroids, object)
        apart = self.between(self.large, self.large)
        self.order = np.argsort(apart, axis=1, kind="stable")
        #: for each centroid the squared distances of all, in order; the first is itself or one equal to it
        self.apart = np.take_along_axis(apart, self.order, 1)

    @staticmethod
    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances of all rows of a from all rows of b."""
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a.dot(b.T)

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row (the smaller number of equally near ones) and its squared distance."""
        if self.exact and (not x.size or np.abs(x).max() <= EXACT):
            return self._nearest(x, before, self.small, self.apart.astype(float))
        return self._nearest(_whole(x), before, self.large, self.apart)

    def _nearest(self, x: np.ndarray, before: np.ndarray, centroids: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, least = before.copy(), np.empty(len(x), x.dtype)
        for c in np.unique(before):
            rows = np.flatnonzero(before == c)
            own = self.between(x[rows], centroids[c:c + 1])[:, 0]
            least[rows] = own
            # how many of the list each row scans; rows that scan more come first, so each step takes a head of them
            far = np.searchsorted(apart[c], 4 * own, side="right")
            rank = np.argsort(-far, kind="stable")
            rows, far = rows[rank], far[rank]
            for j in range(0, len(centroids), STEP):
                head = rows[: np.searchsorted(-far, -j, side="left")]
                if not len(head):
                    break
                some = np.sort(self.order[c, j:j + STEP])
                d = self.between(x[head], centroids[some])
                at = d.argmin(1)  # the first of equally near ones
                near, which = d[np.arange(len(head)), at], some[at]
                better = (near < least[head]) | ((near == least[head]) & (which < best[head]))
                best[head[better]], least[head[better]] = which[better], near[better]
        return best, least


def _blocks(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    v = b.column("v")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)


def assign(vectors: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(vec_id, v, cluster, distance) of (vec_id, v, cluster): the nearest centroid by a scan from the previous one. A
    distance beyond a long is null. The centroids go with the task: k rows, whatever the table's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(centroids)
        for b in batches:
            x, before = _blocks(b, dims)
            best, least = scan.nearest(x, before)
            far = [None if d > 2 ** 63 - 1 else int(d) for d in least]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "v", "cluster", "distance"])
        release()

    schema = T.StructType([vectors.schema["vec_id"], vectors.schema["v"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return vectors.select("vec_id", "v", "cluster").mapInArrow(run, schema)


def means(assigned: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """Each centroid's vectors' componentwise floor(sum / count); one without vectors stays. Tasks send sums of their
    own rows, at most k times dims of them, which are combined before the driver takes k times dims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for b in batches:
            x, cluster = _blocks(b, dims)
            exact = not x.size or np.abs(x).max() <= EXACT
            for c in np.unique(cluster).tolist():
                rows = x[cluster == c]
                own = (rows.astype(np.int64) if exact else _whole(rows)).sum(0).tolist()
                n[c] = n.get(c, 0) + len(rows)
                sums[c] = [a + d for a, d in zip(sums.get(c, [0] * dims), own)]
        flat = [(c, d, n[c], str(s)) for c in sums for d, s in enumerate(sums[c])]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(list(f)) for f in zip(*flat)], ["cluster", "d", "n", "s"])

    partial = assigned.select("v", "cluster").mapInArrow(run, "cluster long, d long, n long, s string")
    total = partial.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = [list(c) for c in centroids]
    for r in total.collect():
        new[r["cluster"]][r["d"]] = int(r["s"]) // r["n"]
    return new


def cluster(df: DataFrame, tables: Tables, k: int = 40, dims: int = 64, scale: int = 256, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance) of the kept vectors after ``rounds`` rounds and a last assignment, and the final
    centroids. A round reads the table that the round before wrote (vectors with their clusters), and drops it.

    Vectors that are null, of another length, or hold a null or non-finite component are not kept. Repeated rows are
    vectors of their own, a null vec_id too; fewer than ``k`` vectors make as many centroids; an empty table gives no
    rows and no centroids; other columns are not looked at. Sums beyond 38 digits are an error."""
    rows = tables.write(quantised(df, dims, scale).withColumn("cluster", F.lit(0)))
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return rows.withColumn("distance", F.lit(0).cast("long")), []
    for _ in range(rounds):
        after = tables.write(assign(rows, centroids, dims))
        tables.drop(rows)
        rows, centroids = after, means(after, centroids, dims)
    after = tables.write(assign(rows, centroids, dims))
    tables.drop(rows)
    return after, centroids


def digests(df: DataFrame, tables: Tables, **options) -> DataFrame:
    """Per kept vector: cluster, distance, the cluster's and the whole inertia, and its final centroid's digest. What is
    joined is a row a centroid, of which there are k at most. An inertia that is no long, or of a null distance, is null."""
    rows, centroids = cluster(df, tables, **options)
    d = F.col("distance").cast("decimal(38,0)")
    sums = rows.groupBy("cluster").agg(F.when(F.count("distance") == F.count(F.lit(1)), F.sum(d)).alias("s"))
    own = {r["cluster"]: r["s"] for r in sums.collect()}
    whole = None if None in own.values() else sum(own.values())
    long = lambda x: None if x is None or x >= 2 ** 63 else int(x)
    per = [(i, long(own[i]), long(whole), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids) if i in own]
    per = df.sparkSession.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
