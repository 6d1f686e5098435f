"""Centroid clustering: Lloyd's rounds over whole numbers with Yinyang's groups of centroids.

The first centroids are themselves clustered once, into about one group for ten. A row keeps
an upper bound of the distance to its centroid and, for each group, one lower bound of the
distance to the group's other centroids; both move with the centroids. A row whose upper
bound lies strictly below all its lower bounds is done (global filter); else the upper bound
is made exact, and only groups whose lower bound does not lie strictly above it are scanned,
exactly and whole (group filter). So ties are seen and go to the smaller number, and every
round assigns as a full search does.

Defined cases: vectors that are null, of another width or hold null, NaN or infinite
components take no part; components are cut to 2^27; rows that share an id count each on
its own, in the order of their vectors where that decides who is a first centroid; rows
without an id are clustered but are no first centroids, unless no row has an id; with fewer
vectors than centroids there are as many centroids as vectors; an empty cluster keeps its
centroid; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import usable
from .common import give_back
from .lloyd import lists, matrix, means, root_down, root_up, squared, stored, sums, whole

TILE = 4096
GROUP = 10
"""Centroids to a group, on average."""


def groups_of(centroids: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds of Lloyd among them; groups are numbered without gaps."""
    n = max(1, len(centroids) // GROUP)
    heads = centroids[:: max(1, len(centroids) // n)][:n].astype(np.float64)
    group = np.zeros(len(centroids), int)
    for _ in range(rounds):
        group = ((centroids[:, None] - heads[None]) ** 2).sum(-1).argmin(1)
        heads = np.array([centroids[group == g].mean(0) if (group == g).any() else heads[g] for g in range(n)])
    return np.unique(group, return_inverse=True)[1]


class Round:
    """Centroids of a round, their groups, and how far each moved."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.centroids, self.group, self.n_groups = centroids, group, int(group.max(initial=-1)) + 1
        self.members = [np.flatnonzero(group == g) for g in range(self.n_groups)]
        self.moved = None if before is None else root_up(squared(centroids, before))
        self.group_moved = None if before is None else np.array([self.moved[m].max() for m in self.members])

    def distances(self, v: np.ndarray, members: np.ndarray) -> np.ndarray:
        c = self.centroids[members]
        return (v * v).sum(1)[:, None] + (c * c).sum(1) - 2 * (v @ c.T)

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, upper bound, lower bounds by group, by all distances."""
        d = self.distances(v, np.arange(len(self.centroids)))
        a = d.argmin(axis=1)
        rows = np.arange(len(v))
        upper = root_up(d[rows, a])
        others = root_down(d)
        others[rows, a] = np.inf
        return a, upper, np.stack([others[:, m].min(axis=1) for m in self.members], axis=1)

    def again(self, v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the centroids moved, and how many distances were computed."""
        upper = (upper + self.moved[a]) * (1 + 1e-12)
        lower = np.maximum(lower - self.group_moved, 0) * (1 - 1e-12)
        open_ = np.flatnonzero(upper >= lower.min(axis=1))  # global filter
        if not len(open_):
            return a, upper, lower, 0
        own = squared(v[open_], self.centroids[a[open_]])
        upper[open_] = root_up(own)
        computed = len(open_)
        still = upper[open_] >= lower[open_].min(axis=1)
        open_, own = open_[still], own[still]
        scan = lower[open_] <= upper[open_, None]  # group filter
        start, best, at = a[open_].copy(), own.copy(), a[open_].copy()
        scanned = []
        for g, members in enumerate(self.members):
            row = np.flatnonzero(scan[:, g])
            if not len(row):
                continue
            d = self.distances(v[open_[row]], members)
            scanned.append((g, row, d))
            computed += d.size
            place = d.argmin(axis=1)
            near, who = d[np.arange(len(row)), place], members[place]
            better = (near < best[row]) | (near == best[row]) & (who < at[row])
            best[row[better]], at[row[better]] = near[better], who[better]
        # lower bounds of what was scanned, without the centroid that was chosen
        for g, row, d in scanned:
            far = root_down(d)
            far[self.members[g] == at[row, None]] = np.inf
            lower[open_[row], g] = far.min(axis=1)
        # the centroid that was left counts in its group now
        left = np.flatnonzero(at != start)
        old = self.group[start[left]]
        unseen = ~scan[left, old]
        lower[open_[left[unseen]], old[unseen]] = np.minimum(lower[open_[left[unseen]], old[unseen]], root_down(own[left[unseen]]))
        a[open_], upper[open_] = at, root_up(best)
        return a, upper, lower, computed


def _assign(shared, width: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Round = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                b = batch.slice(start, TILE)
                v = matrix(b["v"], width)
                if known.moved is None:
                    a, upper, lower = known.first(v)
                else:
                    a, upper, lower, _ = known.again(v, np.asarray(b["a"]).astype(np.int64), np.array(b["upper"]), matrix(b["lower"], known.n_groups, np.float64).copy())
                if last:
                    columns = {"id": b["id"], "cluster": pa.array(a.astype(np.int32)), "distance": pa.array(squared(v, known.centroids[a]))}
                else:
                    columns = {"id": b["id"], "v": b["v"], "a": pa.array(a.astype(np.int32)), "upper": pa.array(upper), "lower": lists(lower)}
                yield pa.RecordBatch.from_pydict(columns)
        give_back()

    return run


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")) & (F.size("v") == width)).withColumn("v", whole("v"))
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = kept.select("v", draw.alias("draw")).orderBy(F.col("draw").asc_nulls_last(), "v").limit(k).collect()
    named = [r["v"] for r in start if r["draw"] is not None] or [r["v"] for r in start]
    centroids = np.array(named, np.int64).reshape(len(named), width)
    group = groups_of(centroids) if len(centroids) else np.zeros(0, int)

    own = f"id {kept.schema['id'].dataType.simpleString()}"
    before, state, path = None, kept, None
    for _ in range(rounds if len(centroids) else 0):
        shared = spark.sparkContext.broadcast(Round(centroids, group, before))
        state, path = stored(state.mapInArrow(_assign(shared, width, last=False), f"{own}, v array<int>, a int, upper double, lower array<double>"), "clusters", path)
        before = centroids
        n, total = sums(state, len(centroids), width, ["v", "a"], lambda b: (np.asarray(b["a"]).astype(np.int64), matrix(b["v"], width)))
        centroids = means(centroids, n, total)
    shared = spark.sparkContext.broadcast(Round(centroids, group, before))
    found, _ = stored(state.mapInArrow(_assign(shared, width, last=True), f"{own}, cluster int, distance long"), "clustered", path)

    # a row for each cluster: k at most
    by_cluster = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    inertia = sum(by_cluster.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    table = spark.createDataFrame([(c, d, inertia, digest(c)) for c, d in by_cluster.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
