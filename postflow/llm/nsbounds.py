"""Clusters of vectors around centroids, with ns-bounds (operator 13).

Each vector keeps, for every centroid, its distance at the round when that was last computed.  The centroids of all
rounds are kept, so such a distance is still a bound once it is loosened by how far the centroid lies from where
it was in that round: the norm of the total displacement, which by the triangle inequality is never more than the
sum of the steps (Newling and Fleuret 2016).  A centroid is looked at again only if its lower bound does not exceed
the upper bound of the vector's own one, and then by exact integer distances, so bounds decide what is
computed and never what is found.  A round is one pass over the vectors, which also adds them up by cluster.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.session import materialise

#: Centroids times components times rounds, of 8 bytes each, that are sent to every task.
MOST_HISTORY = 1 << 22
#: A component is kept within this size, so that a squared distance fits 64 bits.
LIMIT = 1 << 27
#: Up to this size products of components are exact in double precision.
_EXACT = 1 << 22

_STATE = "vec_id long, embedding array<float>, cluster int, distance long, seen binary, turn binary, count long, sums array<long>"


def points(embedding: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, as integers."""
    flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(np.int64)


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every centre."""
    if max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)) <= _EXACT // max(1, int(x.shape[1]) // 64 + 1):
        a, c = x.astype(np.float64), centers.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def nearest(x: np.ndarray, centers: np.ndarray):
    """(cluster, squared distance, distances, round) of vectors that no bounds are known of."""
    away = squared(x, centers)
    own = away.argmin(axis=1)  # of equal ones the first
    return own, away[np.arange(len(x)), own], np.sqrt(away.astype(np.float64)), np.zeros(away.shape, np.uint8)


def tightened(x: np.ndarray, history: np.ndarray, own, seen, turn):
    """As ``nearest`` for the last centroids of ``history``, looking only where bounds fail."""
    now, k = len(history) - 1, history.shape[1]
    moved = np.sqrt(((history - history[-1]) ** 2).sum(axis=2).astype(np.float64))  # by round and centroid
    rows = np.arange(len(x))
    drift = moved[turn, np.arange(k)]
    slack = 1e-6 * (1 + seen + drift)  # square roots are rounded, and kept in single precision
    lower = seen - drift - slack
    upper = (seen + drift + slack)[rows, own]
    fails = lower <= upper[:, None]
    fails[rows, own] = False
    # The own distance first: a tight upper bound settles most of the others.
    away = ((x - history[-1][own]) ** 2).sum(axis=1)
    fails &= lower <= (np.sqrt(away.astype(np.float64)) * (1 + 1e-9) + 1e-9)[:, None]
    seen, turn = seen.copy(), turn.copy()
    seen[rows, own], turn[rows, own] = np.sqrt(away.astype(np.float64)), now
    best, cluster = away.copy(), own.copy()
    for j in np.flatnonzero(fails.any(axis=0)).tolist():  # smaller numbers first, and then the same number never again
        at = np.flatnonzero(fails[:, j])
        found = ((x[at] - history[-1][j]) ** 2).sum(axis=1)
        seen[at, j], turn[at, j] = np.sqrt(found.astype(np.float64)), now
        wins = (found < best[at]) | ((found == best[at]) & (j < cluster[at]))
        best[at[wins]], cluster[at[wins]] = found[wins], j
    return cluster, best, seen, turn


def _round(history: np.ndarray, scale: float):
    """One pass: the rows with their new state, and for each batch a row of sums for each cluster."""
    k, dim = history.shape[1], history.shape[2]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 8192):
                part = batch.slice(at, 8192)
                x = points(part.column("embedding"), dim, scale)
                if len(history) == 1:
                    own, away, seen, turn = nearest(x, history[0])
                else:
                    seen, turn = (np.frombuffer(b"".join(part.column(c).to_pylist()), t).reshape(-1, k) for c, t in (("seen", np.float32), ("turn", np.uint8)))
                    old = part.column("cluster").to_numpy().astype(np.int64)
                    own, away, seen, turn = tightened(x, history, old, seen.astype(np.float64), turn)
                count = np.bincount(own, minlength=k)
                sums = np.zeros((k, dim), np.int64)
                np.add.at(sums, own, x)
                used = np.flatnonzero(count)
                total = np.zeros(k, np.int64)
                np.add.at(total, own, away)
                n = len(x) + len(used)

                def both(rows, sums, kind):
                    return pa.concat_arrays([pa.array(rows, kind), pa.array(sums, kind)])

                none = [None] * len(used)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([part.column("vec_id"), pa.nulls(len(used), pa.int64())]),
                        pa.concat_arrays([part.column("embedding").cast(pa.list_(pa.float32())), pa.nulls(len(used), pa.list_(pa.float32()))]),
                        pa.array(np.concatenate([own, used]), pa.int32()),
                        pa.array(np.concatenate([away, total[used]])),
                        both([r.tobytes() for r in seen.astype(np.float32)], none, pa.binary()),
                        both([r.tobytes() for r in turn.astype(np.uint8)], none, pa.binary()),
                        pa.array(np.concatenate([np.zeros(len(x), np.int64), count[used]])),
                        both([None] * len(x), sums[used].tolist(), pa.list_(pa.int64())),
                    ],
                    names=["vec_id", "embedding", "cluster", "distance", "seen", "turn", "count", "sums"],
                )

    return step


def _moved(state: DataFrame, centers: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of every component; of an empty cluster the old ones."""
    sums = state.filter("sums is not null").select("cluster", "count", F.posexplode("sums").alias("place", "x"))
    sums = sums.groupBy("cluster", "place").agg(F.sum("x").alias("x"), F.sum("count").alias("n"))
    new = centers.copy()
    for row in sums.collect():  # as many as the centroids have components
        new[row["cluster"], row["place"]] = row["x"] // row["n"]
    return new


def start(kept: DataFrame, k: int, seed: str, dim: int, scale: float) -> np.ndarray:
    """The points of the ``k`` vectors of smallest sha256 of seed and id; equal ids are told apart by their vectors."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").orderBy(order, "embedding").limit(k).select("embedding").toArrow()
    return points(first.column("embedding").combine_chunks(), dim, scale)


def centroid_clusters(
    vectors: DataFrame, vec_id="vec_id", embedding="embedding", k: int = 40, rounds: int = 5, dim: int = 64,
    scale: float = 256.0, seed: str = "2:",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Vectors of exactly ``dim`` components, none null or non-finite, are used; others have no row.  Components become
    floor(scale * x), within 2**27.  Centroids start as those of ``start``, or of all vectors if they are fewer, are
    moved ``rounds`` times to their vectors' componentwise floor(sum / count), and the vectors are assigned once more.
    Distances are squared; of equally near centroids the smaller number wins.  Rows that repeat an id are vectors of
    their own; a null id stays null and never starts a centroid.  Without a vector or a start the result is empty.
    """
    if k * dim * (rounds + 1) > MOST_HISTORY:
        raise ValueError("too many centroids, components or rounds for every task to hold their history")
    spark = vectors.sparkSession
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<float>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.filter((F.size("embedding") == dim) & F.coalesce(finite, F.lit(False)))
    history = start(kept, k, seed, dim, scale)[None]
    none = F.lit(None)
    state = kept.withColumns({
        "cluster": none.cast("int"), "seen": none.cast("binary"), "turn": none.cast("binary"),
    })
    names = ["vec_id", "embedding", "cluster", "seen", "turn"]
    if not history.shape[1]:
        state = spark.createDataFrame([], _STATE)
    for t in range(rounds + 1 if history.shape[1] else 0):
        state = materialise(state.select(*names).mapInArrow(_round(history, scale), _STATE), f"clusters-{t}")
        if t < rounds:
            history = np.concatenate([history, _moved(state, history[-1])[None]])
            state = state.filter("sums is null")
    inertia = {r["cluster"]: r["d"] for r in state.filter("sums is not null").groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    clusters = spark.createDataFrame(
        [(c, d, sum(inertia.values()), digests[c]) for c, d in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    assigned = state.filter("sums is null").select("vec_id", "cluster", "distance")
    return assigned.join(F.broadcast(clusters), "cluster").select(  # a row for each of k clusters
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
