"""Centroid clustering in exact integers, with bounds loosened by geometry instead of full drift.

Vectors are kept in blocks, one row a block: ids, integer components, and for each vector its
cluster, an upper bound of the distance to its centroid and a lower bound of the distance to
every other centroid.  A round is one pass over the blocks: it takes the moved centroids, mends
the bounds, and looks again only at the vectors whose bounds no longer tell their cluster.

How far must the lower bound of cluster i's vectors drop when centroid j moves from p to q?  The
block's vectors of cluster i lie in a sphere around the old centroid i, of the largest upper
bound.  The points that come nearer to j by more than d * cos(a) (d = |pq|) lie inside a
hyperbola with foci p and q, which lies inside the cone of half-angle a around the ray from the
middle of pq to q.  In the plane of p, q and the sphere's centre, the sphere is seen from that
middle at the angle b off the ray, and fills s = asin(radius / distance) to each side: no vector
comes nearer by more than d * cos(b - s), which is nothing at all from a right angle on.  Only a
sphere around the middle, or across the ray, costs the full drift.

A vector whose upper bound is below its lower bound, or below half the way to the nearest other
centroid, keeps its cluster; the upper bound is made exact first where that fails.  The others,
and every vector whose bounds meet, are compared with all centroids in exact integers, equal
distances going to the smaller number.  Bounds are doubles held apart by a margin far above
their rounding; a cluster never rests on a rounded number.

Each round writes the blocks anew to the shared folder, with the sums of their clusters, and then
removes the round before: a lost executor reruns a task from a whole table.  The driver sees the
centroids and their sums, nothing that grows with the vectors.

Defined results: kept are vectors of exactly ``dim`` components, none null or non-finite, and
none of 2^27 or more as an integer (their squared distances need not fit a long); all others,
null vectors included, give no row.  Rows that share an id are vectors of their own; those with
equal hashes start in the order of their components.  An inertia beyond a long is null.  Fewer kept vectors than ``k``: that many
centroids; none, or an empty table: no rows.  Other columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teebox.llm import scratch

K, DIM, ROUNDS, SCALE, SEED = 8, 64, 10, 1024, 3
BLOCK = 2048  # vectors in a block
LARGEST = 1 << 27  # components at and beyond this are not kept
BLAS_LARGEST = 1 << 21  # up to here sums of squares are whole numbers in doubles
MARGIN = 1e-9  # relative room between two bounds

STATE = "ids binary, id_known binary, vectors binary, cluster binary, upper binary, lower binary, counts array<long>, sums array<long>, scanned long"


def kept(table: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of long) of the vectors that take part."""
    named = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.size("v") == dim)
    # a null, NaN or infinite component does not compare as below the limit
    scaled = named.withColumn("v", F.transform("v", lambda x: F.floor(F.when(F.abs(x.cast("double")) < LARGEST, scale * x.cast("double")))))
    return scaled.filter(F.forall("v", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False))))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash, in that order."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    return np.array([r.v for r in hashed.orderBy("hash", "v").limit(k).collect()], dtype=np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors (rows) to centroids (columns)."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < BLAS_LARGEST:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(v), len(c)), np.int64)
    for j, row in enumerate(c):
        d = v - row
        out[:, j] = (d * d).sum(1)
    return out


def loosening(old: np.ndarray, new: np.ndarray, centre: int, radius: float) -> float:
    """How much nearer another moved centroid can come to any point of the sphere around ``old[centre]``, at most."""
    p, q = old.astype(np.float64), new.astype(np.float64)
    drift = np.sqrt(((q - p) ** 2).sum(1))
    middle = (p + q) / 2
    to = p[centre] - middle
    far = np.sqrt((to * to).sum(1))
    worst = 0.0
    for j in range(len(p)):
        if j == centre or drift[j] == 0:
            continue
        if far[j] <= radius:
            worst = max(worst, drift[j])
            continue
        cos_b = float(np.clip((to[j] * (q[j] - p[j])).sum() / (far[j] * drift[j]), -1, 1))
        angle = np.arccos(cos_b) - np.arcsin(radius / far[j])
        worst = max(worst, drift[j] * np.cos(np.clip(angle, 0, np.pi / 2)))
    return worst


def assign(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number of equal ones), its distance, and the next one's."""
    d = squared(v, c)
    near = d.argmin(1)
    rows = np.arange(len(v))
    best = d[rows, near]
    d[rows, near] = np.iinfo(np.int64).max
    return near.astype(np.int32), np.sqrt(best.astype(np.float64)), np.sqrt(d.min(1).astype(np.float64))


def reassign(v, cluster, upper, lower, old, new) -> int:
    """Mend bounds and clusters in place after the centroids moved; returns how many vectors were scanned."""
    drift = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1))
    between = np.sqrt(squared(new, new).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    half = between.min(1) / 2
    for i in range(len(new)):
        mine = cluster == i
        if mine.any():
            lower[mine] -= loosening(old, new, i, float(upper[mine].max()) * (1 + MARGIN)) * (1 + MARGIN)
    upper += drift[cluster]
    safe = np.maximum(lower, half[cluster]) * (1 - MARGIN)
    open_ = np.flatnonzero(upper * (1 + MARGIN) >= safe)
    if len(open_):
        diff = v[open_] - new[cluster[open_]]
        upper[open_] = np.sqrt((diff * diff).sum(1).astype(np.float64))
        open_ = open_[upper[open_] * (1 + MARGIN) >= safe[open_]]
    if len(open_):
        cluster[open_], upper[open_], lower[open_] = assign(v[open_], new)
    return len(open_)


def _row(ids: bytes, known: bytes, v, cluster, upper, lower, k: int, scanned: int) -> pa.RecordBatch:
    counts = np.bincount(cluster, minlength=k)
    sums = np.zeros((k, v.shape[1]), np.int64)
    np.add.at(sums, cluster, v)
    packed = [ids, known, v.astype("<i4").tobytes(), cluster.astype("<i4").tobytes(), upper.astype("<f8").tobytes(), lower.astype("<f8").tobytes()]
    arrays = [pa.array([x], pa.binary()) for x in packed]
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (counts, sums.ravel())]
    names = ["ids", "id_known", "vectors", "cluster", "upper", "lower", "counts", "sums", "scanned"]
    return pa.record_batch([*arrays, *lists, pa.array([scanned], pa.int64())], names=names)


def _unpacked(row: dict, dim: int):
    v = np.frombuffer(row["vectors"], "<i4").astype(np.int64).reshape(-1, dim)
    return v, np.frombuffer(row["cluster"], "<i4").copy(), np.frombuffer(row["upper"], "<f8").copy(), np.frombuffer(row["lower"], "<f8").copy()


def blocks(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """The vectors in blocks, each vector scanned once."""
    k, dim = c.shape

    @scratch.tidy
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                cluster, upper, lower = assign(v, c)
                ids = pc.fill_null(part.column(0), 0).to_numpy().astype("<i8").tobytes()
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False).astype("u1").tobytes()
                yield _row(ids, known, v, cluster, upper, lower, k, len(v))

    return vectors.select("id", "v").mapInArrow(run, STATE)


def moved(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The blocks after the centroids moved from ``old`` to ``new``."""
    k, dim = new.shape

    @scratch.tidy
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                v, cluster, upper, lower = _unpacked(row, dim)
                scanned = reassign(v, cluster, upper, lower, old, new)
                yield _row(row["ids"], row["id_known"], v, cluster, upper, lower, k, scanned)

    return state.mapInArrow(run, STATE)


def means(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Exact floor of each cluster's componentwise mean; an empty cluster's centroid stays."""
    k, dim = old.shape

    @scratch.tidy
    def partial(batches):
        counts, sums = [0] * k, [0] * (k * dim)
        for batch in batches:
            for row in batch.to_pylist():
                counts = [a + b for a, b in zip(counts, row["counts"])]
                sums = [a + b for a, b in zip(sums, row["sums"])]
        yield pa.record_batch([pa.array(range(k * dim), pa.int32()), pa.array(sums, pa.int64()), pa.array([counts[i // dim] for i in range(k * dim)], pa.int64())], names=["at", "sum", "n"])

    out = old.copy()
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("sum", "n")]
    for r in state.select("counts", "sums").mapInArrow(partial, "at int, sum long, n long").groupBy("at").agg(*exact).collect():
        if r.n:
            out[r.at // dim, r.at % dim] = int(r.sum) // int(r.n)
    return out


def cluster(
    table: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """(vec_id, cluster and distance (squared) of every kept vector; the final centroids)."""
    scratch.ready(table)
    vectors = kept(table, dim, scale, id_col, vector_col)
    new = first_centroids(vectors, k, seed)
    if not len(new):
        return vectors.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    state = scratch.written(blocks(vectors, new), "centroids-0")
    for i in range(rounds):
        old, new = new, means(state, new)
        after = scratch.written(moved(state, old, new), f"centroids-{i + 1}")
        scratch.remove(state)
        state = after
    return assigned(state, new), [tuple(map(int, row)) for row in new]


def assigned(state: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster and exact squared distance of every vector of the blocks."""
    dim = c.shape[1]

    @scratch.tidy
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                v, cluster, _, _ = _unpacked(row, dim)
                diff = v - c[cluster]
                known = np.frombuffer(row["id_known"], "u1") == 0
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), pa.int64(), mask=known)
                yield pa.record_batch([ids, pa.array(cluster, pa.int32()), pa.array((diff * diff).sum(1), pa.int64())], names=["vec_id", "cluster", "distance"])

    return state.select("ids", "id_known", "vectors", "cluster", "upper", "lower").mapInArrow(run, "vec_id long, cluster int, distance long")


def with_digests(found: DataFrame, centroids: list[tuple[int, ...]]) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256."""
    spark = found.sparkSession
    found = scratch.written(found, "clusters")
    inertia = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    long = lambda x: x if x < 1 << 63 else None
    rows = [(i, long(inertia.get(i, 0)), long(sum(inertia.values())), ",".join(map(str, c))) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    named = named.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The same in DuckDB: every round one aggregate and one table of nearest centroids."""
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM v QUALIFY cluster < {K}
)""",
    ]
    near = """a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, arg_min(cluster, [d, cluster]) AS cluster, min(d) AS d
  FROM (SELECT r, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i})
  GROUP BY r, vec_id, v
)"""
    mean = f"""c{{n}} AS MATERIALIZED (
  SELECT c{{i}}.cluster, coalesce(m.c, c{{i}}.c) AS c FROM c{{i}} LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c
    FROM (SELECT cluster, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIM})) AS pos FROM a{{i}}) GROUP BY cluster, pos) GROUP BY cluster
  ) m USING (cluster)
)"""
    for i in range(ROUNDS):
        parts += [near.format(i=i), mean.format(i=i, n=i + 1)]
    parts.append(near.format(i=ROUNDS))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""


ORACLE = _oracle()
