"""Clusters around centroids, with bounds by groups of centroids.

Each row carries its cluster, an upper bound of the distance to that centroid
and, for each group of centroids, a lower bound of the distance to any other
centroid of the group. A round moves the bounds by how far centroids moved;
rows whose upper bound is below all lower ones keep their cluster unseen, others
scan the groups that their bounds don't rule out. Distances are exact whole
numbers, bounds leave more room than rounding takes, so the clusters are those
of plain rounds, ties included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, new_path, staged, table
from .vectors import lists, matrix, squared, whole_vectors

DIM, CENTROIDS, ROUNDS = 64, 40, 5
#: Centroids of a group, about.
GROUP = 10
#: By this part of a distance bounds are wider; sums of bounds round off about 1e-16 of it each.
SLACK = 1e-11


def group_centroids(centroids: np.ndarray, groups: int) -> list[np.ndarray]:
    """The numbers of the centroids of each group: a few of Lloyd's rounds over the centroids themselves."""
    middles = centroids[: max(groups, 1)].astype(float)
    for _ in range(5):
        of = ((centroids[:, None] - middles[None]) ** 2).sum(2).argmin(1)
        middles = np.stack([centroids[of == g].mean(0) if (of == g).any() else middles[g] for g in range(len(middles))])
    return [np.flatnonzero(of == g) for g in range(len(middles)) if (of == g).any()]


def reassign(v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray, groups: list[np.ndarray]) -> int:
    """Bring ``cluster``, ``upper`` and ``lower`` up to ``centroids``, each of
    which moved by ``drift``, in place; the number of distances computed."""
    high, low = 1 + SLACK, 1 - SLACK
    upper += drift[cluster] * high
    lower -= np.array([drift[g].max() for g in groups]) * high
    todo = np.flatnonzero(~(upper < lower.min(1)))
    seen = len(todo)

    def exact(rows: np.ndarray) -> np.ndarray:
        d = v[rows].astype(np.int64) - centroids[cluster[rows]]
        return (d * d).sum(1)

    upper[todo] = np.sqrt(exact(todo)) * high
    todo = todo[~(upper[todo] < lower[todo].min(1))]
    before = exact(todo)
    best, of = before.copy(), cluster[todo].copy()
    scans = []
    for k, members in enumerate(groups):
        rows = np.flatnonzero(~(np.sqrt(best) * high < lower[todo, k]))
        d = squared(v[todo[rows]], centroids[members])
        seen += d.size
        at = d.argmin(1) if len(rows) else np.zeros(0, np.int64)
        nearest = d[np.arange(len(rows)), at]
        better = (nearest < best[rows]) | ((nearest == best[rows]) & (members[at] < of[rows]))
        best[rows[better]], of[rows[better]] = nearest[better], members[at[better]]
        d[np.arange(len(rows)), at] = np.iinfo(np.int64).max
        scans.append((rows, members[at], nearest, d.min(1) if len(rows) else nearest))
    group_of = np.empty(len(centroids), np.int64)
    for k, members in enumerate(groups):
        group_of[members] = k
    # a scanned group's bound is its nearest centroid, or the second where the nearest is the row's own
    scanned = np.zeros((len(todo), len(groups)), bool)
    for k, (rows, nearest, d, second) in enumerate(scans):
        own = nearest == of[rows]
        second = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(float)))
        lower[todo[rows], k] = np.where(own, second, np.sqrt(d)) * low
        scanned[rows, k] = True
    # a centroid that was left counts for its group again
    left = np.flatnonzero((of != cluster[todo]) & ~scanned[np.arange(len(todo)), group_of[cluster[todo]]])
    was = group_of[cluster[todo[left]]]
    lower[todo[left], was] = np.minimum(lower[todo[left], was], np.sqrt(before[left]) * low)
    cluster[todo], upper[todo] = of, np.sqrt(best) * high
    return seen


STATE = "vec_id long, v array<int>, cluster int, before int, upper double, lower array<double>"


def _assigned(df: DataFrame, centroids: np.ndarray, drift: np.ndarray, groups: list[np.ndarray], start: bool = False) -> DataFrame:
    """The state (``STATE``) after one assignment; at the start rows have no bounds."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), centroids.shape[1])
            if start:
                cluster, upper, lower = np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.full((len(v), len(groups)), -np.inf)
                before = pa.nulls(len(v), pa.int32())
            else:
                before = b.column(2)
                cluster, upper = before.to_numpy().astype(np.int64), b.column(3).to_numpy().copy()
                lower = matrix(b.column(4), len(groups)).copy()
            if len(v):
                reassign(v, cluster, upper, lower, centroids, drift, groups)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), before, pa.array(upper), lists(lower, pa.float64())], ["vec_id", "v", "cluster", "before", "upper", "lower"])

    columns = ["vec_id", "v"] if start else ["vec_id", "v", "cluster", "upper", "lower"]
    return df.select(*columns).mapInArrow(update, STATE)


def centroid_clusters(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids) of the vectors of ``df``.

    Centroids start as the ``k`` vectors with the smallest sha256 of
    ``<seed>:<id>``; in each round every vector goes to the nearest one (of
    equals that of the smaller number) and centroids become the componentwise
    floor of their vectors' mean, empty ones stay; then vectors are assigned once
    more. ``distance`` is squared. Rows go whose vector is null, has not ``dim``
    components, or holds null or non-finite ones; components beyond
    ``vectors.bound`` count as that bound. Repeated rows count each, and start
    centroids in the order of hash, then vector; null ids start none, but are
    clustered. Fewer rows make fewer centroids; without any, nothing is
    returned. Other columns, whatever their names, are not read.

    Between rounds only rows that changed their cluster are summed. Each round's
    state is written, and that before it removed.
    """
    spark = df.sparkSession
    kept = whole_vectors(df.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("v")), "v", dim, ["vec_id"])
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.filter("vec_id is not null").withColumn("name", name).orderBy("name", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64)
    centroids = np.array([r.v for r in sorted(first, key=lambda r: (r.name, r.v))], np.int64)
    groups = group_centroids(centroids, round(len(centroids) / GROUP))
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    state, old = None, None
    for _ in range(rounds + 1):
        if state is None:
            told = _assigned(kept, centroids, np.zeros(len(centroids)), groups, start=True)
        else:
            told = _assigned(state, moved, np.sqrt(((moved - centroids) ** 2).sum(1)), groups)
            centroids = moved
        path = new_path(spark, "clusters")
        told.write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if old:
            delete(spark, old)
        old = path
        for r in _changes(state, dim).collect():  # a row per centroid
            counts[r.cluster] += r.n
            sums[r.cluster] += np.array([r[f"s{i}"] for i in range(dim)], np.int64)
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster = b.column(2).to_numpy()
            d = matrix(b.column(1), dim).astype(np.int64) - centroids[cluster]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array((d * d).sum(1), pa.int64())], ["vec_id", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(measured, "vec_id long, cluster int, distance long"), centroids


def _changes(state: DataFrame, dim: int) -> DataFrame:
    """(cluster, n, s0, s1, …): what rows that changed their cluster add to the new one and take from the old."""
    into = F.struct(F.col("cluster").alias("cluster"), F.lit(1).alias("sign"))
    out = F.struct(F.col("before").alias("cluster"), F.lit(-1).alias("sign"))
    both = F.when(F.col("before").isNull(), F.array(into)).otherwise(F.array(into, out))
    moved = state.filter("before is null or before <> cluster").select("v", F.inline(both))
    sums = [F.sum(F.get("v", F.lit(i)).cast("long") * F.col("sign")).alias(f"s{i}") for i in range(dim)]
    return moved.groupBy("cluster").agg(F.sum("sign").alias("n"), *sums)


def with_inertia(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``clustered`` plus ``cluster_inertia`` and ``inertia`` (distance summed
    over the cluster and over all; null beyond a long) and ``centroid_sha256``."""
    spark = clustered.sparkSession
    clustered = staged(clustered, "clustered")
    sums = clustered.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row per centroid
    whole = sum(int(r.d) for r in sums)
    fits = lambda x: x if x < 1 << 63 else None
    rows = [(r.cluster, fits(int(r.d)), fits(whole), hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()) for r in sums]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return clustered.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` of 64 components in 40 clusters."""
    return with_inertia(*centroid_clusters(table(spark, sf_dir, "embeddings")))


def _near_sql(k: int) -> str:
    return f"""
near{k} as materialized (select vec_id, min(d * 64 + c) % 64 as c, min(d * 64 + c) // 64 as d
  from (select p.vec_id, b.c, sum((p.x - b.x) * (p.x - b.x))::bigint as d from comp p join book{k} b using (pos) group by all) group by vec_id)"""


def _step_sql(k: int) -> str:
    return f"""{_near_sql(k)},
book{k + 1} as materialized (select b.c, b.pos, coalesce(m.x, b.x) as x from book{k} b left join
  (select n.c, p.pos, ((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*))::bigint as x
   from comp p join near{k} n using (vec_id) group by all) m using (c, pos))"""


#: Ids without repeats.
OP13_SQL = f"""
with kept as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
comp as materialized (select vec_id, i as pos, v[i + 1] as x from (select *, unnest(range(len(v))) as i from kept)),
first as (select vec_id, row_number() over (order by sha256('2:' || vec_id)) - 1 as c from kept order by sha256('2:' || vec_id) limit 40),
book0 as materialized (select c, pos, x from comp join first using (vec_id)),{",".join(map(_step_sql, range(ROUNDS)))},{_near_sql(ROUNDS)}
select vec_id, c::int as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia,
  (select sum(d) from near{ROUNDS})::bigint as inertia, s as centroid_sha256
from near{ROUNDS} join (select c, sha256(string_agg(x::varchar, ',' order by pos)) as s from book{ROUNDS} group by c) using (c)
"""
