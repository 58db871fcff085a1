"""k-means in whole numbers, with centroids ruled out by their distance in a few rotated coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import settle_table

WIDTH, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
LEADING = 16  # rotated coordinates that are stored
REACH = 1 << 19  # components of at least this size have squared distances that no long holds
SLACK = 1e-9  # of the squared norms, far above what rounding does to a bound
_SLICE = 4096


def kept_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): vectors of WIDTH finite components below REACH, as whole numbers."""
    slim = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[embedding].cast("array<double>").alias("e"))
    usable = lambda x: x.isNotNull() & (F.abs(x) < REACH)  # noqa: E731  NaN is larger than all
    kept = slim.filter((F.size("e") == WIDTH) & F.forall("e", usable))
    return kept.select("vec_id", F.transform("e", lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the vectors of a task: their number, sums and sums of products, as one row per number."""
    total = np.zeros((WIDTH + 1, WIDTH + 1))
    for batch in batches:
        v = _matrix(batch.column("v"), WIDTH).astype(float)
        v = np.hstack([np.ones((len(v), 1)), v])
        total += v.T @ v
    yield pa.RecordBatch.from_pydict({"at": pa.array(range(total.size), pa.int32()), "x": pa.array(total.ravel())})


def rotation(kept: DataFrame) -> np.ndarray:
    """The WIDTH x LEADING matrix of the directions in which all vectors vary most.

    Tasks add up products, and Spark adds up tasks: a bounded number of sums reaches the driver. The
    rotation decides only how many centroids are ruled out, never the result.
    """
    rows = kept.select("v").mapInArrow(_moments, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((WIDTH + 1) ** 2)
    for r in rows:
        total[r["at"]] = r["x"]
    total = total.reshape(WIDTH + 1, WIDTH + 1)
    n = max(total[0, 0], 1)
    mean = total[0, 1:] / n
    _, directions = np.linalg.eigh(total[1:, 1:] / n - np.outer(mean, mean))  # ascending
    return np.ascontiguousarray(directions[:, ::-1][:, :LEADING])


def rotated(v: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leading rotated coordinates, norm of what is left) of vectors."""
    v = v.astype(float)
    lead = v @ directions
    return lead, np.sqrt(np.maximum((v * v).sum(1) - (lead * lead).sum(1), 0))


def _rotate(directions: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotated(_matrix(batch.column("v"), WIDTH), directions)
            ends = pa.array(np.arange(len(rest) + 1, dtype=np.int32) * LEADING)
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id"), "v": batch.column("v"),
                "lead": pa.ListArray.from_arrays(ends, pa.array(lead.ravel())), "rest": pa.array(rest),
            })

    return task


def nearest(v: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each vector; of equally near ones the smallest number.

    Squared distance in the leading coordinates, plus the squared difference of the norms of the
    rest, is never more than the squared distance. The exact distance to the centroid where this
    bound is least rules out all centroids whose bound is larger; the others are measured exactly.
    """
    c_lead, c_rest = rotated(centroids, directions)
    own, other = (lead * lead).sum(1) + rest * rest, (c_lead * c_lead).sum(1) + c_rest * c_rest
    # (p - q)^2 + (r - s)^2, with one product of matrices.
    bound = own[:, None] + other - 2 * (np.hstack([lead, rest[:, None]]) @ np.hstack([c_lead, c_rest[:, None]]).T)
    v = v.astype(np.int64)
    exact = lambda rows, which: ((v[rows] - centroids[which]) ** 2).sum(1)
    every = np.arange(len(v))
    guess = bound.argmin(1)
    distance = exact(every, guess)
    slack = SLACK * (own[:, None] + other) + 1
    rows, which = np.nonzero(bound <= distance[:, None] + slack)
    measured = np.full(bound.shape, np.iinfo(np.int64).max)
    measured[rows, which] = exact(rows, which)
    best = measured.argmin(1)  # the first of equal ones
    return best, measured[every, best]


def _sliced(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, directions: np.ndarray):
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            v = _matrix(part.column("v"), WIDTH)
            rest = part.column("rest").to_numpy(zero_copy_only=False)
            yield part, v, *nearest(v, _matrix(part.column("lead"), LEADING), rest, centroids, directions)


def _sums(centroids: np.ndarray, directions: np.ndarray):
    """A task's sums of each cluster: a row per cluster and place, place WIDTH being the count."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), WIDTH + 1), np.int64)
        for _, v, cluster, _ in _sliced(batches, centroids, directions):
            order = np.argsort(cluster, kind="stable")
            held, starts = np.unique(cluster[order], return_index=True)
            v = np.hstack([v[order].astype(np.int64), np.ones((len(v), 1), np.int64)])
            total[held] += np.add.reduceat(v, starts)
        cluster, place = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(cluster.ravel(), pa.int32()), "place": pa.array(place.ravel(), pa.int32()), "x": pa.array(total.ravel())
        })

    return task


def moved(stored: DataFrame, centroids: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floors of their vectors' means; those without any stay.

    Sums are whole numbers, so no order of adding changes them.
    """
    rows = (
        stored.mapInArrow(_sums(centroids, directions), "cluster int, place int, x long")
        .groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    )
    total = {(r["cluster"], r["place"]): int(r["x"]) for r in rows}
    out = centroids.copy()
    for k in range(len(centroids)):
        if n := total.get((k, WIDTH), 0):
            out[k] = [total[k, place] // n for place in range(WIDTH)]
    return out


def assigned(stored: DataFrame, centroids: np.ndarray, directions: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, distance in _sliced(batches, centroids, directions):
            yield pa.RecordBatch.from_pydict({
                "vec_id": part.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)
            })

    return stored.mapInArrow(task, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row per kept vector.

    Components x become floor(256 * x). Centroids start as the ``k`` vectors whose ids hash smallest;
    each round moves them to the floor of their vectors' mean. Each vector is stored with its LEADING
    coordinates in a rotation fitted on all vectors (principal components) and the norm of the rest,
    from which bounds rule out most centroids (:func:`nearest`); what is left is measured in whole
    numbers, so results don't depend on the rotation.

    Left out are vectors that are null, have another number of components, or a component that is null,
    not finite, or of 2^19 and more (its squared distances fit no long). Null ids hash last among
    the starting vectors, equal ids by their components; rows with one id are as many vectors. With fewer
    than ``k`` vectors each starts a centroid; an empty table gives no rows. Other columns are ignored.
    """
    spark, kept = vectors.sparkSession, settle_table(kept_vectors(vectors, vec_id, embedding), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(hashed.asc_nulls_last(), "v").select("v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64)
    directions = rotation(kept)
    stored = settle_table(kept.mapInArrow(_rotate(directions), "vec_id long, v array<int>, lead array<double>, rest double"), "rotated")
    for _ in range(rounds):
        centroids = moved(stored, centroids, directions)
    final = settle_table(assigned(stored, centroids, directions), "assigned")
    # At most k rows: inertia of each cluster, and the digest of its centroid.
    inertia = final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    total = sum(int(r["own"]) for r in inertia)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    fits = lambda x: x if x < 1 << 63 else None
    facts = [(r["cluster"], fits(int(r["own"])), fits(total), digest(centroids[r["cluster"]])) for r in inertia]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    return f"""
a{i} as (
    select vec_id, v, arg_min(c, (d, c)) as c, min(d) as d
    from (select vec_id, v, c, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, w)])::bigint as d from kept, c{i})
    group by vec_id, v
)"""


def _move(i: int) -> str:
    floor = "((s - ((s % n) + n) % n) // n)"
    return f"""
s{i} as (
    select c, i, sum(x)::hugeint as s, count(*)::hugeint as n
    from (select c, unnest(v) as x, generate_subscripts(v, 1) as i from a{i}) group by c, i
), m{i} as (select c, list({floor}::bigint order by i) as w from s{i} group by c),
c{i + 1} as (select c{i}.c, coalesce(m{i}.w, c{i}.w) as w from c{i} left join m{i} on m{i}.c = c{i}.c)"""


# Holds for tables whose vec_id are unique.
SQL = f"""
with kept as materialized (
    select vec_id, [floor({SCALE} * x::double)::bigint for x in embedding] as v from embeddings
    where len(embedding) = {WIDTH} and len([x for x in embedding if x is not null and isfinite(x)]) = {WIDTH}
), c0 as (
    select row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as c, v as w
    from kept order by c limit {CLUSTERS}
), {", ".join(f"{_round(i)}, {_move(i)}" for i in range(ROUNDS))}, {_round(ROUNDS)}
select vec_id, a{ROUNDS}.c::int as cluster, d as distance, sum(d) over (partition by a{ROUNDS}.c)::bigint as cluster_inertia,
    sum(d) over ()::bigint as inertia, sha256(array_to_string(w, ',')) as centroid_sha256
from a{ROUNDS} join c{ROUNDS} on c{ROUNDS}.c = a{ROUNDS}.c
"""
