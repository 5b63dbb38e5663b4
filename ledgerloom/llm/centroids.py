"""Op 13: centroid clustering of integer vectors by partial-distance search.

Each task turns its vectors into integers and looks for the nearest centroid: squared differences are added up over the
dimensions of highest variance first, a centroid is abandoned as soon as its sum is strictly above the best full
distance so far, and what survives all dimensions is a full distance. A round sends per task one sum for each cluster and
dimension into a grouped sum; the driver holds the centroids only, whose number and width are parameters.

Defined cases: vectors that are null, of another length or with a null or non-finite component are left out; equal
distances go to the smaller number; repeated rows are so many vectors; a null vec_id is hashed as an empty number, and
equal hashes are ordered by components; fewer kept vectors than clusters give as many clusters as vectors; without any
kept vector there are no rows. Components are held in 27 bits, so that distances are exact in 64: a larger one, over
65,535 before scaling, is an error. Extra columns, of any name, pass through ``assigned``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import keep, lists, shielded, table

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Dimensions that are added up between two looks at the best distance.
STEP = 8
#: Vectors that are worked on at once.
ROWS = 4096
MOST = 1 << 26
CHOICE = [T.StructField("__km_cluster", T.IntegerType()), T.StructField("__km_distance", T.LongType())]


@dataclass(frozen=True)
class Model:
    """Integer centroids (one row each) and the dimensions by falling variance."""

    centroids: np.ndarray
    order: np.ndarray


def integers(column: pa.Array, width: int = WIDTH, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vectors that are kept, and their components as integers."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), width), False)))
    flat = column.take(pa.array(rows)).flatten()
    values = np.asarray(pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    fine = np.isfinite(values).all(1)
    values = np.floor(values[fine] * scale)
    if values.size and np.abs(values).max() > MOST:
        raise ValueError(f"a component is beyond {MOST // scale} before scaling: its distances need not fit in 64 bits")
    return rows[fine], values.astype(np.int64)


def nearest(points: np.ndarray, model: Model, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each point, and the squared distance."""
    points, centroids = points[:, model.order], model.centroids[:, model.order]
    which, best = np.zeros(len(points), np.int32), np.zeros(len(points), np.int64)
    for number, centroid in enumerate(centroids):
        alive, total = np.arange(len(points)), np.zeros(len(points), np.int64)
        for first in range(0, points.shape[1], step):
            apart = points[alive, first : first + step] - centroid[first : first + step]
            total += np.einsum("ij,ij->i", apart, apart)
            if number:
                stays = total <= best[alive]
                alive, total = alive[stays], total[stays]
        closer = total < best[alive] if number else np.ones(len(alive), bool)
        which[alive[closer]], best[alive[closer]] = number, total[closer]
    return which, best


def _pieces(batches, width: int, scale: int):
    for batch in batches:
        rows, points = integers(batch.column(batch.schema.get_field_index("embedding")), width, scale)
        for first in range(0, len(rows), ROWS):
            yield batch, rows[first : first + ROWS], points[first : first + ROWS]


def _numbers(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).ravel(), pa.int64()) for c in columns], names)


def _moments(width: int, scale: int):
    def moments(batches):
        n, sums, squares = 0, np.zeros(width, np.int64), [0] * width
        for _, _, points in _pieces(batches, width, scale):
            n, sums = n + len(points), sums + points.sum(0)
            squares = [a + int(b) for a, b in zip(squares, (points * points).sum(0))]
        if n:
            # Squares need more than 64 bits after some thousands of the widest components: they go in two parts.
            yield _numbers([range(width), [n] * width, sums, [q >> 32 for q in squares], [q & 0xFFFFFFFF for q in squares]], ["dim", "n", "s", "high", "low"])

    return moments


def _first(width: int, scale: int):
    def first(batches):
        for batch, rows, points in _pieces(batches, width, scale):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), lists(list(points))], ["vec_id", "parts"])

    return first


def _sums(model: Model, width: int, scale: int):
    def sums(batches):
        k = len(model.centroids)
        n, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for _, _, points in _pieces(batches, width, scale):
            which, _ = nearest(points, model)
            n += np.bincount(which, minlength=k)
            for c in range(k):
                total[c] += points[which == c].sum(0)
        if n.any():
            yield _numbers([np.repeat(np.arange(k), width), np.tile(np.arange(width), k), np.repeat(n, width), total], ["cluster", "dim", "n", "s"])

    return sums


def _summed(rows: DataFrame, keys: list[str], values: list[str]) -> list:
    exact = [F.sum(F.col(v).cast("decimal(38,0)")).alias(v) for v in values]
    return rows.groupBy(*keys).agg(*exact).collect()


def _slim(vectors: DataFrame, *more: str) -> DataFrame:
    wide = vectors.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    return vectors.select(*more, F.col("embedding") if wide else F.col("embedding").cast("array<double>").alias("embedding"))


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> Model | None:
    """Centroids after so many rounds; None without any kept vector. A round that changes nothing is the last."""
    slim = _slim(vectors)
    spread = _summed(slim.mapInArrow(_moments(width, scale), "dim long, n long, s long, high long, low long"), ["dim"], ["n", "s", "high", "low"])
    if not spread:
        return None
    variance = {r.dim: int(r.n) * ((int(r.high) << 32) + int(r.low)) - int(r.s) ** 2 for r in spread}
    order = np.array(sorted(variance, key=lambda d: (-variance[d], d)))
    named = _slim(vectors, F.col("vec_id").cast("long").alias("vec_id")).mapInArrow(_first(width, scale), "vec_id long, parts array<long>")
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = named.select(drawn.alias("h"), "parts").orderBy("h", "parts").limit(clusters).collect()
    centroids = np.array([r.parts for r in seeds], np.int64)
    for _ in range(rounds):
        step = _summed(slim.mapInArrow(_sums(Model(centroids, order), width, scale), "cluster long, dim long, n long, s long"), ["cluster", "dim"], ["n", "s"])
        moved = centroids.copy()
        for r in step:
            if r.n:
                moved[r.cluster, r.dim] = int(r.s) // int(r.n)
        if (moved == centroids).all():
            break
        centroids = moved
    return Model(centroids, order)


def _assigned(model: Model, names: list[str], width: int, scale: int):
    def assign(batches):
        for batch, rows, points in _pieces(batches, width, scale):
            which, best = nearest(points, model)
            pick = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pick) for n in names), pa.array(which, pa.int32()), pa.array(best, pa.int64())], [*names, *(f.name for f in CHOICE)])

    return assign


def assigned(vectors: DataFrame, model: Model, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """The kept rows of vectors with __km_cluster and __km_distance."""
    added = [f.name for f in CHOICE]
    vectors = vectors.drop(*added)
    safe, names = shielded(vectors, "embedding")
    safe = _slim(safe, *[n for n in names if n != "embedding"]).select(names)
    return safe.mapInArrow(_assigned(model, names, width, scale), T.StructType(safe.schema.fields + CHOICE)).toDF(*vectors.columns, *added)


def _of_cluster(values: list, kind: str):
    return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)


def clustered(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector."""
    spark = vectors.sparkSession
    slim = vectors.select("vec_id", "embedding")
    model = fit(slim, **settings)
    if model is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    shape = {k: v for k, v in settings.items() if k in ("width", "scale")}
    rows = assigned(slim, model, **shape).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("__km_cluster").alias("cluster"), F.col("__km_distance").alias("distance"))
    rows = keep(rows, "centroid-clustering")
    found = {r.cluster: int(r.distance) for r in _summed(rows, ["cluster"], ["distance"])}
    inertia = [found.get(k, 0) for k in range(len(model.centroids))]
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in model.centroids]
    return rows.select("*", _of_cluster(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), _of_cluster(names, "string").alias("centroid_sha256"))


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _rounds(rounds: int = ROUNDS) -> str:
    """Each round as two more table expressions: distances to the last centroids, and their means."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (
  SELECT row, c, sum((p.x - m.x) * (p.x - m.x)) AS distance FROM p JOIN c{r} m USING (dim) GROUP BY row, c
), a{r} AS (
  SELECT row, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{r} GROUP BY row
)""")
        if r < rounds:
            steps.append(f"""s{r} AS (
  SELECT c, dim, sum(x) AS s, count(*) AS n FROM a{r} JOIN p USING (row) GROUP BY c, dim
), c{r + 1} AS (
  SELECT c, dim, coalesce((s - ((s % n) + n) % n) // n, m.x) AS x FROM c{r} m LEFT JOIN s{r} USING (c, dim)
)""")
    return ", ".join(steps)


ORACLE_SQL = {
    "op13_centroid_clustering": f"""
WITH k AS (
  SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {WIDTH}
), p AS (
  SELECT row, unnest(range({WIDTH})) AS dim, floor({SCALE} * unnest(embedding)::DOUBLE)::HUGEINT AS x FROM k
), first AS (
  SELECT row, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), embedding) - 1 AS c FROM k QUALIFY c < {CLUSTERS}
), c0 AS (
  SELECT c, dim, x FROM first JOIN p USING (row)
), {_rounds()}, h AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c
)
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN k USING (row) JOIN h USING (c)
"""
}
