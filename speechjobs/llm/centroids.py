"""Centroid clustering: Lloyd rounds by two trees.

Vectors are cut into blocks where they lie, without a shuffle, and each block gets a cover tree once: the children of a
node have centres more than half its radius apart and hold what is within that of them, the first one around the node's
own centre; what no child of the first MOST_CHILDREN covers stays together in one more. Nodes keep the sum of their
vectors. Blocks are written to the shared folder, and each round meets them with a tree of the centroids: a pair of nodes
goes when even its nearest points are farther apart than the farthest ones of another pair. A node with one centroid left
gives its sum as a whole; where both are leaves, all distances are worked out in whole numbers. A task gives one row of
sums a centroid, so a round moves a few rows; only the centroids come to the driver.

Defined results: vectors that are null, of another length, or hold a null or non-finite component go; null ids are
clustered, and come last where the first centroids are chosen; repeated rows are vectors of their own; with fewer vectors
than centroids there are as many as vectors; components of any size are compared and summed exactly, and a distance
beyond 2^63 - 1 is given as that; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

K, ROUNDS, DIM, SCALE, SEED = 16, 3, 64, 64, 1
BLOCK, LEAF, MOST_CHILDREN = 4096, 32, 32
PLAIN = 1 << 21  # below this, sums of squares are exact in doubles
LIMB = 40
LONGEST = (1 << 63) - 1


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): doubles while exact sums of squares allow, else Python integers."""
    v = np.floor(values * float(SCALE))
    return v if not v.size or np.abs(v).max() < PLAIN else np.array([[int(x) for x in row] for row in v], object)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows, as integers of 64 bits or of any size."""
    if a.dtype == object or b.dtype == object:
        return np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q, strict=True)) for q in b] for p in a], object)
    return np.rint((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows as doubles, from exact squares."""
    return np.sqrt(squares(a, b).astype(float))


class CoverTree:
    """Nodes as lists: centre (row), radius, rows as a range of `order`, children."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, n = points, len(points)
        self.order = np.arange(n, dtype=np.int32)
        self.centre, self.radius, self.begin, self.end, self.children = [0], [0.0], [0], [n], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            begin, end = self.begin[node], self.end[node]
            rows = self.order[begin:end]
            away = _near(points[[self.centre[node]]], points[rows])[0]
            self.radius[node] = radius = float(away.max())
            if end - begin <= leaf or radius == 0:
                continue
            parts, left, centre = [], rows, self.centre[node]
            while len(left) and len(parts) < MOST_CHILDREN:
                inside = (away if left is rows else _near(points[[centre]], points[left])[0]) <= radius / 2
                if inside.any():
                    parts.append((centre, left[inside]))
                    left = left[~inside]
                else:  # the rest of a wide node lies around a centre that is not in it
                    left = left.copy()
                centre = left[0] if len(left) else None
            # Without a child of many points a split tells nothing.
            if max(len(p) for _, p in parts) <= leaf // 8 and len(left) > leaf:
                continue
            if len(left):
                parts.append((self.centre[node], left))
            at = begin
            for c, p in parts:
                self.order[at : at + len(p)] = p
                self.children[node].append(len(self.centre))
                if len(p) < len(rows):
                    todo.append(len(self.centre))
                for column, value in ((self.centre, int(c)), (self.radius, 2 * radius), (self.begin, at), (self.end, at + len(p)), (self.children, [])):
                    column.append(value)
                at += len(p)
        self.ball = np.array(self.radius)

    def rows(self, node: int) -> np.ndarray:
        return self.order[self.begin[node] : self.end[node]]


def assign(vectors: CoverTree, centroids: CoverTree):
    """(node, centroid) for whole nodes and (rows, centroids) for leaves that more than one centroid may reach."""
    whole, leaves = [], []
    todo = [(0, np.zeros(1, int))]
    middles = centroids.points[centroids.centre]
    while todo:
        node, pairs = todo.pop()
        here, ball, children = vectors.points[[vectors.centre[node]]], vectors.radius[node], vectors.children[node]
        while True:
            away, balls = _near(here, middles[pairs])[0], centroids.ball[pairs]
            farthest = (away + balls).min() + ball
            pairs = pairs[away - balls - ball <= farthest * (1 + 1e-9) + 1e-9]
            # The larger ball is split; with a leaf of vectors, all of them.
            wide = [p for p in pairs.tolist() if centroids.children[p] and (not children or centroids.radius[p] >= ball)]
            if not wide:
                break
            pairs = np.array([q for p in pairs.tolist() for q in (centroids.children[p] if p in wide else [p])])
        if len(pairs) == 1 and centroids.end[pairs[0]] - centroids.begin[pairs[0]] == 1:
            whole.append((node, int(centroids.rows(pairs[0])[0])))
        elif children:
            todo += [(c, pairs) for c in children]
        else:
            leaves.append((vectors.rows(node), np.sort(np.concatenate([centroids.rows(p) for p in pairs.tolist()]))))
    return whole, leaves


def _numbers(centroids: list[list[int]]) -> np.ndarray:
    big = any(abs(x) >= PLAIN for c in centroids for x in c)
    return np.array(centroids, object if big else float)


def _sums(rows: np.ndarray) -> list[int]:
    return [int(x) for x in rows.sum(0)]


def _blocks(batches):
    """A block of vectors with its tree and the sums of its nodes."""
    for b in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
        points = whole_numbers(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
        tree = CoverTree(points, LEAF)
        sums = [_sums(points[tree.rows(i)]) for i in range(len(tree.centre))]
        if points.dtype != object and np.abs(points).max() < 1 << 15:
            tree.points = points.astype(np.int16)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((b.column(0).to_pylist(), vars(tree), sums))], pa.binary())], names=["block"])


def _read(batches):
    for b in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        ids, state, sums = pickle.loads(b.column(0)[0].as_py())
        tree = CoverTree.__new__(CoverTree)
        vars(tree).update(state)
        if tree.points.dtype == np.int16:
            tree.points = tree.points.astype(float)
        yield ids, tree, sums


def _limbs(value: int) -> list[int]:
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & (1 << LIMB) - 1)
        value >>= LIMB
    return [*out, value]


def _round(centroids: list[list[int]]):
    """Rows of a task: centroid, limb, number of vectors, sums."""

    def run(batches):
        tree, counts = CoverTree(_numbers(centroids), 1), [0] * len(centroids)
        totals = [[0] * DIM for _ in centroids]

        def add(c, n, sums):
            counts[c] += n
            totals[c] = [a + b for a, b in zip(totals[c], sums, strict=True)]

        for _, vectors, sums in _read(batches):
            whole, leaves = assign(vectors, tree)
            for node, c in whole:
                add(c, vectors.end[node] - vectors.begin[node], sums[node])
            for rows, near in leaves:
                points = vectors.points[rows]
                nearest = near[squares(points, tree.points[near]).argmin(1)]
                for c in np.unique(nearest).tolist():
                    add(c, int((nearest == c).sum()), _sums(points[nearest == c]))
        out = []
        for c, n in enumerate(counts):
            limbs = [_limbs(x) for x in totals[c]]
            for i in range(max(map(len, limbs)) if n else 0):
                out.append((c, i, n if i == 0 else 0, [x[i] if i < len(x) else 0 for x in limbs]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["cluster", "limb", "n", "sums"])

    return run


def _last(centroids: list[list[int]]):
    def run(batches):
        tree = CoverTree(_numbers(centroids), 1) if centroids else None
        for ids, vectors, _ in _read(batches):
            cluster, distance = np.zeros(len(ids), np.int32), np.zeros(len(ids), object)
            whole, leaves = assign(vectors, tree)
            for rows, near in [*((vectors.rows(node), np.array([c])) for node, c in whole), *leaves]:
                away = squares(vectors.points[rows], tree.points[near])
                nearest = away.argmin(1)
                cluster[rows], distance[rows] = near[nearest], away[np.arange(len(rows)), nearest]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cluster), pa.array([min(int(x), LONGEST) for x in distance], pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def kept_vectors(embeddings: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, embedding of vectors with `dim` finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") == dim) & finite)


def cluster_vectors(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector."""
    spark = embeddings.sparkSession
    ensure_checkpoint_dir(spark)
    kept = kept_vectors(embeddings)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(order.asc_nulls_last(), "embedding").limit(k).collect()
    centroids = [[int(x) for x in row] for row in whole_numbers(np.array([r["embedding"] for r in first], float).reshape(-1, DIM))]
    blocks = kept.mapInArrow(_blocks, "block binary").checkpoint()
    for _ in range(rounds if centroids else 0):
        parts = blocks.mapInArrow(_round(centroids), "cluster int, limb int, n long, sums array<long>")
        totals = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(DIM))).collect()
        for c in {r["cluster"] for r in totals}:
            mine = [r for r in totals if r["cluster"] == c]
            n = sum(r["n"] for r in mine)
            centroids[c] = [sum(r[f"s{i}"] << LIMB * r["limb"] for r in mine) // n for i in range(DIM)]
    done = blocks.mapInArrow(_last(centroids), "vec_id long, cluster int, distance long").checkpoint()
    wide = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["d"]) for r in done.groupBy("cluster").agg(wide.alias("d")).collect()}
    facts = [(c, min(d, LONGEST), min(sum(inertia.values()), LONGEST), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round_sql(i: int) -> str:
    """Assignment to the centroids of round i, and the centroids after it."""
    return f"""
a{i} AS (
  SELECT id, v, num, d FROM (
    SELECT id, v, num, d, row_number() OVER (PARTITION BY id ORDER BY d, num) AS nth FROM (
      SELECT id, v, num, list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::BIGINT AS d FROM kept, c{i}))
  WHERE nth = 1),
c{i + 1} AS (
  SELECT num, coalesce(n, c) AS c FROM c{i} LEFT JOIN (
    SELECT num, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY j) AS n FROM (
      SELECT num, j, sum(x)::BIGINT AS s, count(*) AS m FROM (SELECT num, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY num, j) GROUP BY num) USING (num))"""


OP13_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS num, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT 16)),
{",".join(_round_sql(i) for i in range(ROUNDS + 1))}
SELECT kept.vec_id, a.num::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.num))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN kept USING (id) JOIN c{ROUNDS} c USING (num)
"""
