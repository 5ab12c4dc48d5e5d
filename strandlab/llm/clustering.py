"""Centroid clustering of vectors in exact integers: Lloyd's rounds with squared distances by matrix products.

Vectors become whole numbers, floor(scale * x).  Distances of a block of vectors to all centroids are the expansion
|x|^2 - 2 x.c + |c|^2 with one float64 matrix product.  The block's and the centroids' magnitudes bound every partial sum
by dims * (max|x| + max|c|)^2; below 2^53 the float64 results are exact whatever the order of summation, beyond that the
block is computed in 64-bit or, if needed, unbounded integers.  So ties and floors are exact and reruns agree.

Scale: vectors are written once as binary blocks (two bytes a component if they fit, more where needed).  A round is one
pass over the blocks; each task adds up sums and counts by centroid, and treeAggregate combines these (k * dims whole
numbers a task) in levels, so neither the driver nor a task gets more of them with more tasks.  Nothing is shuffled by
cluster, so one cluster may hold all vectors.  Centroids (k * dims numbers) ship with the tasks.

Defined results: vectors of another length, with a null or non-finite component, and null vectors are left out; a null
id hashes as an empty one; repeated ids and vectors are rows of their own, and equal hashes are ordered by the vectors;
fewer kept vectors than k give as many centroids; sums that don't fit a long are null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import bounded_batches, staged, table

#: Whole numbers below this are exact in float64.
EXACT = 1 << 53
DIMS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024


def whole(flat: np.ndarray, scale: int = SCALE) -> tuple[str, bytes]:
    """floor(scale * x) of finite numbers: the kind of integer that holds them all, and their bytes ("text": decimals)."""
    with np.errstate(over="ignore"):
        v = np.floor(flat * float(scale))
    top = float(np.abs(v).max(initial=0.0))
    for kind, bits in (("<i2", 15), ("<i4", 31), ("<i8", 62)):
        if top < 2.0**bits:
            return kind, v.astype(kind).tobytes()
    exact = [int(n) if math.isfinite(n) else int(x) * scale for n, x in zip(v.tolist(), flat.tolist(), strict=True)]
    return "text", ",".join(map(str, exact)).encode()


def block(kind: str, raw: bytes, dims: int) -> np.ndarray:
    """The block's vectors as rows of int64, or of Python integers where those don't fit."""
    if kind == "text":
        return np.array([int(x) for x in bytes(raw).split(b",")], dtype=object).reshape(-1, dims)
    return np.frombuffer(raw, dtype=kind).reshape(-1, dims).astype(np.int64)


def _top(x) -> int:
    return int(max(abs(x.max()), abs(x.min()))) if x.size else 0


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's nearest centroid (ties: the smaller) and the squared distance, exactly."""
    c = np.array(centroids, dtype=object)
    bound = x.shape[1] * (_top(x) + _top(c)) ** 2
    rows = np.arange(len(x))
    if bound < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        far = (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)
        at = far.argmin(axis=1)
        return at, far[rows, at].astype(np.int64)
    kind = np.int64 if bound < 1 << 63 else object
    a = x.astype(kind)
    far = np.stack([((a - row) ** 2).sum(axis=1) for row in c.astype(kind)], axis=1)
    at = np.array([min(range(len(c)), key=lambda j, r=r: (r[j], j)) for r in far], dtype=np.int64) if kind is object else far.argmin(axis=1)
    return at, far[rows, at]


def cluster_sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """k rows of dims sums and a count, as Python integers."""
    kind = np.int64 if len(x) * _top(x) < 1 << 63 else object
    out = np.zeros((k, x.shape[1] + 1), dtype=object)
    for j in np.unique(at).tolist():
        own = x[at == j]
        out[j, :-1] = own.astype(kind).sum(axis=0).tolist()
        out[j, -1] = len(own)
    return out


def moved(centroids: list[list[int]], sums: np.ndarray) -> list[list[int]]:
    """Floors of the means; empty clusters stay."""
    return [[s // row[-1] for s in row[:-1]] if row[-1] else old for old, row in zip(centroids, sums.tolist(), strict=True)]


def _aggregated(blocks: DataFrame, dims: int, shape: tuple, add) -> np.ndarray:
    rows = blocks.select("kind", "block").rdd.map(lambda r: block(r[0], r[1], dims))
    return rows.treeAggregate(np.zeros(shape, dtype=object), lambda total, x: total + add(x), lambda a, b: a + b)


def _fits(n: int) -> int | None:
    return n if n < 1 << 63 else None


def centroid_clusters(vectors: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of the kept rows of vectors (vec_id,
    embedding).  The first centroids are the k vectors with the smallest sha256 of seed:vec_id."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(F.col("x").isNotNull() & (F.size("x") == dims) & F.coalesce(finite, F.lit(False)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()  # k rows
    empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], empty)
    centroids = [[int(v) for v in block(*whole(np.array(r["x"], dtype=np.float64), scale), dims)[0]] for r in first]
    packed = pa.schema([("ids", pa.list_(pa.int64())), ("kind", pa.string()), ("block", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                kind, raw = whole(b.column(1).flatten().to_numpy(zero_copy_only=False), scale)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_pylist()], packed[0].type), pa.array([kind]), pa.array([raw], pa.binary())], schema=packed)

    blocks = staged(kept.mapInArrow(pack, "ids array<long>, kind string, block binary"), "blocks")
    for _ in range(rounds):
        last = centroids
        centroids = moved(last, _aggregated(blocks, dims, (len(last), dims + 1), lambda x, c=last: cluster_sums(x, nearest(x, c)[0], len(c))))
        if centroids == last:
            break  # every further round gives the same

    def inertia(x: np.ndarray) -> np.ndarray:
        at, far = nearest(x, centroids)
        out = np.zeros(len(centroids), dtype=object)
        for j in np.unique(at).tolist():
            out[j] = sum(far[at == j].tolist())
        return out

    own = [int(v) for v in _aggregated(blocks, dims, (len(centroids),), inertia)]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in empty.split(", ")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, kind, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, far = (v.tolist() for v in nearest(block(kind, raw, dims), centroids))
                out = [ids, at, [_fits(v) for v in far], [_fits(own[j]) for j in at], [_fits(sum(own))] * len(at), [digest[j] for j in at]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return blocks.mapInArrow(assign, empty)


def clusters(spark, sf_dir: str) -> DataFrame:
    """op11: all vectors of 64 finite components in 8 clusters after 10 rounds."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    steps = []
    for r in range(ROUNDS + 1):
        nearest_ = f"SELECT r, far, c FROM (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x)) AS far FROM v JOIN c{r} c ON c.i = v.i GROUP BY v.r, c.c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1"
        steps.append(f"a{r} AS MATERIALIZED ({nearest_})")
        if r < ROUNDS:
            floor = "CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT)"
            steps.append(f"m{r} AS (SELECT c, i, {floor} AS x FROM (SELECT a.c, v.i, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v ON v.r = a.r GROUP BY a.c, v.i))")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c AND m.i = c.i)")
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
v AS MATERIALIZED (SELECT r, i, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIMS + 1}) t(i)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c FROM kept QUALIFY c < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT f.c, v.i, v.x FROM first f JOIN v ON v.r = f.r),
{", ".join(steps)},
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS d FROM c{ROUNDS} GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.far AS BIGINT) AS distance, CAST(sum(a.far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.far) OVER () AS BIGINT) AS inertia, d.d AS centroid_sha256
FROM a{ROUNDS} a JOIN kept k ON k.r = a.r JOIN digest d ON d.c = a.c"""


ORACLE = _oracle()
