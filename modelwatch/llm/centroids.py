"""K-means over integer vectors by kd-tree filtering.

Every partition's vectors are cut into blocks, and each block becomes a kd-tree that is
written once: its vectors in tree order, and for every node its box and integer sums (counts
follow from the block's size, as every node is halved). A round sends the centroids to all
trees. From the root on a node keeps the centroids that may own one of its vectors; one that
is farther than another from every point of the node's box is pruned. A node with one
centroid left gives its count and sums as they are, and what still has several at a leaf is
settled vector by vector. Rounds exchange a row a task and centroid.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelwatch.llm.shared import Scratch, arrow_schema, trim

BLOCK = 4096  # vectors of a tree
LEAF = 32  # vectors of a leaf at most
FILE_TREES = 32  # trees of a file, which bounds what a reader holds

_TREE = "ids binary, vectors binary, low binary, high binary, sums binary"


def limit(dimensions: int, bits: int = 62) -> int:
    """Components up to this size give distances, and sums of products on the way, of less than 2**bits."""
    return 1 << (bits - 1 - dimensions.bit_length()) // 2


# -- trees ------------------------------------------------------------------------------


def levels(n: int) -> list[np.ndarray]:
    """Where the nodes of each level begin, with n at the end: every node is halved until none has more than LEAF vectors."""
    out = [np.array([0, n])]
    while (size := np.diff(out[-1])).max() > LEAF:
        both = np.empty(2 * len(size) + 1, np.int64)
        both[::2], both[1::2] = out[-1], out[-1][:-1] + size // 2
        out.append(both)
    return out


def grown(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, high, sums) of a kd-tree over the rows of x; nodes level by level, each cut across its widest side."""
    order, cuts = np.arange(len(x)), levels(len(x))
    for at in cuts[:-1]:
        rows = x[order]
        wide = (np.maximum.reduceat(rows, at[:-1]).astype(np.int64) - np.minimum.reduceat(rows, at[:-1])).argmax(1)
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = order[np.lexsort((rows[np.arange(len(rows)), wide[node]], node))]
    rows = x[order]
    boxes = [(np.minimum.reduceat(rows, at[:-1]), np.maximum.reduceat(rows, at[:-1]), np.add.reduceat(rows.astype(np.int64), at[:-1])) for at in cuts]
    return order, *(np.concatenate(c) for c in zip(*boxes, strict=True))


def pruned(low: np.ndarray, high: np.ndarray, open_: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """open_ [nodes, centroids] without those that another one beats at every point of the node's box.

    The rival of a node is the open centroid nearest to its middle. Of the box's points the
    one farthest along the way from the rival to a centroid suits this centroid best; if the
    rival is nearer even there, the centroid owns nothing in the box. Ties keep both.
    """
    middle = (low.astype(float) + high) / 2
    away = (centers.astype(float) ** 2).sum(1) - 2 * middle @ centers.T.astype(float)
    rival = np.where(open_, away, np.inf).argmin(1)
    out, square = open_.copy(), (centers**2).sum(1)
    for r in np.unique(rival):
        mine = np.flatnonzero(rival == r)
        way = centers - centers[r]
        best = high[mine].astype(centers.dtype) @ np.maximum(way, 0).T - low[mine].astype(centers.dtype) @ np.maximum(-way, 0).T
        out[mine] &= (square[r] - square + 2 * best >= 0) | (np.arange(len(centers)) == r)
    return out


def assigned(x: np.ndarray, low: np.ndarray, high: np.ndarray, centers: np.ndarray):
    """(node, first, last, centroid) of whole nodes, then (rows, centroids) of the vectors settled one by one."""
    # Products of doubles are exact while sums stay below 2**53, and much faster.
    kind = float if max(np.abs(centers).max(), np.abs(low).max(), np.abs(high).max()) <= limit(x.shape[1], 51) else np.int64
    z, cuts = centers.astype(kind), levels(len(x))
    whole, open_, at = [], np.ones((1, len(z)), bool), 0
    alive = np.zeros(1, np.int64)
    for depth, edge in enumerate(cuts):
        keep = pruned(low[at + alive], high[at + alive], open_, z)
        sole = keep.sum(1) == 1
        whole += [(at + k, edge[k], edge[k + 1], c) for k, c in zip(alive[sole].tolist(), keep[sole].argmax(1).tolist(), strict=True)]
        alive, open_ = alive[~sole], keep[~sole]
        if depth + 1 < len(cuts):
            alive, open_ = np.repeat(2 * alive, 2) + np.tile([0, 1], len(alive)), np.repeat(open_, 2, 0)
        at += len(edge) - 1
    rows = np.concatenate([np.arange(cuts[-1][k], cuts[-1][k + 1]) for k in alive.tolist()] or [np.zeros(0, np.int64)])
    if not len(rows):
        return whole, rows, rows
    leaf = np.repeat(np.arange(len(alive)), np.diff(cuts[-1])[alive])
    away = (z**2).sum(1) - 2 * (x[rows].astype(kind) @ z.T)
    far = np.inf if kind is float else np.iinfo(np.int64).max
    return whole, rows, np.where(open_[leaf], away, far).argmin(1)


def planted(vectors: DataFrame, dimensions: int) -> DataFrame:
    """_TREE of (id, v): a tree for each BLOCK vectors of a partition, and one for what is left."""
    schema = arrow_schema(_TREE)

    def tree(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        order, low, high, sums = grown(x)
        cells = (ids[order], x[order], low, high, sums)
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells], schema=schema)

    def run(batches):
        ids, x = np.zeros(0, np.int64), np.zeros((0, dimensions), np.int32)
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dimensions)
            ids, x = np.concatenate([ids, batch.column("row").to_numpy()]), np.concatenate([x, values])
            while len(ids) >= BLOCK:
                yield tree(ids[:BLOCK], x[:BLOCK])
                ids, x = ids[BLOCK:], x[BLOCK:]
        if len(ids):
            yield tree(ids, x)
        trim()

    return vectors.select("row", "v").mapInArrow(run, _TREE)


def _trees(batches, dimensions: int):
    """(ids, vectors, low, high, sums) of each tree."""
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("ids", "vectors", "low", "high", "sums")), strict=True):
            ids, sums = np.frombuffer(row[0], np.int64), np.frombuffer(row[4], np.int64)
            yield ids, *(np.frombuffer(c, np.int32).reshape(-1, dimensions) for c in row[1:4]), sums.reshape(-1, dimensions)


# -- rounds -----------------------------------------------------------------------------


def cluster_sums(trees: DataFrame, centers: np.ndarray) -> DataFrame:
    """(cluster, n, s0, s1, ...): count and sums of what belongs to each centroid; a row a task and centroid goes through the shuffle."""
    k, dimensions = centers.shape
    names = [f"s{i}" for i in range(dimensions)]
    ddl = ", ".join(["cluster int", "n long", *(f"{s} long" for s in names)])
    schema = arrow_schema(ddl)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for _, x, low, high, sums in _trees(batches, dimensions):
            whole, rows, of = assigned(x, low, high, centers)
            for node, first, last, c in whole:
                count[c] += last - first
                total[c] += sums[node]
            count += np.bincount(of, minlength=k)
            np.add.at(total, of, x[rows])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *(pa.array(total[some, i]) for i in range(dimensions))], schema=schema)
        trim()

    return trees.mapInArrow(run, ddl).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names))


def memberships(trees: DataFrame, centers: np.ndarray) -> DataFrame:
    """(row, cluster, distance) of every vector."""
    schema = arrow_schema("row long, cluster int, distance long")

    def run(batches):
        for ids, x, low, high, _ in _trees(batches, centers.shape[1]):
            whole, rows, of = assigned(x, low, high, centers)
            cluster = np.empty(len(x), np.int32)
            for _, first, last, c in whole:
                cluster[first:last] = c
            cluster[rows] = of
            apart = x.astype(np.int64) - centers[cluster]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cluster), pa.array((apart * apart).sum(1))], schema=schema)
        trim()

    return trees.mapInArrow(run, "row long, cluster int, distance long")


def clusters(rows: DataFrame, key: str = "vec_id", column: str = "embedding", dimensions: int = 64, scale: int = 64, k: int = 16, rounds: int = 3) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of exactly ``dimensions`` components, none of them null, not finite or,
    as an integer, beyond ``limit`` in size (2**27 for 64 dimensions); what isn't kept has no row. Components become
    floor(scale * x). Centroids start as the k vectors with the smallest sha256 of
    ``1:<key>``, equal ones by their components, those without key last; with fewer vectors
    there are fewer. A vector at the same distance from several centroids belongs to that of
    the smallest number. Repeated rows and rows that share a key are each clustered and
    answered. Sums that no long holds are null. An empty table gives an empty table; other
    columns are dropped. Centroids, k rows of sums and k inertias are all that the driver sees.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    x = F.col(column)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    ok = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= limit(dimensions) / scale))
    kept = rows.where(F.coalesce(ok, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), whole.alias("v"))
    kept = scratch.save(kept.select("row", "id", F.col("v").cast("array<int>").alias("v")), "kept")
    first = kept.select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    kind = dict(rows.dtypes)[key]
    if not first:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centers = np.array([r["v"] for r in first], np.int64)
    planted(kept, dimensions).write.option("maxRecordsPerFile", FILE_TREES).parquet(scratch.path("trees"))
    trees = spark.read.schema(_TREE).parquet(scratch.path("trees"))
    for _ in range(rounds):
        for r in cluster_sums(trees, centers).collect():  # k rows
            centers[r["cluster"]] = [s // r["n"] for s in r[2:]]
    found = scratch.save(memberships(trees, centers), "found")
    wide = F.col("s").cast("decimal(38,0)")
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).select("cluster", wide.alias("s")).collect()}  # k rows
    fits = lambda n: n if n < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest()
    told = spark.createDataFrame([(c, fits(s), fits(sum(per.values())), digest(c)) for c, s in per.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    named = found.join(kept.select("row", F.col("id").alias(key)), "row")
    return named.join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """Every kept vector's cluster after three rounds from sixteen vectors."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql(k: int, rounds: int) -> str:
    parts = []
    for t in range(rounds + 1):
        parts.append(f"d{t} AS (SELECT r, c, sum((v - z) * (v - z)) AS d FROM part JOIN z{t} USING (i) GROUP BY r, c), a{t} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{t} GROUP BY r)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM part JOIN a{t} USING (r) GROUP BY c, i), z{t + 1} AS (SELECT c, i, CASE WHEN n IS NULL THEN z ELSE (s - ((s % n) + n) % n) // n END AS z FROM z{t} LEFT JOIN m{t} USING (c, i))")
    return ", ".join(parts)


SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
part AS (SELECT r, i, CAST(floor(64 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v FROM kept, range(1, 65) t(i)),
seed AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), r) - 1 AS c FROM kept QUALIFY c < 16),
z0 AS (SELECT c, i, v AS z FROM part JOIN seed USING (r)),
{_rounds_sql(16, 3)},
named AS (SELECT c, sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY i)) AS h FROM z3 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a3 JOIN kept USING (r) JOIN named USING (c)
"""
