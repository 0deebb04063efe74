"""Approximate nearest neighbours by cross-polytope hashing.

Three sign flips, each followed by a fast Hadamard transform, turn a unit
vector pseudo-randomly; its bucket is the signed axis it comes nearest to.
Every vector lies in one bucket per table, a query looks into its ``probes``
nearest buckets, and candidates are ranked by their exact cosine.  A bucket of a
table is told by as many hashes as the number of vectors needs for buckets of
about ``BUCKET`` rows, so buckets do not grow with the table; tables and probes
grow with the hashes to hold the recall.

Vectors and queries of a bucket meet in blocks of bounded size on both sides,
so a bucket with a third of all rows is many tasks, no task holds more than a
block of each, and only the best of each block leave it.  Vectors of different
length never meet.  Queries left with too few results, as in tables with few
rows, are compared with all vectors in the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noctule.session import stored

BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
#: Rows that a bucket is meant to hold; beyond these on average another hash tells buckets apart.
BUCKET = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    step = 1
    while step < d:
        pairs = x.reshape(n, -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def signed_axes(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Closeness of each row to every signed axis after the rotation of a table; axis 2i is +i, 2i + 1 is -i."""
    n, d = x.shape
    wide = max(2, 1 << (d - 1).bit_length())
    x = np.hstack([x, np.zeros((n, wide - d))])
    for flip in np.random.default_rng((seed, number, wide)).choice([-1.0, 1.0], (3, wide)):
        x = hadamard(x * flip)
    return np.stack([x, -x], axis=2).reshape(n, 2 * wide)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, d)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part, as (id, v, d): NULL keys or vectors, NULL or non-finite components and zero vectors do not.

    A component's square must be finite too, as a cosine cannot be had without.
    """
    v = F.col(f"`{vector}`")
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"), F.size(v).alias("d")) \
        .where(F.col("id").isNotNull() & (F.col("d") > 0) & ~bad & (size > 0) & (size < float("inf")))


def buckets(near: list[np.ndarray], probes: int) -> np.ndarray:
    """The ``probes`` nearest buckets of each row from its closeness to the axes of each hash, the nearest first.

    A bucket is a tuple of axes, as one number; its distance is what its axes fall short of the nearest ones, squared.
    """
    width = near[0].shape[1]
    if probes == 1:
        return sum(x.argmax(1).astype("i8") * width ** k for k, x in enumerate(near))[:, None]
    most = min(probes, width)
    loss, code = np.zeros((len(near[0]), 1)), np.zeros((len(near[0]), 1), "i8")
    for k, x in enumerate(near):
        axes = np.argsort(-x, axis=1, kind="stable")[:, :most]
        close = np.take_along_axis(x, axes, 1)
        loss = (loss[:, :, None] + ((close[:, :1] - close) ** 2)[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] + (axes.astype("i8") * width ** k)[:, None, :]).reshape(len(x), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        loss, code = np.take_along_axis(loss, best, 1), np.take_along_axis(code, best, 1)
    return code


def hashed(rows: DataFrame, tables: int, probes: int, seed: int, hashes: int = 1) -> DataFrame:
    """One row per table and probe: (t, axis, id, v, d), probes in order of closeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("d").to_numpy()
            for d in np.unique(length):
                part = batch.filter(pa.array(length == d))
                x = matrix(part.column("v"), d)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for t in range(tables):
                    best = buckets([signed_axes(x, t * hashes + k, seed) for k in range(hashes)], probes)
                    rows = part.take(pa.array(np.repeat(np.arange(len(x)), best.shape[1])))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, "i4")), pa.array(best.ravel()), rows.column("id"), rows.column("v"), rows.column("d")],
                        names=["t", "axis", "id", "v", "d"])

    kind = dict(rows.dtypes)["v"]
    return rows.mapInArrow(run, f"t int, axis long, id long, v {kind}, d int")


def needed_hashes(base: DataFrame) -> int:
    """Hashes by which a bucket holds about BUCKET rows at most, all vectors as long as the longest."""
    n, d = base.agg(F.count(F.lit(1)), F.max("d")).first()
    hashes, width = 1, 2 * max(2, 1 << ((d or 1) - 1).bit_length())
    while n > BUCKET * width ** hashes:
        hashes += 1
    return hashes


def best_of_block(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """The k best of a block for each query: coarse by a matrix product, then each kept pair on its own."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(queries) and len(vectors):
            d = queries.column("d")[0].as_py()
            qi, vi = queries.column("id").to_numpy(), vectors.column("id").to_numpy()
            q, v = (matrix(x.column("v").combine_chunks(), d) for x in (queries, vectors))
            qn, vn = (np.sqrt((x * x).sum(1)) for x in (q, v))
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                rough = (q[part] / qn[part, None]) @ (v / vn[:, None]).T
                rough[qi[part, None] == vi[None, :]] = -np.inf
                most = min(k, rough.shape[1])
                edge = -np.partition(-rough, most - 1, axis=1)[:, most - 1]
                i, j = np.nonzero((rough >= edge[:, None] - 1e-9) & np.isfinite(rough))
                for low in range(0, len(i), 65_536):
                    a, b = i[low:low + 65_536] + at, j[low:low + 65_536]
                    score = (q[a] * v[b]).sum(1) / (qn[a] * vn[b])
                    order = np.lexsort((vi[b], -score, a))
                    a, b, score = a[order], b[order], score[order]
                    rank = np.arange(len(a)) - np.searchsorted(a, a)
                    keep = rank < k
                    out.append((qi[a[keep]], vi[b[keep]], score[keep]))
        columns = [np.concatenate([x[n] for x in out]) if out else np.array([], t) for n, t in enumerate(("i8", "i8", "f8"))]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def meet(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Best pairs of the blocks into which the buckets (t, axis, d) are cut."""
    bucket = ["t", "axis", "d"]
    count = lambda rows, name: rows.groupBy(bucket).agg(F.count(F.lit(1)).alias(name))
    sizes = stored(count(vectors, "n_vectors").join(count(queries, "n_queries"), bucket), "ann-buckets")
    sizes = sizes.select(*bucket, F.ceil(F.col("n_vectors") / BLOCK_VECTORS).cast("int").alias("nv"), F.ceil(F.col("n_queries") / BLOCK_QUERIES).cast("int").alias("nq"))
    pick = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = queries.join(sizes, bucket).withColumn("bq", pick(F.col("nq"))).withColumn("bv", every(F.col("nv")))
    right = vectors.join(sizes, bucket).withColumn("bv", pick(F.col("nv"))).withColumn("bq", every(F.col("nq")))
    cell = [*bucket, "bq", "bv"]
    slim = lambda rows: rows.select(*cell, "id", "v")
    return slim(left).groupBy(cell).cogroup(slim(right).groupBy(cell)).applyInArrow(best_of_block(k), "query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5,
           tables: int = 12, probes: int = 8, seed: int = 7, hashes: int | None = None) -> DataFrame:
    """The k nearest rows of ``vectors`` found for every row of ``queries``, by cosine.

    Returns query_id, rank (from 1), vec_id, score; nearest first, ties to the
    smaller vec_id.  A row never answers a query of its own key.  Rows that
    repeat a key count once, with their best score.  More tables and probes
    raise the recall; both are doubled with every hash beyond the first, of
    which there are as many as the number of vectors needs.  Empty tables give
    no rows.
    """
    base, asked = usable(vectors, key, vector), usable(queries, key, vector)
    hashes = hashes or needed_hashes(base)
    more = 2 ** (hashes - 1)
    pairs = meet(hashed(asked, tables * more, probes * more, seed, hashes), hashed(base, tables * more, 1, seed, hashes), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        one = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = stored(ranked(pairs), "ann-found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stored(asked.join(full, "id", "left_anti"), "ann-short")
    if not short.isEmpty():
        whole = lambda rows: rows.select(F.lit(-1).alias("t"), F.lit(-1).cast("long").alias("axis"), "id", "v", "d")
        found = ranked(found.drop("rank").unionByName(meet(whole(short), whole(base), k)))
    return found.select("query_id", "rank", "vec_id", "score")
