"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Fit: on a bounded sample of vectors, principal axes and a rotation that brings
their coordinates close to +-1 (alternating: signs, then the best rotation by a
singular value decomposition); several such rotations give a longer code. The
search radius is the smallest one that finds the target share of a sample of
queries' true neighbours among the sample.

Index: every vector's code, cut into substrings; in each block of vectors the
substrings' different values are sorted, with the vectors that have each.

Search: where r = a x substrings + b, a code within radius r of the query's has one
of the first b + 1 substrings within a of the query's, or one of the others within
a - 1 (pigeonhole). Probing all values that near in each substring finds every code
within r; their whole distance is checked and
those that pass are ranked by the inner product of the original vectors. A query
that finds too few that way is searched again with a radius of all bits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import Workspace, table

#: Fit on at most FIT_ROWS vectors, calibrate on at most CALIBRATION_QUERIES of them.
FIT_ROWS, CALIBRATION_QUERIES = 4096, 256
ROTATIONS, ROUNDS, SUBSTRING = 4, 20, 64
NEAREST, QUERY_EVERY, TARGET = 20, 20, 0.985
ROW_BLOCK, QUERY_BLOCK = 8192, 4096
#: Hits of a query from about so many blocks of rows are cut to the nearest before all of them meet.
MERGED = 64


@dataclass
class Codes:
    mean: np.ndarray
    axes: np.ndarray  # dimensions x bits
    radius: int


def encode(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Codes as substrings of SUBSTRING bits (uint64)."""
    bits = (x - mean) @ axes > 0
    pad = -bits.shape[1] % SUBSTRING
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.uint16)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return out


def fit(sample: np.ndarray, seed: int = 1) -> Codes:
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0) if len(sample) else np.zeros(sample.shape[1])
    x, d = sample - mean, sample.shape[1]
    pca = np.linalg.eigh(x.T @ x)[1][:, ::-1] if len(sample) else np.eye(d)
    v, axes = x @ pca, []
    for _ in range(ROTATIONS):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(ROUNDS if len(sample) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        axes.append(pca @ r)
    axes = np.concatenate(axes, axis=1)
    q = sample[:CALIBRATION_QUERIES]
    if len(sample) <= NEAREST:
        return Codes(mean, axes, axes.shape[1])
    score = q @ sample.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argpartition(-score, NEAREST - 1, axis=1)[:, :NEAREST]
    codes = encode(sample, mean, axes)
    found = np.sort(np.take_along_axis(distances(codes[: len(q)], codes), near, axis=1).ravel())
    return Codes(mean, axes, int(found[min(len(found) - 1, int(np.ceil(TARGET * len(found))))]))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, by the same additions wherever the rows lie."""
    return np.einsum("ij,ij->i", q, x)


def top_rows(query_rows, rows, vec_ids, scores, k: int):
    """Of each query the k best rows: largest score, ties to the smaller vec_id, then row."""
    order = np.lexsort((rows, vec_ids, -scores, query_rows))
    q = query_rows[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    order = order[rank < k]
    return query_rows[order], rows[order], vec_ids[order], scores[order]


class Block:
    """The index of one block of vectors: for each substring its different values and who has them."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, codes: np.ndarray) -> None:
        self.rows, self.ids, self.x, self.codes = rows, ids, x, codes
        self.values, self.holders, self.ends = [], [], []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, start = np.unique(codes[order, j], return_index=True)
            self.values.append(values)
            self.holders.append(order)
            self.ends.append(np.r_[start, len(order)])

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within radius."""
        (near, rest), seen = divmod(radius, len(code)), np.zeros(len(self.ids), bool)
        for j, values in enumerate(self.values):
            hit = np.bitwise_count(values ^ code[j]).astype(int) <= near - (j > rest)
            marks = np.repeat(hit, np.diff(self.ends[j]))
            seen[self.holders[j][marks]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.uint16) <= radius]

    def search(self, query_rows, q, codes, radius: int, k: int):
        out = []
        for i in range(len(query_rows)):
            near = self.within(codes[i], radius)
            near = near[self.rows[near] != query_rows[i]]
            score = self.x[near] @ q[i]
            if len(near) > k:  # all that may tie with the k-th go on to exact scores
                near = near[score >= np.partition(score, len(near) - k)[len(near) - k] - 1e-9 * (1 + np.abs(score).max())]
            exact = exact_scores(np.broadcast_to(q[i], (len(near), q.shape[1])), self.x[near])
            out.append(top_rows(np.full(len(near), query_rows[i]), self.rows[near], self.ids[near], exact, k))
        return [np.concatenate(c) for c in zip(*out)]


HITS = "query_row long, row long, vec_id long, score double"


def searcher(model: dict, k: int):
    """For applyInArrow over (query block, row block): the best rows of the block for each query."""

    def run(rows: pa.Table) -> pa.Table:
        codes = Codes(**model)
        x = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        own, ids, ask = rows["row"].to_numpy(), rows["vec_id"].to_numpy(), rows["is_query"].to_numpy()
        packed = encode(x, codes.mean, codes.axes)
        block = Block(own[~ask], ids[~ask], x[~ask], packed[~ask])
        if not ask.any() or ask.all():
            found = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        else:
            found = block.search(own[ask], x[ask], packed[ask], codes.radius, k)
        return pa.table([pa.array(c) for c in found], names=[f.split()[0] for f in HITS.split(", ")])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the vectors that take part: an id, no null or non-finite component, not zero."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.select("vec_id", e.alias("embedding")).where(F.col("vec_id").isNotNull() & fine & F.exists("embedding", lambda v: v != 0))


def nearest(vectors: DataFrame, ws: Workspace, *, k: int = NEAREST, every: int = QUERY_EVERY, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each vector whose vec_id is divisible by `every` the k nearest others found.

    Nearest: largest inner product; ties to the smaller vec_id. Queries lie in
    blocks of about query_block, vectors in blocks of about row_block, dealt by
    a hash; every block of vectors is sent once for each block of queries, and
    returns k rows at most for each query. A query with fewer than k hits from
    all blocks is asked again without a radius, so that it has k rows, or all
    others if there are fewer.

    Vectors are compared with those of their own dimension, each of which has
    codes of its own; those that usable() leaves out take no part. Rows with the
    same vec_id are vectors of their own: each asks, and is found by the others.
    Only vec_id and embedding are read. An empty table gives an empty one.
    """
    rows = ws.save(usable(vectors).withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.size("embedding")), "vectors")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n, count in sorted(tuple(r) for r in rows.groupBy("n").count().collect()):  # a row for each dimension
        out = out.union(nearest_of(rows.where(F.col("n") == n).drop("n"), count, ws, f"dim-{n}", k, every, row_block, query_block))
    return out


def nearest_of(rows: DataFrame, count: int, ws: Workspace, name: str, k: int, every: int, row_block: int, query_block: int) -> DataFrame:
    """nearest() for `count` vectors of one dimension (row, vec_id, embedding)."""
    sample = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(FIT_ROWS).select("embedding").toPandas()  # at most FIT_ROWS rows
    model = fit(np.stack(sample["embedding"].to_numpy()))
    row_blocks = -(-count // row_block)

    def hits(queries: DataFrame, n_q: int, model: Codes) -> DataFrame:
        query_blocks = max(1, -(-n_q // query_block))
        queries = queries.withColumn("is_query", F.lit(True))
        queries = queries.withColumn("q_block", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int")).withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        others = rows.withColumn("is_query", F.lit(False)).withColumn("r_block", F.pmod(F.xxhash64(F.col("row") + 1), F.lit(row_blocks)).cast("int"))
        others = others.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        both = queries.unionByName(others)
        return both.groupBy("q_block", "r_block").applyInArrow(searcher(vars(model), k), HITS)

    queries = rows.where(F.col("vec_id") % every == 0)
    found = ws.save(hits(queries, queries.count(), model), f"found-{name}")
    enough = found.groupBy(F.col("query_row").alias("row")).count().where(F.col("count") >= k).select("row")
    short = ws.save(queries.join(enough, "row", "left_anti").select(*rows.columns), f"short-{name}")
    n_short = short.count()
    if n_short:  # all bits: exact, and holds what the first search found
        again = hits(short, n_short, replace(model, radius=model.axes.shape[1]))
        found = found.join(enough.withColumnRenamed("row", "query_row"), "query_row", "left_semi").unionByName(again)
    best = best_of(best_of(found, k, -(-row_blocks // MERGED)), k)
    best = best.groupBy("query_row").agg(F.sort_array(F.collect_list(F.struct("less", "vec_id", "row"))).alias("best"))  # k rows
    out = best.join(queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id")), "query_row").select("query_id", F.posexplode("best").alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.less")).alias("score"))


def best_of(found: DataFrame, k: int, groups: int = 1) -> DataFrame:
    """query_row, less (the score, negative), vec_id, row: each query's k nearest in each of so many groups of rows."""
    rows = found if "less" in found.columns else found.withColumn("less", -F.col("score"))
    by = ["query_row", F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")]
    top = rows.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list(F.struct("less", "vec_id", "row"))), 1, k).alias("best"))
    return top.select("query_row", F.explode("best").alias("b")).select("query_row", "b.*")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), Workspace(spark, "op3"))
