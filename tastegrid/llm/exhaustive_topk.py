"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse integer vectors. Candidates are packed into blocks that hold one posting list per
term (the block's rows with a weight other than zero). A query scatters weight x posting into a
dense array of scores, term by term, a partition selection keeps the block's k best, and the blocks'
lists are merged. Every query meets every candidate: a grid of groups (candidate groups by query
groups) decides which task compares which blocks, so that no side is broadcast.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, nor does a
row without id; an empty vector scores 0 with all. Rows with a query's id are never its candidates. Ties go to the smaller
id; repeated candidate rows each count; a repeated query row gets a list of its own. Vectors of
unequal length are compared on the terms they share. An empty table gives an empty result. Other
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, table, usable_vector, written

BLOCK_ROWS = 1024
PACKED = "block long, ids binary, dim int, width int, weights binary"


def quantised(vectors: DataFrame, vec_col: str, scale: float, out: str = "weights") -> DataFrame:
    """floor(scale * x) of each component, in double precision, as integers."""
    return vectors.filter(usable_vector(vec_col)).withColumn(out, F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def _narrow(m: np.ndarray) -> np.ndarray:
    top = int(np.abs(m).max()) if m.size else 0
    return m.astype(np.int8 if top < 2**7 else np.int16 if top < 2**15 else np.int64)


def _pack(rows: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """(id, weights) rows into blocks, ids ascending in each, weights by term and then row."""
    part, n = TaskContext.get().partitionId(), 0
    for b in batches(rows):
        col = b.column(1)
        lengths = np.diff(col.offsets.to_numpy())
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, starts, out = b.column(0).to_numpy(), np.concatenate([[0], np.cumsum(lengths)]), []
        for lo in range(0, b.num_rows, block_rows):
            rows_in = range(lo, min(lo + block_rows, b.num_rows))
            dim = int(lengths[rows_in.start : rows_in.stop].max())
            m = np.zeros((len(rows_in), dim), np.int64)
            for k, i in enumerate(rows_in):
                m[k, : lengths[i]] = flat[starts[i] : starts[i + 1]]
            order = np.argsort(ids[rows_in.start : rows_in.stop], kind="stable")
            w = _narrow(np.ascontiguousarray(m[order].T))
            out.append(((part << 32) | n, ids[rows_in.start : rows_in.stop][order].astype("<i8").tobytes(), dim, w.itemsize, w.tobytes()))
            n += 1
        a = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.int64()), pa.array(a[1], pa.binary()), pa.array(a[2], pa.int32()), pa.array(a[3], pa.int32()), pa.array(a[4], pa.binary())], names=["block", "ids", "dim", "width", "weights"])


def _unpack(ids: bytes, dim: int, width: int, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(weights, {1: np.int8, 2: np.int16, 8: np.int64}[width]).reshape(dim, len(i))


def accumulate(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Scores (query, row): each term's query weights scattered over that term's posting list."""
    terms = min(len(queries), len(postings))
    bound = sum(int(np.abs(queries[t].astype(np.int64)).max(initial=0)) * int(np.abs(postings[t].astype(np.int64)).max(initial=0)) for t in range(terms))
    kind = np.int32 if bound < 2**31 else np.int64
    acc = np.zeros((queries.shape[1], postings.shape[1]), kind)
    for t in range(terms):
        rows, asked = np.flatnonzero(postings[t]), np.flatnonzero(queries[t])
        q, w = queries[t].astype(kind), postings[t].astype(kind)
        if len(rows) * len(asked) > acc.size // 3:  # a long list: adding its zeros too is cheaper than the index
            acc += q[:, None] * w[None, :]
        elif len(rows) and len(asked):
            acc[np.ix_(asked, rows)] += q[asked][:, None] * w[rows][None, :]
    return acc


def best(scores: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of scores (ids ascending by column), and whether the place is filled."""
    n = scores.shape[1]
    k = min(k, n)
    key = scores.astype(np.int64)
    wide = np.abs(key).max(initial=0) >= 2**62 // max(n, 1)
    blocked = ids[None, :] == own[:, None]
    if wide:
        order = np.lexsort((np.broadcast_to(np.arange(n), key.shape), -key, blocked), axis=1)[:, :k]
    else:
        key = key * n + (n - 1 - np.arange(n))[None, :]
        key[blocked] = np.iinfo(np.int64).min
        order = np.argpartition(-key if n == k else key, n - k if n > k else 0, axis=1)[:, -k:]
    rows = np.arange(len(scores))[:, None]
    return scores[rows, order].astype(np.int64), ids[order], ~blocked[rows, order]


def _search(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    held = None  # (query block, its ids, weights, scores, ids of the best so far, filled)

    def flush():
        q, own, _, s, i, ok = held
        at, _ = np.nonzero(ok)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), q), pa.int64()), pa.array(at.astype(np.int32), pa.int32()), pa.array(own[at], pa.int64()), pa.array(i[ok], pa.int64()), pa.array(s[ok], pa.int64())],
            names=["q_block", "q_row", "query_id", "vec_id", "score"],
        )

    for b in batches(rows):
        c = {n: b.column(j) for j, n in enumerate(b.schema.names)}
        for r in range(b.num_rows):
            if held is None or held[0] != c["q_block"][r].as_py():
                if held is not None:
                    yield flush()
                own, qw = _unpack(*(c[f"q_{n}"][r].as_py() for n in ("ids", "dim", "width", "weights")))
                none = np.zeros((len(own), 0), np.int64)
                held = (c["q_block"][r].as_py(), own, qw, none, none, none.astype(bool))
            ids, w = _unpack(*(c[n][r].as_py() for n in ("ids", "dim", "width", "weights")))
            q, own, qw, s, i, ok = held
            s2, i2, ok2 = best(accumulate(qw, w), ids, k, own)
            s, i, ok = np.hstack([s, s2]), np.hstack([i, i2]), np.hstack([ok, ok2])
            order = np.lexsort((i, -s, ~ok), axis=1)[:, :k]
            at = np.arange(len(own))[:, None]
            held = (q, own, qw, s[at, order], i[at, order], ok[at, order])
    if held is not None:
        yield flush()


def exhaustive_topk(candidates: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", weights_col: str = "weights", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of largest integer inner product.

    Both inputs have id_col (long) and weights_col (array of long). The grid has a group for each
    65,536 candidates and 8,192 queries (8 by 2 at least); a task holds one block of either side
    at a time, so memory does not depend on the tables' sizes.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        df = df.filter(F.col(id_col).isNotNull() & F.col(weights_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(weights_col).cast("array<long>"))
        return written(df.mapInArrow(lambda rows: _pack(rows, block_rows), PACKED), name)

    c, q = packed(candidates, "topk-candidates"), packed(queries, "topk-queries")
    n_c, n_q = (x.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 8 for x in (c, q))
    c_groups, q_groups = max(8, math.ceil(n_c / 65536)), max(2, math.ceil(n_q / 8192))
    c = c.withColumn("cg", F.pmod(F.xxhash64("block"), F.lit(c_groups))).withColumn("qg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_groups - 1).cast("long"))))
    q = q.select(*(F.col(n).alias(f"q_{n}") for n in q.columns)).withColumn("qg", F.pmod(F.xxhash64("q_block"), F.lit(q_groups)))
    q = q.withColumn("cg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_groups - 1).cast("long"))))
    pairs = q.join(c.hint("shuffle_hash"), ["cg", "qg"]).drop("cg", "qg")
    found = pairs.mapInArrow(lambda rows: _search(rows, k), "q_block long, q_row int, query_id long, vec_id long, score long")
    w = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return exhaustive_topk(v, v.filter(F.col("vec_id") % 20 == 0), 20)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
