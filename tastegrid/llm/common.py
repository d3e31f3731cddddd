"""What the operators of this subpackage share: scratch tables, connected components, Arrow columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.sources.tables import ship  # noqa: F401

_OWN: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the cluster names in spark.checkpoint.dir.

    Where that setting is empty (tests, a laptop) a temporary folder of this process is used, which only a
    local master can share with its tasks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    if not base:
        base = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tastegrid-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder and read from there.

    This cuts lineage: a lost executor costs the reread of a few files, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")  # once the table is written, its shuffle files are of no more use
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more; what was computed from them is written, too."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floats_matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list column as a float32 matrix; shorter rows are padded with zeros."""
    lengths = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim), np.float32)
    at = 0
    for i, n in enumerate(lengths):
        out[i, : min(n, dim)] = flat[at : at + min(n, dim)]
        at += n
    return out


def usable_vector(name: str):
    """Not null, and every component a finite number."""
    v = F.col(name)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, bound to a name by transform() over one element."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's batches that have rows; memory is given back before the first and after the last."""
    give_back()
    for b in rows:
        if b.num_rows:
            yield b
    give_back()


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the smallest node reachable.

    edges has the columns a and b of one orderable type; nodes without an edge have no row.
    Every round sends a node to the smallest of its neighbours and itself, and on from there once more, and
    contracts the edges to those nodes; what is left shrinks from round to round, by half the nodes or better.
    A chain that is longer than that keeps an edge to its next node. Each round's labels and edges are tables
    in the shared folder.
    """
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = written(edges.select(*ordered("a", "b")).filter("a <> b").distinct(), f"{name}-edges")
    labels = None
    for _ in range(max_rounds):
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        first = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("to")), f"{name}-first")
        # node, where its smallest neighbour goes, and where that one goes
        hop = first.join(first.select(F.col("node").alias("to"), F.col("to").alias("root")), "to").select("node", "root")
        hop = hop.join(first.select(F.col("node").alias("root"), F.col("to").alias("next")), "root").select("node", "root", "next")
        hop = written(hop, f"{name}-hop")
        chains = hop.filter("root <> next").select(*ordered("root", "next"))
        moved = left.join(hop.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(hop.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        rest = written(moved.select(*ordered("x", "y")).union(chains).filter("a <> b").distinct(), f"{name}-edges")
        step = hop.select("node", "root")
        if labels is None:
            labels = written(step, f"{name}-labels")
        else:
            far = step.select(F.col("node").alias("root"), F.col("root").alias("_r"))
            before, labels = labels, written(labels.join(far, "root", "left").select("node", F.coalesce("_r", "root").alias("root")), f"{name}-labels")
            drop(before)
        drop(left, first, hop)
        left = rest
        if left.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
