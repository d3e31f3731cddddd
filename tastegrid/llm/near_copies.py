"""Near copies by exact similarity, for thresholds that fingerprints alone can't reach (simhash.near_dedup).

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more. Texts of equal shingle sets are one node. Candidates come from two sides: fingerprints within three
bits, by way of their anchors, and BANDS = 32 bands of ROWS = 6 MinHash values, which miss a pair of 0.8
with a probability of at most (1 - 0.8 ** 6) ** 32 = 6e-5. Every link is verified on the exact sets.

First each node of a bucket is compared with the bucket's head, the node with the most company in all its
buckets, and so is each fingerprint with those its anchors link; these are pairs in number of the bucket's
nodes. Where a bucket of three or more still has nodes of different components, all its nodes go, once each,
to the cluster of such buckets, and pairs across components that share a band are compared inside tasks, of
which only links that join components come out. Clusters are dealt into chunks of CHUNK shingles, and tasks
compare two chunks, so that a cluster of any size fits; no pair is skipped and no bucket is cut.

Defined cases: null texts count as empty; texts without words are copies of each other; fewer than five
words form one shingle. Rows without doc_id stay. Words are cut at ASCII white space, A-Z in lower case.
An empty table stays empty; repeated rows of one id leave one; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, components, drop, written
from tastegrid.llm.simhash import majority, near_links

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 6
CHUNK = 1 << 19
_PIECE = 128
_rng = np.random.default_rng(11)
_ODD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * _ODD


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    lo, hi = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 5) for a, b in zip(lo, hi, strict=True)), np.uint64, n))


def _key(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 11)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band, from BANDS * ROWS MinHash values of a set of hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    x = own ^ (own >> np.uint64(31))
    for at in range(0, len(x), _PIECE):
        y = np.multiply.outer(x[at : at + _PIECE], _ODD)
        y += _ADD
        y ^= y >> np.uint64(32)
        np.minimum(least, y.min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), j) for j, b in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def _sketches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to (doc_id, key, fp, n, bands): the set's key, its fingerprint, its size and its bands' keys."""
    for b in batches(rows):
        keys, fps, sizes, bands = [], [], [], []
        for t in b.column(1):
            own = shingle_set(t.as_py() or b"")
            keys.append(_key(own))
            fps.append(majority(own))
            sizes.append(len(own))
            bands.append(band_keys(own).view(np.int64) if len(own) else np.zeros(0, np.int64))
        at = np.cumsum([0, *map(len, bands)]).astype(np.int32)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), signed(keys), signed(fps), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(bands)))], names=["doc_id", "key", "fp", "n", "bands"])


def _sets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to (key, own), those whose text has that key (a doc_id can stand for several texts)."""
    for b in batches(rows):
        keys = b.column(0).to_numpy().view(np.uint64).tolist()
        got = [(k, own.tobytes()) for k, t in zip(keys, b.column(1), strict=True) if _key(own := shingle_set(t.as_py() or b"")) == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([k for k, _ in got], np.uint64).view(np.int64)), pa.array([s for _, s in got], pa.binary())], names=["key", "own"])


def _similar(rows: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
            keep.append(both >= least * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (b.column(0), b.column(1))], names=["a", "b"])


def _joined(rows: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, i, j, chunk, key, part, bands, own), those of a cluster's chunk pair (i, j) together: the parts that links join."""

    def links(held):
        chunk, part = (np.array([x[k] for x in held]) for k in (3, 5))
        bands = np.array([x[6] for x in held], np.int64)
        sets = [np.frombuffer(x[7], np.uint64) for x in held]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        at = np.concatenate([[0], np.cumsum(size)])
        code, flat = np.unique(np.concatenate(sets), return_inverse=True)
        mark, root = np.zeros(len(code), bool), {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        i, j = held[0][1], held[0][2]
        for a in np.flatnonzero(chunk == i).tolist():
            other = (chunk == j) & (part != part[a]) & (np.minimum(size, size[a]) >= least * np.maximum(size, size[a]))
            other[: a + 1] &= i != j  # within one chunk each pair once
            some = np.flatnonzero(other)
            some = some[(bands[some] == bands[a]).any(axis=1)]
            if not len(some):
                continue
            mark[flat[at[a] : at[a + 1]]] = True
            held_codes = np.concatenate([flat[at[x] : at[x + 1]] for x in some.tolist()])
            both = np.add.reduceat(mark[held_codes], np.concatenate([[0], np.cumsum(size[some])[:-1]]), dtype=np.int64)
            mark[flat[at[a] : at[a + 1]]] = False
            for x in some[both >= least * (size[a] + size[some] - both)].tolist():
                p, q = find(part[a]), find(part[x])
                if p != q:
                    root[p] = q
                    yield part[a], part[x]

    def out(held):
        got = list(links(held))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.int64()), pa.array([y for _, y in got], pa.int64())], names=["a", "b"])

    held: list[tuple] = []
    for b in batches(rows):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:3] != held[-1][:3]:
                yield out(held)
                held = []
            held.append(row)
    if held:
        yield out(held)


def verified_parts(docs: DataFrame, nodes: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(node, root) of nodes (key, first, fp, n, bands) by the links to heads, and (a, b) of roots that other links join.

    Together their components are those of all candidates with the similarity.
    """

    def sets_of(keys: DataFrame, name: str) -> DataFrame:
        texts = docs.join(nodes.select("key", F.col("first").alias("doc_id")).join(keys, "key"), "doc_id").select("key", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
        return written(texts.mapInArrow(_sets, "key long, own binary").dropDuplicates(["key"]), name)

    bands = nodes.select("key", F.explode("bands").alias("band"))
    met = written(bands.join(bands.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1"), "band"), "near-met")
    company = met.groupBy("key").agg(F.sum("m").alias("company"))
    heads = met.join(company, "key").groupBy("band").agg(F.max(F.struct("company", "key")).alias("h")).select("band", F.col("h.key").alias("head"))
    met = written(met.join(heads, "band"), "near-headed")
    stars = met.filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))

    by_print = written(nodes.filter("n > 0").groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("m")), "near-prints")
    alike = nodes.join(by_print.filter("m > 1").select("fp", "head"), "fp").filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    of = lambda c: by_print.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    anchored = near_links(by_print.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    pairs = stars.union(alike).union(anchored).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "near-stars")
    sets = sets_of(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "near-sets")
    p = pairs.join(sets.select(F.col("key").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("own").alias("y")), "b")
    links = written(p.select("a", "b", "x", "y").mapInArrow(lambda rows: _similar(rows, least), "a long, b long"), "near-first")
    drop(pairs, by_print, sets)

    part = components(links, "near-part")
    none = links.limit(0)
    own = written(met.filter("m > 2").join(part.withColumnRenamed("node", "key"), "key", "left").select("band", "key", "head", F.coalesce("root", "key").alias("part")), "near-own")
    drop(met)
    open_ = own.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("band")
    rest = written(own.join(open_, "band").select("key", "head", "part"), "near-rest")
    drop(own)
    if rest.isEmpty():
        return part, none
    # clusters of open buckets: every part is in one, whatever the number of its nodes and buckets
    at_head = rest.filter("key = head").select("head", F.col("part").alias("head_part")).distinct()
    cluster = components(rest.select("head", "part").distinct().join(at_head, "head").select(F.col("part").alias("a"), F.col("head_part").alias("b")), "near-clusters")
    inside = rest.select("key", "part").distinct().join(cluster.withColumnRenamed("node", "part"), "part").join(nodes.select("key", "n", "bands"), "key")
    inside = written(inside, "near-inside")
    chunks = inside.groupBy("root").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    dealt = inside.join(chunks, "root").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).join(sets_of(inside.select("key"), "near-inside-sets"), "key")
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("root", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "key", "part", "bands", "own")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "key")
    more = written(dealt.mapInArrow(lambda rows: _joined(rows, least), "a long, b long"), "near-second")
    drop(rest, inside)
    return part, more


def near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: that with the group's smallest doc_id."""
    d = docs.filter(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = d.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    sketches = written(texts.mapInArrow(_sketches, "doc_id long, key long, fp long, n int, bands array<long>"), "near-sketches")
    repeated = not sketches.groupBy("doc_id").count().filter("count > 1").isEmpty()  # an id given to several rows
    nodes = written(sketches.groupBy("key").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bands").alias("bands")), "near-nodes")
    drop(sketches)
    part, more = verified_parts(d.select("doc_id", "text"), nodes, least)
    joined = components(more, "near") if not more.isEmpty() else more.select(F.col("a").alias("node"), F.col("b").alias("root"))
    rooted = nodes.select("key", "first").join(part.withColumnRenamed("node", "key"), "key", "left").select("first", F.coalesce("root", "key").alias("node"))
    rooted = rooted.groupBy("node").agg(F.min("first").alias("first")).join(joined, "node", "left")
    kept = written(rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("doc_id")).select("doc_id").distinct(), "near-kept")
    drop(nodes)
    out = docs.join(kept, "doc_id", "left_semi")
    out = out.dropDuplicates(["doc_id"]) if repeated else out
    return out.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)
