"""SimHash near-dedup with anchor points taken from a covering code.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit in one of
their 32-bit halves. The low 31 bits of a half are a word of the space that the perfect Hamming
code (31, 26) covers with radius 1, so its codewords are the anchors: a fingerprint x lies within 1
of exactly one anchor, its home, and y within distance 1 of x lies within 1 + 1 = 2 of that home.
Every fingerprint is therefore replicated to all anchors within radius plus threshold (one if it is
a codeword, else its home and the 15 at distance two), and is compared at each anchor with those
at home there. No link between different fingerprints is lost. Copies share a fingerprint and are
folded into one row first. At an anchor only a spanning forest of the links leaves the task. An
anchor with more than HOT_HOMES homes, or OTHERS times as many rows, is split both ways: its homes are
dealt into chunks and so are all its rows, and each chunk of homes meets each chunk of rows.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like
any other; one or two words form one shingle. A null doc_id keeps its row; component_id is the
smallest doc_id that is not null. Repeated rows each keep a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, components, drop, table, written

HOT_HOMES, OTHERS = 8192, 8
_PIECE = 1 << 15


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    lo, hi = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(lo[at : at + _PIECE], hi[at : at + _PIECE], strict=False)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of some hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        counts += np.unpackbits(hashes[at : at + _PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(rows: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return d.mapInArrow(lambda rows: _fingerprints(rows, shingle), "doc_id long, fp long")


def _syndrome(x: Column) -> Column:
    """The XOR of the positions 1..31 of the bits set: zero for codewords, else the bit to flip."""
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        total = total + F.shiftleft((F.bit_count(x.bitwiseAND(F.lit(mask))) % 2), k)
    return total


def anchors(fps: DataFrame) -> DataFrame:
    """(anchor, fp, home): a row for each anchor within two of either half's low 31 bits."""
    halves = fps.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    x = F.when(F.col("half") == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(2**31 - 1))
    h = halves.select("fp", "half", x.alias("x")).withColumn("s", _syndrome(F.col("x")))
    flip = lambda i: F.expr(f"shiftleft(1L, {i})")
    h = h.withColumn("home", F.when(F.col("s") == 0, F.col("x")).otherwise(F.col("x").bitwiseXOR(flip("s - 1"))))
    pairs = F.expr("CASE WHEN s = 0 THEN array() ELSE transform(filter(sequence(1, 31), i -> i < (i ^ s)), i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1)) END")
    all_ = F.concat(F.array("home"), pairs)
    e = h.select("fp", "half", "home", F.explode(all_).alias("a"))
    return e.select((F.shiftleft(F.col("half").cast("long"), 31) + F.col("a")).alias("anchor"), "fp", (F.col("a") == F.col("home")).alias("home"))


def forest(fps: np.ndarray, home: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between homes and all others at an anchor, as index pairs."""
    out: list[tuple[int, int]] = []
    free = np.arange(len(fps))
    while len(free):
        todo, free = [int(free[0])], free[1:]
        while todo and len(free):
            i = todo.pop()
            near = np.bitwise_count(fps[free] ^ fps[i]) <= threshold
            if not home[i]:
                near &= home[free]
            if near.any():
                got, free = free[near].tolist(), free[~near]
                out += [(i, j) for j in got]
                todo += got
    return out


def _links(rows: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and salt; the last group of a batch may go on in the next."""

    def out(key, fps, home):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        end = np.append(start[1:], len(key))
        some = np.add.reduceat(home.astype(np.int64), start) > 0
        a, b = [], []
        for lo, hi in zip(start[(end - start > 1) & some].tolist(), end[(end - start > 1) & some].tolist(), strict=True):
            for i, j in forest(fps[lo:hi], home[lo:hi], threshold):
                a.append(lo + i), b.append(lo + j)
        x, y = fps[a].view(np.int64), fps[b].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    held = None
    for b in batches(rows):
        now = (b.column(0).to_numpy() * 1, b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False))
        held = now if held is None else tuple(np.concatenate(x) for x in zip(held, now, strict=True))
        other = np.flatnonzero(held[0] != held[0][-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield out(*(x[:last] for x in held))
            held = tuple(x[last:] for x in held)
    if held is not None:
        yield out(*held)


def near_links(distinct: DataFrame, threshold: int = 3, hot_homes: int = HOT_HOMES) -> DataFrame:
    """(a, b): links among distinct fingerprints; their components are those of all links within threshold <= 3."""
    if not 0 <= threshold <= 3:
        raise ValueError("two halves and radius 1 cover thresholds up to 3")
    rows = anchors(distinct)
    size = rows.groupBy("anchor").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("all"))
    parts = lambda c, most: F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
    hot = size.filter((F.col("homes") > hot_homes) | (F.col("all") > OTHERS * hot_homes) & (F.col("homes") > 0))
    hot = written(hot.select("anchor", parts("homes", hot_homes).alias("hs"), parts("all", OTHERS * hot_homes).alias("os")), "simhash-hot")
    if hot.isEmpty():
        rows = rows.withColumn("key", F.col("anchor"))
    else:
        r = rows.join(hot, "anchor", "left")
        cold = r.filter("hs IS NULL").select(F.col("anchor").alias("key"), "fp", "home")
        r = r.filter("hs IS NOT NULL").withColumns({"h": F.pmod(F.xxhash64("fp"), F.col("hs")).cast("int"), "o": F.pmod(F.xxhash64("fp", F.lit(1)), F.col("os")).cast("int")})
        as_home = r.filter("home").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("os") - 1)))
        as_other = r.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("hs") - 1))).filter("NOT home OR g <> h").withColumn("h", F.col("g")).withColumn("home", F.lit(False)).drop("g")
        at = F.col("anchor") + F.shiftleft((F.col("h") * F.col("os") + F.col("o") + 1).cast("long"), 33)
        rows = cold.unionByName(as_home.unionByName(as_other).select(at.alias("key"), "fp", "home"))
    return rows.select("key", "fp", "home").repartition("key").sortWithinPartitions("key").mapInArrow(lambda r: _links(r, threshold), "a long, b long").distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, threshold: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    fps = written(fingerprints(docs, shingle), "simhash-fp")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = components(near_links(distinct.select("fp"), threshold), "simhash")
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    drop(distinct)
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, shingle: int = 3, threshold: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each group of near copies: that with the group's smallest doc_id.

    Rows without doc_id stay, as no other row can stand for them. With a similarity, texts are linked by the
    Jaccard similarity of their sets of five-word shingles instead of by bits: at 0.8 fingerprints differ in ten
    of 64 bits on average and in up to eighteen, for which no covering code has few anchors, so fingerprints
    within three bits are candidates beside others, and all are verified (near_copies).
    """
    if similarity is not None:
        from tastegrid.llm.near_copies import near_copies

        return near_copies(docs, similarity)
    kept = simhash_components(docs.filter(F.col("doc_id").isNotNull()), shingle, threshold).filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count()
    kept = written(kept, "simhash-kept")
    out = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if not kept.filter("count > 1").isEmpty():  # an id given to several rows
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.filter(F.col("doc_id").isNull())).select(docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
