"""Contiguous shards of near equal bytes, by global prefix sums.

Rows are ordered by doc_id and dealt into ranges of it. The ranges' totals, a row each, are summed up in order, and a
row's place in the corpus is its range's start plus the sum inside the range. The corpus is cut at equal targets:
a row belongs to the shard in which its first byte lies, so that shards differ from the target by less than one row at either
end, whatever the rows' sizes and however many rows a source or a text has. A text of a third of the corpus is one row and
fills its shard. Equal texts go where their doc_ids are.

Law: `bytes`. Defined cases: a null text has no bytes; null doc_ids come first; rows of one doc_id are ordered by size and
checksum, and are interchangeable beyond that (they are dealt into ranges by where they were read, so that no id is too
large for a range); an empty table gives no rows; other columns are kept unless they have a result's name, and then
the result's stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import table, written
from tastegrid.llm.spelling import CRC_TABLE, crc_sql

OVERHEAD = 16
#: Rows of a range, about; more ranges than these would make their table of totals large.
RANGE_ROWS, MOST_RANGES = 1 << 18, 10_000
OWN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the size and checksum of each text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.drop(*OWN).withColumns({"size": (F.octet_length(whole) + OVERHEAD).cast("long"), "text_crc32": F.crc32(whole.cast("binary"))})


def shards(rows: DataFrame, n_shards: int, ranges: int | None = None) -> DataFrame:
    """measured rows with law, shard, slot (the place in the shard, from 0) and grown_shard (null: this law has none)."""
    if ranges is None:
        ranges = max(min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES), min(MOST_RANGES, rows.count() // RANGE_ROWS))
    order: list[Column] = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, F.col("_read"))
    dealt = written(dealt.withColumn("_range", F.spark_partition_id()), "shard-rows")
    totals = dealt.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("k"))
    w = Window.orderBy("_range")  # a row for each range
    starts = written(totals.select("_range", (F.sum("b").over(w) - F.col("b")).alias("_b"), (F.sum("k").over(w) - F.col("k")).alias("_k"), F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total")), "shard-starts")
    inside = Window.partitionBy("_range").orderBy(*order, "_read").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumns({"_at": F.sum("size").over(inside) - F.col("size"), "_n": F.row_number().over(inside) - 1})
    placed = placed.join(F.broadcast(starts), "_range")  # at most MOST_RANGES rows
    shard = F.expr(f"int((_b + _at) * {int(n_shards)} div _total)")
    placed = written(placed.withColumns({"shard": shard, "_n": F.col("_k") + F.col("_n")}).drop("_range", "_read", "_at", "_b", "_k", "_total"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("_n").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").withColumns({"law": F.lit("bytes"), "slot": F.col("_n") - F.col("_first"), "grown_shard": F.lit(None).cast("int")}).drop("_n", "_first")


def write_shards(docs: DataFrame, n_shards: int, path: str, file_bytes: int = 256 << 20) -> None:
    """The documents themselves as Parquet, one folder a shard, in files of about file_bytes whose rows are in order."""
    placed = shards(measured(docs), n_shards)
    run = Window.partitionBy("shard").orderBy("_chunk")
    chunk = placed.withColumn("_chunk", F.expr("slot div 1024"))
    files = chunk.groupBy("shard", "_chunk").agg(F.sum("size").alias("b")).withColumn("_file", (F.sum("b").over(run) / file_bytes).cast("int")).drop("b")
    out = chunk.join(files, ["shard", "_chunk"]).repartition("shard", "_file").sortWithinPartitions("shard", "slot")
    out.drop("_chunk", "_file").write.partitionBy("shard").parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sizes = written(measured(docs).drop("text"), "shard-sizes")  # the texts are read once, the ranges drawn from this
    return shards(sizes, 40).select("doc_id", *OWN)


OP12_SQL = f"""
WITH {CRC_TABLE}, sized AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + {OVERHEAD} AS BIGINT) AS size, CAST({crc_sql("coalesce(text, '')")} AS BIGINT) AS text_crc32 FROM documents, crc_table
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS at_byte, sum(size) OVER () AS total FROM sized
), cut AS (SELECT *, CAST(at_byte * 40 // total AS INTEGER) AS shard FROM summed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut"""
