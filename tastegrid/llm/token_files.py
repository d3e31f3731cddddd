"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

A file set is a folder of Parquet files; each row is one block: the shard and place in it, the
documents' ids, and a binary payload `magic, id width, boundaries, ids`. The boundaries are the
running counts of ids, Elias-Fano encoded (elias_fano.py): select gives a document's offset
without a table of 64-bit offsets. Shards are ranges of doc_id, so that blocks in order of (shard,
seq) hold all documents in ascending doc_id order; a shard's first id is the sum of the shards
before it, one row a shard.

Defined cases: a null text is empty and gets only the end id; null doc_ids come first; rows of one
doc_id are in order of text. An empty table writes no block. Other columns are ignored. A special
token's string in a text is encoded as that token, as the library does by default.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, scratch_dir, table
from tastegrid.llm.elias_fano import EliasFano
from tastegrid.llm.pieces import IdStore, chunks, cut

MAGIC = b"TGEF"
BLOCKS = "shard int, seq int, shard_start long, n_docs int, n_tokens long, doc_ids array<long>, payload binary"
_STORES: dict[str, IdStore] = {}


class _PieceTokenizer:
    """Ids of pieces from the tokenizers library.

    Pieces that start with a space and end otherwise are encoded many at a time, put one after
    another: nothing is merged over such a border, and the ids' byte lengths tell where each ends.
    """

    def __init__(self, path: str, run: int = 256):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.t, self.run = Tokenizer.from_file(path), run
        self.bytes_of = np.zeros(max(self.t.get_vocab().values()) + 1, np.int64)
        for token, i in self.t.get_vocab().items():  # byte-level: one character a byte
            self.bytes_of[i] = len(token)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.t.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), np.uint32, int(lengths.sum())), lengths

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joins = np.fromiter((p[:1] == " " and not p[-1].isspace() for p in pieces), bool, len(pieces))
        led, rest = np.flatnonzero(joins), np.flatnonzero(~joins)
        own = [pieces[i] for i in led.tolist()]
        ids, _ = self.ids(["".join(own[at : at + self.run]) for at in range(0, len(own), self.run)])
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in own), np.int64, len(own)))
        upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends, "left") + 1
        ids2, lengths2 = self.ids([pieces[i] for i in rest.tolist()])
        lengths = np.zeros(len(pieces), np.int64)
        lengths[led], lengths[rest] = np.diff(upto, prepend=0), lengths2
        if not len(rest):
            return ids, lengths
        out, places = np.empty(len(ids) + len(ids2), np.uint32), np.repeat(joins, lengths)
        out[places], out[~places] = ids, ids2
        return out, lengths


def _store(path: str) -> IdStore:
    if path not in _STORES:
        _STORES[path] = IdStore(_PieceTokenizer(path))
    return _STORES[path]


def encode(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each followed by end_id, and the number of each text's ids."""
    store = _store(path)
    pieces, codes, first = cut(texts)
    ids, lengths = store.gather(store.codes(pieces)[codes], first)
    if end_id is None:
        return ids, lengths
    last = np.cumsum(lengths + 1) - 1
    out = np.full(len(ids) + len(lengths), end_id, np.uint32)
    body = np.ones(len(out), bool)
    body[last] = False
    out[body] = ids
    return out, lengths + 1


def to_payload(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 2**16 else 4
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(lengths)]))
    return b"".join((MAGIC, bytes([width, 0, 0, 0]), bounds.to_bytes(), ids.astype(f"<u{width}").tobytes()))


def from_payload(payload: bytes) -> tuple[EliasFano, np.ndarray]:
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    view = memoryview(payload)
    bounds, used = EliasFano.from_bytes(view[8:])
    return bounds, np.frombuffer(payload, f"<u{payload[4]}", offset=8 + used)


def document_ids(payload: bytes, i: int) -> np.ndarray:
    """The ids of a block's document i, end id included, from two selects."""
    bounds, ids = from_payload(payload)
    return ids[bounds[i] : bounds[i + 1]]


def _encode(rows: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    shard, seq, start = TaskContext.get().partitionId(), 0, 0
    for b in batches(rows):
        for c in chunks(b, 1):
            ids, lengths = encode(c.column(1), path, end_id)
            row = [[shard], [seq], [start], [c.num_rows], [len(ids)], [c.column(0)], [to_payload(ids, lengths)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0].to_pylist()] if isinstance(x[0], pa.Array) else x, k) for x, k in zip(row, kinds, strict=True)], names=["shard", "seq", "shard_start", "n_docs", "n_tokens", "doc_ids", "payload"])
            seq, start = seq + 1, start + len(ids)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write docs' (doc_id, text) as token-id files below path, a location that Spark can write."""
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    d.mapInArrow(lambda rows: _encode(rows, tokenizer_path, end_id), BLOCKS).write.parquet(path)


def _decode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        for r in range(b.num_rows):
            shard, base, doc_ids, payload = (b.column(k)[r] for k in range(4))
            bounds, ids = from_payload(payload.as_py())
            at, raw = np.fromiter(map(bounds.__getitem__, range(bounds.n)), np.int64, bounds.n), memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(crc), pa.int32()), doc_ids.values, pa.array(at[:-1] + base.as_py()), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""
    blocks = spark.read.parquet(path)
    base = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    base = base.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    rows = blocks.select("shard", "shard_start", "doc_ids", "payload").mapInArrow(_decode, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(base, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_digests(spark, path)
