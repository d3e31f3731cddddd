"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over distinct words.

A text is split by the pattern into words, and each word's bytes are merged pair by pair, the pair
of the lowest rank first and the leftmost of equals. The merge of a word is one aggregate() over the
array of its pieces' ids: each step takes the least rank of neighbouring pieces, and looks up only
the two pairs that are new. The rank map is a literal: two arrays addressed by the pair of ids (each
pair stands in one of its two places), so that a lookup is two array reads.

Only distinct words are merged. The words of the most chunks of text, at most `common` of them, are
folded by Spark and shared with all tasks (a bound on what is sent, not on what is encoded). The
other words are merged beside the texts, once in each chunk, by the same ranks (merge_word, and a
heap for words of more than 64 bytes, as a fold would take quadratic time): the fold takes some
100 microseconds a word, which for all distinct words of all chunks is over the CPU budget. Decoding
concatenates the ids' binary pieces.

Defined cases: a null text is empty; an empty text has no ids (sha256 of the empty string twice);
repeated rows each keep a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, drop, let, table, written
from tastegrid.llm.pieces import chunks, cut

NONE, LONG, CHUNK = 2**31 - 1, 512, 10 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each piece, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the merged piece by left id * 65536 + right id."""
    if max(ranks.values()) >= 65536:
        raise ValueError("ranks of more than 16 bits")
    out = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                out[a << 16 | b] = rank
    return out


def two_places(pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Two tables in which every pair stands at key mod size of one; an entry is key * 65536 + rank."""
    size = max(7, len(pairs)) | 1
    while True:
        tables = [[-1] * size, [-1] * (size + 2)]
        for key, rank in pairs.items():
            entry, t = key << 16 | rank, 0
            for _ in range(200):
                own = tables[t]
                at = (entry >> 16) % len(own)
                own[at], entry = entry, own[at]
                if entry < 0:
                    break
                t = 1 - t
            else:
                break
        else:
            return tables[0], tables[1]
        size = size * 5 // 4 | 1


def _literal(values: list, kind: str = "bigint") -> Column:
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


class BytePairs:
    """The vocabulary: its rank map as literals for the fold."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        a, b = two_places(pair_ranks(ranks))
        self.sizes = (len(a), len(b))
        self.tables = F.struct(_literal(a).alias("a"), _literal(b).alias("b"), _literal([ranks[bytes([i])] for i in range(256)], "int").alias("bytes"))

    def pair(self, t: Column, left: Column, right: Column) -> Column:
        """Rank of a pair of ids in the tables t, or NONE."""

        def found(key: Column) -> Column:
            def second(e: Column) -> Column:
                return F.when(F.shiftright(e, 16) == key, e.bitwiseAND(F.lit(65535)).cast("int")).otherwise(F.lit(NONE))

            first = lambda e: F.when(F.shiftright(e, 16) == key, e.bitwiseAND(F.lit(65535)).cast("int")).otherwise(let(t["b"][(key % self.sizes[1]).cast("int")], second))
            return let(t["a"][(key % self.sizes[0]).cast("int")], first)

        return let(left.cast("long") * 65536 + right, found)

    def fold(self, t: Column, word: Column) -> Column:
        """The ids of a word (binary): a fold of ranked merges over its bytes."""
        n = F.octet_length(word)
        hexed = lambda h: F.transform(F.sequence(F.lit(0), n - 1), lambda i: t["bytes"][F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")])
        ids = let(F.hex(word), hexed)

        def merge(p: Column, r: Column, least: Column, i: Column) -> Column:
            """Pieces i and i + 1 become `least`; only the pairs beside it are looked up."""
            m, none = F.size(p), F.slice(r, 1, 0)
            left = F.when(i > 1, F.array(self.pair(t, p[i - 2], least))).otherwise(none)
            right = F.when(i + 2 <= m, F.array(self.pair(t, least, p[i + 1]))).otherwise(none)
            pieces = F.concat(F.slice(p, F.lit(1), i - 1), F.array(least), F.slice(p, i + 2, F.greatest(m - i - 1, F.lit(0))))
            around = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, F.greatest(m - i - 2, F.lit(0))))
            return F.struct(pieces.alias("p"), around.alias("r"), F.coalesce(F.array_min(around), F.lit(NONE)).alias("least"))

        def merge_once(s: Column, _: Column) -> Column:
            return F.when(s["least"] == NONE, s).otherwise(let(F.array_position(s["r"], s["least"]).cast("int"), lambda i: merge(s["p"], s["r"], s["least"], i)))

        def begin(p: Column) -> Column:
            r = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: self.pair(t, p[i], p[i + 1]))
            return let(r, lambda r: F.struct(p.alias("p"), r.alias("r"), F.array_min(r).alias("least")))

        folded = let(ids, lambda p: F.aggregate(F.sequence(F.lit(2), F.size(p)), begin(p), merge_once)["p"])
        return F.when(n == 1, ids).when(n > 1, folded).otherwise(F.slice(F.array(F.lit(0)), 1, 0))

    def ids(self, word: Column) -> Column:
        return let(self.tables, lambda t: self.fold(t, word))


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long word: a heap of pairs over a linked list of pieces."""
    piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = [(r, i, len(piece[i]), len(piece[i + 1])) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if piece[i] is not None else len(word)
        if j >= len(word) or len(piece[i]) != a or len(piece[j]) != b:
            continue
        piece[i], piece[j] = piece[i] + piece[j], None
        after[i] = after[j]
        if after[i] < len(word):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(word) and (r := ranks.get(piece[k] + piece[after[k]])) is not None:
                heapq.heappush(heap, (r, k, len(piece[k]), len(piece[after[k]])))
    return [ranks[p] for p in piece if p is not None]


def _distinct(rows: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    find = regex.compile(pattern).findall
    for b in batches(rows):
        for c in chunks(b, 0, CHUNK):
            pieces, codes, _ = cut(c.column(0))
            used = np.bincount(codes, minlength=len(pieces)) > 0
            words = {w for p, u in zip(pieces, used.tolist(), strict=True) if u for w in find(p)}
            yield pa.RecordBatch.from_arrays([pa.array([x for w in words if len(x := w.encode()) <= LONG], pa.binary())], names=["word"])


def common_words(docs: DataFrame, bpe: BytePairs, pattern: str, most: int) -> bytes:
    """The words of the most chunks, at most so many, with their ids from the fold: an Arrow stream of a few MB.

    Of the last number of chunks that no longer fits, a share is taken by hash; words of one chunk gain nothing.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = written(texts.mapInArrow(lambda rows: _distinct(rows, pattern), "word binary").groupBy("word").agg(F.count("*").alias("n")), "bpe-words")
    level = F.least("n", F.lit(1024))
    sizes = {r["level"]: r["k"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()}
    left, wanted = most, F.lit(False)
    for n in sorted(sizes, reverse=True):
        if left <= 0 or n < 2 and len(sizes) > 1:
            break
        share = min(1.0, left / sizes[n])
        wanted = wanted | (level == n) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
        left -= sizes[n]
    top = counts.filter(wanted)
    top = written(top.select("word"), "bpe-common")
    drop(counts)
    spark, key = docs.sparkSession, "spark.sql.maxPlanStringLength"
    was = spark.conf.get(key)
    spark.conf.set(key, "20000")  # the literal map makes megabytes of each description of this plan
    try:
        found = top.repartition(F.col("word")).select("word", bpe.ids(F.col("word")).alias("ids")).toArrow()
    finally:
        spark.conf.set(key, was)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, found.schema) as w:
        w.write_table(found)
    return out.getvalue().to_pybytes()


def _words(stream: bytes) -> dict[str, list[int]]:
    t = pa.ipc.open_stream(stream).read_all()
    return dict(zip((x.decode() for x in t.column("word").to_pylist()), t.column("ids").to_pylist(), strict=True))


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold's merges for one word, beside a task's texts; long words take the heap."""
    if len(word) > 64:
        return heap_merge(word, ranks)
    p = [word[i : i + 1] for i in range(len(word))]
    get = ranks.get
    r = [get(a + b, NONE) for a, b in zip(p, p[1:], strict=False)]
    while r and (least := min(r)) != NONE:
        i = r.index(least)
        p[i : i + 2] = [p[i] + p[i + 1]]
        del r[i]
        if i < len(r):
            r[i] = get(p[i] + p[i + 1], NONE)
        if i:
            r[i - 1] = get(p[i - 1] + p[i], NONE)
    return [ranks[x] for x in p]


def _texts(rows: Iterator[pa.RecordBatch], pattern: str, shared, ranked) -> Iterator[pa.RecordBatch]:
    """Encodes chunks of texts by their distinct words, and decodes every text from its ids."""
    find, known, ranks = regex.compile(pattern).findall, _words(shared.value), ranked.value
    binary = [b""] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        binary[r] = p
    decimal = [str(i) for i in range(len(binary))]
    for b in batches(rows):
        for c in chunks(b, 1, CHUNK):
            pieces, codes, first = cut(c.column(1))
            own: dict[str, list[int]] = {}
            flat: list[int] = []
            ends = [0]
            for p, used in zip(pieces, (np.bincount(codes, minlength=len(pieces)) > 0).tolist(), strict=True):
                if used:
                    for w in find(p):
                        got = known.get(w) or own.get(w)
                        if got is None:
                            got = own[w] = merge_word(w.encode(), ranks)
                        flat += got
                ends.append(len(flat))
            del pieces, own
            ids, starts = np.array(flat, np.int32), np.array(ends, np.int64)
            lengths = starts[codes + 1] - starts[codes]
            upto = np.concatenate([[0], np.cumsum(lengths)])
            at, out = upto[first], []
            for d in range(c.num_rows):
                place = slice(first[d], first[d + 1])
                n = lengths[place]
                x = ids[np.repeat(starts[codes[place]] - upto[place], n) + np.arange(at[d], at[d + 1])].tolist()
                out.append((len(x), hashlib.sha256(" ".join([decimal[i] for i in x]).encode()).hexdigest(), hashlib.sha256(b"".join([binary[i] for i in x])).hexdigest()))
            a = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([c.column(0), pa.array(a[0], pa.int64()), pa.array(a[1]), pa.array(a[2])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_texts(docs: DataFrame, rank_path: str, pattern: str, common: int = 65_536) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, from encoding and decoding its text."""
    sc = docs.sparkSession.sparkContext
    bpe = BytePairs(read_ranks(rank_path))
    known = sc.broadcast(common_words(docs, bpe, pattern, common))
    ranks = sc.broadcast(bpe.ranks)
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(lambda rows: _texts(rows, pattern, known, ranks), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
