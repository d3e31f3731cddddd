"""Removal of repeated byte strings by suffix order and longest previous factors.

A window is a string of LENGTH bytes; one that starts in two places is a repeat, and the bytes that
repeats cover are removed: all of them (keep="none") or those of every place but the first by
(doc_id, position) (keep="first"). Matches never cross documents.

All suffixes of a corpus can't be sorted in one place, so they are dealt by content. The minimizer of
a window is the smallest hash of the strings of GRAM bytes in it, the leftmost if several; equal
windows have equal minimizers at equal offsets. Consecutive windows of one minimizer make a run, some
150 windows long, and only a run's hashes are shuffled. Three cases remain:

* a minimizer seen once: none of the run's windows repeats;
* a run seen twice or more as a whole: all its windows repeat;
* several runs of one minimizer that differ: the texts of these, one of each kind, are gathered by
  minimizer, and a suffix array over their windows, with the previous and the next smaller position
  in suffix order, gives each window's longest previous factor (and the longest later one), up to
  LENGTH. A window whose factor reaches LENGTH repeats.

A minimizer with more than HOT kinds of runs (a passage in millions of documents, each time in
another text) is not gathered: its runs are cut into 16 windows each and counted by their common
core and their whole, and only at the passage's very ends by single windows, with partial counts in
every task. Hashes of runs have 64 bits within one minimizer's 64 bits.

Defined cases: null and empty texts, and those shorter than LENGTH, stay as they are; repeated rows
count as copies of each other, and keep="first" treats them alike; a null doc_id comes first; an empty
table stays empty; other columns are kept (strip_repeats) or ignored.

strip_passages cuts repeats counted in words: every word, between ASCII white space, becomes a code of
CODE bytes, and repeats of CODE * PASSAGE bytes of codes are repeats of so many words, whatever their
bytes. Texts with words of UNBROKEN bytes or more also lose their repeats of LENGTH bytes, since long
strings without white space have no words to count.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, drop, table, written

LENGTH, GRAM, HOT, SUB = 400, 100, 2000, 16
CODE, PASSAGE, UNBROKEN = 4, 51, 100
_SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []
SPANS = "array<struct<lo:int,hi:int>>"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << n.bit_length()
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A hash of every string of k bytes, from running sums of a polynomial modulo 2**64."""
    n = len(buf)
    up, down = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n])])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: prefix and suffix minima of blocks of w."""
    n = len(a) - w + 1
    blocks = np.concatenate([a, np.full(-len(a) % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[w - 1 : w - 1 + n])


def runs_of(parts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the windows of parts (each at least length bytes): part, start, windows, minimizer's offset, its hash, the run's hash."""
    raw = b"".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    low = np.uint64((1 << 24) - 1)
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    at = (sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])
    m = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(m) != 0) | (np.diff(starts) != 1)]))
    first, n = starts[new], np.diff(np.append(new, len(starts)))
    digest = xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(raw[a : a + c + length - 1]) for a, c in zip(first.tolist(), n.tolist(), strict=True)), np.uint64, len(first))
    part = np.searchsorted(ends, first, "right")
    return part, first - begins[part], n, m[new] - first, h[m[new]].view(np.int64), whole.view(np.int64)


def _runs(rows: Iterator[pa.RecordBatch], length: int = LENGTH, gram: int = GRAM) -> Iterator[pa.RecordBatch]:
    def out(held):
        part, start, n, off, m, s = runs_of([x[3] for x in held], length, gram)
        ids, keys, base = (np.array([x[k] for x in held], np.int64) for k in range(3))
        cols = (ids[part], keys[part], (base[part] + start).astype(np.int32), n.astype(np.int32), off.astype(np.int32), m, s)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["id", "key", "start", "n", "off", "m", "s"])

    with np.errstate(over="ignore"):
        held, size = [], 0
        for b in batches(rows):
            for i, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                t = t.as_py()
                for at in range(0, len(t) - length + 1, _SEGMENT):
                    seg = t[at : at + _SEGMENT + length - 1]
                    if held and size + len(seg) > _SEGMENT:
                        yield out(held)
                        held, size = [], 0
                    held.append((i, k, at, seg))
                    size += len(seg)
        if held:
            yield out(held)


def suffix_levels(text: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The first bytes of every position as a number, and (k, rank by the next k bytes) for k doubling up to length.

    Prefix doubling; text is padded with zeros, and the last step overlaps what is sorted already.
    """
    n = len(text)
    wide = np.concatenate([text, np.zeros(length, np.uint8)])
    step = 1
    while step * 2 <= min(8, length):
        step *= 2
    key = np.zeros(n, np.uint64)
    for k in range(step):
        key = (key << np.uint64(8)) | wide[k : k + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    levels = [(step, rank)]
    while step < length:
        jump = min(step, length - step)
        after = np.concatenate([rank[jump:] + 1, np.zeros(min(jump, n), np.int64)])[:n]
        rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1].astype(np.int64)
        step += jump
        levels.append((step, rank))
    return key, levels


def previous_smaller(a: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1, by minima of blocks of two, four, ..."""
    minima = [a]
    while len(minima[-1]) > 1:
        x = minima[-1]
        x = np.append(x, np.iinfo(x.dtype).max) if len(x) % 2 else x
        minima.append(np.minimum(x[::2], x[1::2]))
    place, node, found = np.arange(len(a)), np.arange(len(a)), []
    for low in minima:  # up: the first block to the left that holds a smaller value
        hit = (node % 2 == 1) & (low[node - 1] < a[place])
        found.append((place[hit], node[hit] - 1))
        place, node = place[~hit], node[~hit] // 2
    place, node = found.pop()
    while found:  # down: to the rightmost such value of the block
        low, value = minima[len(found) - 1], a[place]
        right = np.minimum(2 * node + 1, len(low) - 1)
        node = np.where(low[right] < value, right, 2 * node)
        more = found.pop()
        place, node = np.concatenate([place, more[0]]), np.concatenate([node, more[1]])
    out = np.full(len(a), -1, np.int64)
    out[place] = node
    return out


def common_prefix(key: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common prefix of the suffixes at a and b, up to that of the last level."""
    length, whole = levels[-1]
    out = np.where(whole[a] == whole[b], length, 0)
    open_ = np.flatnonzero(out == 0)
    x, y, at = a[open_], b[open_], np.zeros(len(open_), np.int64)
    width = levels[0][0]
    for k, rank in reversed(levels[:-1]):
        at += np.where(rank[x + at] == rank[y + at], k, 0)
    differ = key[x + at] ^ key[y + at]
    for k in range(1, width):
        at += (differ >> np.uint64(8 * (width - k))) == 0
    out[open_] = np.minimum(at, length - 1)
    return out


def previous_factors(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start the length, up to `length`, of its longest previous factor, and of its longest later one.

    In suffix order the longest earlier match of a position stands at the nearest smaller position before or
    after it, the longest later one at the nearest larger position; starts go up, and only they are matched.
    """
    key, levels = suffix_levels(text, length)
    order = np.lexsort((starts, levels[-1][1][starts]))
    at = starts[order]

    def longest(value: np.ndarray) -> np.ndarray:
        before, after = previous_smaller(value), len(value) - 1 - previous_smaller(value[::-1])[::-1]
        out = np.zeros(len(value), np.int64)
        for near, there in ((before, before >= 0), (after, after < len(value))):
            some = np.flatnonzero(there)
            out[some] = np.maximum(out[some], common_prefix(key, levels, at[some], at[near[some]]))
        return out

    earlier, later = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    earlier[order], later[order] = longest(at), longest(-at)
    return earlier, later


def _spans(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _suffix_order(rows: Iterator[pa.RecordBatch], length: int = LENGTH, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows (m, s, n, body), those of one m together and in order of their first place."""

    def out(held):
        text = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        at = np.cumsum([0] + [len(x[3]) for x in held])
        starts = np.concatenate([np.arange(a, a + x[2]) for a, x in zip(at.tolist(), held, strict=False)])
        earlier, later = (x >= length for x in previous_factors(text, starts, length))
        cuts = np.cumsum([x[2] for x in held])[:-1]
        both = [(_spans(a | b), _spans(a)) for a, b in zip(np.split(earlier, cuts), np.split(later, cuts), strict=True)]
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([x[0] for x in both], kind), pa.array([x[1] for x in both], kind)], names=["m", "s", "dup", "later"])

    held, size = [], 0
    for b in batches(rows):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > most and row[0] != held[-1][0]:
                yield out(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield out(held)


def _sub_runs(rows: Iterator[pa.RecordBatch], length: int = LENGTH) -> Iterator[pa.RecordBatch]:
    """Runs cut where the minimizer's offset is a multiple of SUB: (m, s, id, at, lo, core, whole, each window's hash)."""
    digest = xxhash.xxh3_64_intdigest
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    for b in batches(rows):
        got: list[tuple] = []
        for m, s, i, start, n, off, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
            lo = 0
            while lo < n:
                hi = min(n, lo + (off - lo) % SUB + 1)
                at = off - (off - lo) // SUB * SUB  # the core is what all SUB windows of this place would share
                core = digest(body[at : at - SUB + 1 + length] + bytes([(off - lo) // SUB]), 7)
                whole = digest(body[lo : hi - 1 + length], off - lo)
                got.append((m, s, i, start, lo, sign(core), sign(whole), [sign(digest(body[k : k + length], off - k)) for k in range(lo, hi)]))
                lo = hi
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got, strict=True), kinds, strict=True)], names=["m", "s", "id", "start", "lo", "core", "whole", "each"])


def _hot(units: DataFrame, length: int = LENGTH) -> DataFrame:
    """(m, s, dup, later) for the runs of minimizers with many kinds of runs, by counting."""
    sub = written(units.select("m", "s", "id", "start", "n", "off", "body").mapInArrow(lambda rows: _sub_runs(rows, length), "m long, s long, id long, start int, lo int, core long, whole long, each array<long>"), "suffix-sub")
    place = F.struct("id", F.col("start").alias("start"), "m", "s", "lo")
    wholes = written(sub.groupBy("core", "whole").agg(F.count("*").alias("c"), F.min(place).alias("first")), "suffix-wholes")
    cores = written(wholes.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-cores")
    known = written(wholes.join(cores, "core", "left"), "suffix-known")
    full = sub.join(known.filter("c > 1"), ["core", "whole"]).select("m", "s", "lo", F.size("each").alias("k"), (place != F.col("first")).alias("late"))
    full = full.select("m", "s", F.expr("explode(sequence(lo, lo + k - 1))").alias("w"), "late")
    # runs that share a core but differ: by single windows
    mixed = sub.join(known.filter("kinds > 1"), ["core", "whole"]).select("core", "m", "s", "id", "start", "lo", F.posexplode("each").alias("j", "h"))
    mixed = written(mixed.withColumn("w", F.col("lo") + F.col("j")), "suffix-mixed")
    at = F.struct("id", "start", "m", "s", "w")
    same = written(mixed.groupBy("core", "h").agg(F.count("*").alias("c"), F.min(at).alias("first")).filter("c > 1"), "suffix-same")
    single = mixed.join(same, ["core", "h"]).select("m", "s", "w", (at != F.col("first")).alias("late"))
    flags = full.union(single).groupBy("m", "s", "w").agg(F.max("late").alias("late"))
    one = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct(F.col("w").alias("lo"), (F.col("w") + 1).alias("hi")))))
    return flags.groupBy("m", "s").agg(one(F.lit(True)).alias("dup"), one(F.col("late")).alias("later"))


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """id and key name a row's text; rows of equal id and text are alike."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(body).alias("key"), body.alias("body"), *more)


def repeated_spans(docs: DataFrame, keep: str = "none", hot: int = HOT, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, key, spans): the byte spans to remove of each text that has any, not yet merged."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    d = _keyed(docs).filter(F.octet_length("body") >= length)
    runs = written(d.mapInArrow(lambda rows: _runs(rows, length, gram), "id long, key long, start int, n int, off int, m long, s long"), "suffix-runs")
    twice = written(runs.groupBy("m").count().filter("count > 1").select("m"), "suffix-twice")
    cand = written(runs.join(twice, "m"), "suffix-candidates")
    drop(runs, twice)
    kinds = written(cand.groupBy("m", "s").agg(F.count("*").alias("c"), F.min(F.struct("id", "start", "key", "n", "off")).alias("first")), "suffix-kinds")
    several = written(kinds.groupBy("m").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "suffix-several")
    want = kinds.join(several, "m").select("first.id", "first.key", F.struct("m", "s", "first.start", "first.n", "first.off", "kinds").alias("r"))
    want = written(want.groupBy("id", "key").agg(F.collect_list("r").alias("r")), "suffix-wanted")
    own = d.dropDuplicates(["id", "key"]) if not _keyed_once(docs) else d
    units = own.join(want, ["id", "key"]).select("id", "body", F.explode("r").alias("r"))
    units = written(units.select("id", "r.*", F.expr(f"substring(body, r.start + 1, r.n + {length - 1})").alias("body")), "suffix-units")
    drop(want)
    found = units.filter(F.col("kinds") <= hot).repartition("m").sortWithinPartitions("m", "id", "start")
    found = found.select("m", "s", "n", "body").mapInArrow(lambda rows: _suffix_order(rows, length), f"m long, s long, dup {SPANS}, later {SPANS}")
    many = units.filter(F.col("kinds") > hot)
    if not several.filter(F.col("kinds") > hot).isEmpty():
        found = found.union(_hot(many, length))
    found = written(found, "suffix-found")
    drop(units, several)
    known = written(kinds.join(found, ["m", "s"], "left"), "suffix-known")
    drop(kinds, found)
    none = F.expr(f"CAST(array() AS {SPANS})")
    all_ = F.array(F.struct(F.lit(0).alias("lo"), F.col("n").alias("hi")))
    r = cand.join(known, ["m", "s"])
    if keep == "none":
        spans = F.when(F.col("c") > 1, all_).otherwise(F.coalesce("dup", none))
    else:
        lead = (F.col("id") == F.col("first.id")) & (F.col("start") == F.col("first.start")) & (F.col("key") == F.col("first.key"))
        spans = F.when(lead, F.coalesce("later", none)).otherwise(all_)
    r = r.select("id", "key", "start", F.explode(spans).alias("x"))
    r = r.select("id", "key", (F.col("start") + F.col("x.lo")).alias("lo"), (F.col("start") + F.col("x.hi") + (length - 1)).alias("hi")).distinct()
    spans = written(r.groupBy("id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    drop(cand, known)
    return spans


def _keyed_once(docs: DataFrame) -> bool:
    """Whether no doc_id comes twice, so that no text need be folded."""
    return docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def kept_bytes(body: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of body, and the number of maximal runs removed."""
    if not spans:
        return body, 0
    out, at, n = [], 0, 0
    end = -1
    for lo, hi in sorted((x["lo"], x["hi"]) for x in spans):
        if lo > end:
            out.append(body[at:lo])
            n += 1
        end = max(end, hi)
        at = end
    return b"".join((*out, body[at:])), n


def _digests(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        got = []
        for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            left, n = kept_bytes(t, spans)
            got.append((len(t), len(t) - len(left), n, hashlib.sha256(left).hexdigest()))
        a = list(zip(*got, strict=True))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in a[:3]), pa.array(a[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _left(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        left = [kept_bytes(t, s)[0].decode("utf-8", "ignore") for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string())], names=["row", "left"])


def repeat_digests(docs: DataFrame, keep: str = "none") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    d = _keyed(docs, "doc_id").join(repeated_spans(docs, keep), ["id", "key"], "left")
    return d.select("doc_id", "body", "spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, keep: str = "first") -> DataFrame:
    """docs with repeats cut out of text, and n_chars made to fit; a character cut in part goes whole.

    A null text stays null; a document of which nothing is left keeps its row with an empty text.
    """
    cols = docs.columns
    spans = repeated_spans(docs, keep)
    d = _keyed(docs, F.struct(*cols).alias("row")).join(spans, ["id", "key"], "left").select("row", "body", "spans")
    kind = d.schema["row"].dataType.simpleString()
    out = d.filter("spans IS NULL").select("row.*").select(cols)
    cut = d.filter("spans IS NOT NULL").mapInArrow(_left, f"row {kind}, left string")
    rest = [F.col("left").alias(c) if c == "text" else F.length("left").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in cols]
    return out.unionByName(cut.select(*rest))


def _codes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh32_intdigest
    for b in batches(rows):
        codes = (np.fromiter(map(digest, t.as_py().split()), "<u4").tobytes() for t in b.column(2))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary())], names=["doc_id", "key", "text"])


def word_spans(body: bytes, spans: list[dict]) -> list[dict]:
    """Spans of codes as the spans of bytes from their first whole word to the last."""
    place = [m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", body)]
    whole = [(-(-x["lo"] // CODE), x["hi"] // CODE) for x in spans]
    return [{"lo": place[a][0], "hi": place[b - 1][1]} for a, b in whole if b - a >= PASSAGE]


def _passages_left(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        left = [kept_bytes(t, word_spans(t, w or []) + (s or []))[0].decode("utf-8", "ignore") for t, w, s in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string())], names=["row", "left"])


def strip_passages(docs: DataFrame, keep: str = "first") -> DataFrame:
    """docs with repeated passages of PASSAGE words or more cut out of text, and n_chars made to fit."""
    cols = docs.columns
    d = _keyed(docs, F.struct(*cols).alias("row"))
    coded = d.select("id", "key", "body").filter(F.octet_length("body") >= 2 * PASSAGE - 1).mapInArrow(_codes, "doc_id long, key long, text binary")
    coded = written(coded, "suffix-codes")
    # equal ids with texts that differ only in white space have equal codes, and with them equal spans
    words = repeated_spans(coded.select("doc_id", "text"), keep, length=CODE * PASSAGE, gram=CODE * PASSAGE // 4)
    keys = coded.select(F.col("doc_id").alias("id"), "key", F.xxhash64("text").alias("code")).distinct()
    words = written(words.withColumnsRenamed({"key": "code", "spans": "words"}).join(keys, ["id", "code"]).select("id", "key", "words"), "suffix-words")
    drop(coded)
    unbroken = docs.filter(F.col("text").rlike(f"[^ \\t\\n\\r\\x0B\\f]{{{UNBROKEN}}}"))
    spans = words.join(repeated_spans(unbroken, keep), ["id", "key"], "full")
    j = d.join(spans, ["id", "key"], "left").select("row", "body", "words", "spans")
    kind = j.schema["row"].dataType.simpleString()
    out = j.filter("words IS NULL AND spans IS NULL").select("row.*").select(cols)
    cut = j.filter("words IS NOT NULL OR spans IS NOT NULL").mapInArrow(_passages_left, f"row {kind}, left string")
    rest = [F.col("left").alias(c) if c == "text" else F.length("left").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in cols]
    return out.unionByName(cut.select(*rest))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
