"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its n-grams (3 to 5 UTF-8 bytes, with a mark at either end) and of itself, each
hashed to a bucket with an embedding. The mean of a word's embeddings goes into a softmax over
{clean, toxic}; embeddings and softmax are trained jointly in numpy on the words of labelled
documents, so that unseen misspellings and word forms share the vectors of their n-grams. One bad
word makes a document toxic, however long it is: a document's score is that of its most toxic word,
over its whole text, and a third of the sample, kept out of the training, sets the cut. As softmax
and mean are linear, scoring needs one number per bucket.

The model is fitted, in one task, to a bounded sample of labelled rows: at most `clean_docs` and
`toxic_docs` rows, of texts up to `sample_chars` characters, in order of a hash of doc_id. Everything else covers
all rows. Labels, lang, source and doc_id are never inputs of a score; rows with
crc32(doc_id) mod 5 = 0 teach nothing.

Defined cases: null or empty texts get the score of a bag without grams; without labelled rows
of both classes every score is 0. A null doc_id is not held out and teaches nothing. Repeated rows
each get a row; conflicting labels of one doc_id count as toxic. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import batches, table, written
from tastegrid.llm.pieces import chunks

#: The logit of each bucket, that of an empty bag, and the cut between the classes.
Model = tuple[np.ndarray, float, float]
BITS, SIZES, PRIOR, EASE = 18, (3, 4, 5), 2.0, 0.05
_SPACE = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            n = 1 << max(16, n.bit_length())
            b, inv = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
            b[0] = inv[0] = 1
            _powers[:] = [np.multiply.accumulate(b), np.multiply.accumulate(inv)]
    return _powers[0][:n], _powers[1][:n]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every gram, the word it belongs to, and the words' first bytes. buf begins and ends with a space."""
    with np.errstate(over="ignore"):
        size = len(buf)
        space = buf == 32
        first = np.flatnonzero(~space[1:] & space[:-1]) + 1
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), first
        last = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        word = np.cumsum(np.bincount(first, minlength=size)) - 1
        spaces = np.cumsum(space)
        up, down = _pow(size + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(7)) * up[:size])])
        buckets, words = [_bucket((sums[last + 1] - sums[first - 1]) * down[first - 1], 0)], [np.arange(len(first))]
        for n in SIZES:
            at = np.flatnonzero(spaces[n - 2 : size - 1] == spaces[: size - n + 1] ) if size >= n else np.zeros(0, np.int64)
            buckets.append(_bucket((sums[at + n] - sums[at]) * down[at], n))
            words.append(word[at + 1])
        return np.concatenate(buckets), np.concatenate(words), first


def _buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer((b" " + b" ".join(texts) + b" ").translate(_SPACE), np.uint8)
    return buf, np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])


def _most(first: np.ndarray, doc_at: np.ndarray, z: np.ndarray, floor: float) -> np.ndarray:
    """The largest z of each document's words."""
    best = np.full(len(doc_at) - 1, floor)
    if len(first):
        own, at = np.unique(np.searchsorted(doc_at, first, "right") - 1, return_index=True)
        best[own] = np.maximum.reduceat(z, at)
    return best


def train(texts: list[bytes], toxic: np.ndarray, dim: int = 4, steps: int = 120, rate: float = 0.2, min_docs: int | None = None, seed: int = 1) -> Model | None:
    """Fit to documents and their labels; every third one only sets the scale of the score."""
    if not len(toxic) or toxic.all() or not toxic.any():
        return None
    apart = np.arange(len(texts)) % 3 == 2
    if toxic[apart].all() or not toxic[apart].any() or toxic[~apart].all() or not toxic[~apart].any():
        apart[:] = False
    own, label = [t for t, x in zip(texts, apart, strict=True) if not x], toxic[~apart]
    buf, doc_at = _buffer(own)
    space = buf == 32
    first, stops = np.flatnonzero(~space[1:] & space[:-1]) + 1, np.flatnonzero(space[1:] & ~space[:-1]) + 1
    if not len(first):
        return None
    raw = buf.tobytes()
    place: dict[bytes, int] = {}
    occ = np.fromiter((place.setdefault(raw[a:b], len(place)) for a, b in zip(first.tolist(), stops.tolist(), strict=True)), np.int64, len(first))
    v = len(place)
    pairs = np.unique((np.searchsorted(doc_at, first, "right") - 1) * v + occ)
    doc, word = pairs // v, pairs % v
    n_toxic, n_docs = np.bincount(word, label[doc], v), np.bincount(word, minlength=v).astype(float)
    b, w, _ = grams(_buffer(list(place))[0])
    size = np.bincount(w, minlength=v) + PRIOR
    min_docs = min(8, max(2, len(own) // 100)) if min_docs is None else min_docs
    # a bucket of few documents could only learn the sample by heart: it stays at zero
    often = np.flatnonzero(np.bincount(b, n_docs[w], 1 << BITS) >= min_docs)
    taught = np.isin(b, often)
    b, w = np.searchsorted(often, b[taught]), w[taught]
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.1, (len(often), dim)), "w": rng.normal(0, 0.5, (dim, 2)), "b": np.zeros(2)}
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    target = np.stack([n_docs - n_toxic, n_toxic], axis=1) / n_docs.sum()
    for t in range(1, steps + 1):
        mean = np.stack([np.bincount(w, p["e"][b, k], v) for k in range(dim)], axis=1) / size[:, None]
        z = mean @ p["w"] + p["b"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        d = q / q.sum(axis=1, keepdims=True) * target.sum(axis=1, keepdims=True) - target
        d_word = d @ p["w"].T / size[:, None]
        grad = {"w": mean.T @ d, "b": d.sum(axis=0), "e": np.stack([np.bincount(b, d_word[w, k], len(often)) for k in range(dim)], axis=1)}
        for k in p:
            m[k] += 0.1 * (grad[k] - m[k])
            s[k] += 0.01 * (grad[k] ** 2 - s[k])
            scale = np.sqrt(s[k] / (1 - 0.99**t))
            p[k] -= rate * (m[k] / (1 - 0.9**t)) / (scale + EASE * scale.max() + 1e-12)  # rare grams take small steps
    logits = np.zeros(1 << BITS, np.float32)
    logits[often] = p["e"] @ (p["w"][:, 1] - p["w"][:, 0])
    bias = float(p["b"][1] - p["b"][0])
    x, y = (_each([t for t, a in zip(texts, apart, strict=True) if a], logits, bias), toxic[apart]) if apart.any() else (_each(own, logits, bias), label)
    cuts = np.unique(x)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    ordered, total = np.argsort(x), y.sum()
    below = np.searchsorted(x[ordered], cuts)
    missed = np.concatenate([[0], np.cumsum(y[ordered])])[below]
    wrong = missed + (len(y) - below - (total - missed))
    best = np.flatnonzero(wrong == wrong.min())
    widest = best[np.argmax(np.append(np.diff(cuts), 0)[best])]
    lo, hi = x[x < cuts[widest]], x[x >= cuts[widest]]
    mid = (lo.max() + hi.min()) / 2 if len(lo) and len(hi) else cuts[widest]
    return logits, bias, float(mid)


def raw_scores(texts: list[bytes], logits: np.ndarray, bias: float) -> np.ndarray:
    buf, doc_at = _buffer(texts)
    buckets, word, first = grams(buf)
    z = np.bincount(word, logits[buckets], len(first)) / (np.bincount(word, minlength=len(first)) + PRIOR) + bias
    return _most(first, doc_at, z, bias)


def _each(texts: list[bytes], logits: np.ndarray, bias: float) -> np.ndarray:
    """raw_scores of some texts at a time: a text takes some hundred times its length."""
    return np.concatenate([raw_scores(texts[at : at + 64], logits, bias) for at in range(0, len(texts), 64)])


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    logits, bias, mid = model
    return 1 / (1 + np.exp(-np.clip(raw_scores(texts, logits, bias) - mid, -500, 500)))


def _score(rows: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    own = model.value
    for b in batches(rows):
        for c in chunks(b, 1, 1 << 19):
            s = scores([x or b"" for x in c.column(1).to_pylist()], own)
            yield pa.RecordBatch.from_arrays([*(c.column(k) for k in range(c.num_columns) if k != 1), pa.array(s)], names=[*(n for k, n in enumerate(c.schema.names) if k != 1), "score"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _trained(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, toxic) of the whole sample to the model's one row, or none."""
    texts, toxic = [], []
    for b in batches(rows):
        texts += b.column(0).to_pylist()
        toxic += b.column(1).to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (toxic[i], xxhash.xxh64_intdigest(texts[i]), texts[i]))
    model = train([texts[i] for i in order], np.array([toxic[i] == 1 for i in order], bool))
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([model[0].tobytes()], pa.binary()), pa.array([model[1]]), pa.array([model[2]])], names=["logits", "bias", "cut"])


def fit(docs: DataFrame, labels: DataFrame, clean_docs: int = 1000, toxic_docs: int = 500, sample_chars: int = 4_000) -> Model | None:
    """Fit, in one task, to at most clean_docs and toxic_docs labelled documents that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fits = F.length("text").between(1, sample_chars)
    near = written(docs.filter(fits).select("doc_id").join(known, "doc_id").distinct(), "toxicity-labelled")
    first = lambda label, most: near.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = written(first(0, clean_docs).unionByName(first(1, toxic_docs)), "toxicity-sample")
    own = docs.filter(fits).select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most clean_docs + toxic_docs ids
    own = own.groupBy("doc_id", "toxic").agg(F.min("text").cast("binary").alias("text"))
    row = own.select("text", F.col("toxic").cast("int").alias("toxic")).repartition(1).mapInArrow(_trained, "logits binary, bias double, cut double").first()
    return None if row is None else (np.frombuffer(bytes(row["logits"]), np.float32), row["bias"], row["cut"])


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    if model is None:
        out = d.select("doc_id", F.lit(0.0).alias("score"))
    else:
        shared = spark.sparkContext.broadcast(model)  # 1 MB, whatever the corpus
        out = d.mapInArrow(lambda rows: _score(rows, shared), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows scored 0.5 or more; all of them where labels of both classes are missing, as every score is 0 then."""
    model = fit(docs, labels)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.columns
    d = docs.select(F.struct(*cols).alias("row"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    kind = f"row {d.schema['row'].dataType.simpleString()}, score double"
    return d.mapInArrow(lambda rows: _score(rows, shared), kind).filter("score < 0.5").select("row.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
